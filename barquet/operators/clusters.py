"""Correlation clusters: equal shares to clusters, and within them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Instruments in a tile of the correlation matrix.
TILE = 256


def _windows(frame: DataFrame, window: int, every: int) -> DataFrame:
    """``at, instrument, place, ret``: a row an instrument and rebalance with the returns of the window that ends there, as arrays."""
    dates = frame.select("bar_ix").distinct().filter((F.col("bar_ix") >= window - 1) & ((F.col("bar_ix") - (window - 1)) % every == 0)).select(F.col("bar_ix").alias("at"))
    inside = frame.join(F.broadcast(dates), F.col("bar_ix").between(F.col("at") - (window - 1), F.col("at")))  # dates: the calendar over `every`
    bars = F.collect_list(F.struct((F.col("at") - F.col("bar_ix")).cast("int").alias("place"), F.col("ret").cast("double").alias("ret"))).alias("bars")
    return inside.groupBy("at", "instrument").agg(bars).select(F.col("at").cast("long").alias("at"), "instrument", F.col("bars.place").alias("place"), F.col("bars.ret").alias("ret"))


def _matrix(pdf: pd.DataFrame, window: int) -> np.ndarray:
    """Returns, a row an instrument and a column a bar; NaN where there is none."""
    out = np.full((len(pdf), window), np.nan)
    for i, (place, ret) in enumerate(zip(pdf["place"], pdf["ret"])):
        out[i, np.asarray(place)] = np.asarray(ret, dtype=float)
    return out


def correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of ``x`` with each of ``y`` over the bars that both have: NaN
    where either doesn't vary. Sums of products of centred rows, as matrix products."""

    def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = ~np.isnan(m)
        filled = np.where(known, m, 0.0)
        mean = filled.sum(1) / np.maximum(known.sum(1), 1)
        return np.where(known, m - mean[:, None], 0.0), known.astype(float), np.maximum(np.abs(filled).max(1, initial=0.0), 1e-300)

    (a, ka, large_a), (b, kb, large_b) = centred(x), centred(y)
    n = np.maximum(ka @ kb.T, 1.0)
    sa, sb = a @ kb.T, ka @ b.T
    va, vb = (a * a) @ kb.T - sa * sa / n, ka @ (b * b).T - sb * sb / n
    flat = (va <= 1e-26 * n * large_a[:, None] ** 2) | (vb <= 1e-26 * n * large_b[None, :] ** 2)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(flat, np.nan, (a @ b.T - sa * sb / n) / np.sqrt(va * vb))


def pair_correlations(frame: DataFrame, window: int, every: int) -> DataFrame:
    """``at, a, b, rho`` of each pair of instruments over the window that ends at
    each rebalance and have a bar in common there; null where either doesn't vary.

    Windows travel as rows, not bars: tiles of about ``TILE`` instruments meet,
    and a pair of tiles is one task's matrix product."""
    rows = _windows(frame, window, every)
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.lit(1)).cast("int").alias("tiles")
    numbered = rows.join(rows.groupBy("at").agg(tiles), "at").withColumn("own", F.pmod(F.xxhash64("instrument"), F.col("tiles")).cast("int"))
    other = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = other.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("instrument", ignore_index=True)
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        names, values = pdf["instrument"].to_numpy(), _matrix(pdf, window)
        left, right = (np.flatnonzero(pdf["own"].to_numpy() == k) for k in (low, high))
        rho = correlations(values[left], values[right])
        i, j = np.nonzero(left[:, None] < right[None, :]) if low == high else np.indices(rho.shape).reshape(2, -1)
        there = np.zeros(values.shape)
        for k, place in enumerate(pdf["place"]):
            there[k, np.asarray(place)] = 1.0
        met = (there[left] @ there[right].T)[i, j] > 0
        i, j = i[met], j[met]
        a, b = left[i], right[j]
        return pd.DataFrame({"at": np.full(len(i), pdf["at"].iloc[0]), "a": names[np.minimum(a, b)], "b": names[np.maximum(a, b)], "rho": rho[i, j]})

    made = dealt.groupBy("at", "low", "high").applyInPandas(run, "at long, a string, b string, rho double")
    return made.withColumn("rho", F.nanvl("rho", F.lit(None).cast("double")))


def average_linkage(distance: np.ndarray, groups: int) -> list[int]:
    """Labels after merging the two nearest groups, by mean distance, until so
    many are left; of equal pairs the first. Each group knows its nearest one
    behind it, and a merge mends its own row and those that pointed at it."""
    n = len(distance)
    gaps = np.array(distance, dtype=float)
    gaps[np.tril_indices(n)] = np.inf
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    nearest = gaps.argmin(1) if n else np.zeros(0, int)
    best = gaps[np.arange(n), nearest]

    def look(i: int) -> None:
        nearest[i] = gaps[i].argmin()
        best[i] = gaps[i, nearest[i]]

    for _ in range(n - max(groups, 1)):
        i = int(best.argmin())
        j = int(nearest[i])
        row = lambda k: np.r_[gaps[:k, k], np.inf, gaps[k, k + 1 :]]
        merged = (size[i] * row(i) + size[j] * row(j)) / (size[i] + size[j])  # infinite at both and at groups that are gone
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
        gaps[:i, i], gaps[i, i + 1 :] = merged[:i], merged[i + 1 :]
        gaps[:j, j], gaps[j] = np.inf, np.inf
        best[j] = np.inf
        look(i)
        nearer = np.flatnonzero((gaps[:i, i] < best[:i]) | ((gaps[:i, i] == best[:i]) & (i < nearest[:i])))
        nearest[nearer], best[nearer] = i, gaps[nearer, i]
        for k in np.flatnonzero(alive & ((nearest == j) | ((nearest == i) & (np.arange(n) < i)))):
            if k != i:
                look(k)
    names = {k: place for place, k in enumerate(sorted(set(label.tolist())))}  # a group is called after its first member
    return [names[k] for k in label.tolist()]


def cluster_weights(frame: DataFrame, window: int = 120, every: int = 20, groups: int = 3) -> DataFrame:
    """``instrument, bar_ix, weight``: labels hold from a rebalance to the next one; a pair without a correlation counts as unrelated.

    A rebalance is one task that gets a row an instrument, and holds the square of their number: 200 MB for 5,000."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("instrument", ignore_index=True)
        values = _matrix(pdf, window)
        distance = np.empty((len(pdf), len(pdf)))
        for k in range(0, len(pdf), TILE):
            rho = np.nan_to_num(correlations(values[k : k + TILE], values), nan=0.0)
            distance[k : k + TILE] = np.sqrt(np.clip(0.5 * (1 - rho), 0, None))
        label = np.array(average_linkage(distance, min(groups, len(pdf))))
        counts = np.bincount(label)
        return pd.DataFrame({"at": pdf["at"], "instrument": pdf["instrument"], "weight": 1 / (len(counts) * counts[label])})

    labels = _windows(frame, window, every).groupBy("at").applyInPandas(run, "at long, instrument string, weight double")
    joined = frame.select("instrument", "bar_ix").join(labels.withColumnRenamed("at", "bar_ix"), ["instrument", "bar_ix"], "left")
    return joined.withColumn("weight", F.last("weight", ignorenulls=True).over(Window.partitionBy("instrument").orderBy("bar_ix")))
