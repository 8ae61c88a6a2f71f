"""Watching live results: eras, breaches, z-scores, levels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import moments, se_sharpe


def eras(curve: DataFrame, started: str | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """``era`` of each bar of each run (``keys``), and equity that starts anew in
    each; ``started`` is a date, or a column with each run's own."""
    start = started if isinstance(started, Column) else F.lit(started)
    marked = curve.withColumn("era", F.when(F.col("date") <= start.cast("date"), "baseline").otherwise("paper"))
    upto = Window.partitionBy(*keys, "era").orderBy("bar_ix").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("equity", F.product(1 + F.col("net")).over(upto))
    return marked.withColumn("drawdown", 1 - F.col("equity") / F.max("equity").over(upto))


def first_breach(marked: DataFrame, most_loss: float = 0.25, most_drawdown: float = 0.30, keys: tuple[str, ...] = ()) -> DataFrame:
    breach = (1 - F.col("equity") > most_loss) | (F.col("drawdown") > most_drawdown)
    return marked.groupBy(*keys, "era").agg(F.min(F.when(breach, F.col("date"))).alias("breached"))


def z_score(observed: Column, expected: Column, se: Column) -> Column:
    """Deviation by standard errors. Without an error any deviation saturates; none is 0."""
    return F.when(F.coalesce(se > 0, F.lit(False)) & (se < math.inf), F.try_divide(observed - expected, se)).when(observed == expected, 0.0).otherwise(F.signum(observed - expected) * 1e6)


def z_scores(marked: DataFrame, trades: DataFrame, started: str, periods: float) -> DataFrame:
    """Live against baseline, by the errors of the live era: of the Sharpe with
    its own skew and kurtosis, of the win rate as a share of so many trades, and
    of the average trade by the baseline's deviation. Parts that a side lacks count as 0."""
    era = F.when(F.col("entry_date") <= F.lit(started).cast("date"), "baseline").otherwise("paper")
    s = moments(marked, ("era",), periods=periods)
    of = lambda frame, name, *fields: frame.filter(F.col("era") == name).select(*[F.col(f).alias(f"{name}_{f}") for f in fields])
    t = trades.filter("NOT open_at_end").withColumn("era", era).groupBy("era").agg(F.avg((F.col("net_return") > 0).cast("double")).alias("win"), F.avg("net_return").alias("mean"), F.stddev_samp("net_return").alias("std"), F.count("net_return").alias("trades"))
    one = marked.agg(F.count("*").alias("n_all"))  # each side is one row at most
    for part in (of(s, "paper", "sr", "n", "skew", "kurt"), of(s, "baseline", "sr"), of(t, "paper", "win", "mean", "trades"), of(t, "baseline", "win", "mean", "std")):
        one = one.join(F.broadcast(part), F.lit(True), "left")
    c = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    n = F.coalesce("paper_trades", F.lit(0))
    return one.select(
        z_score(c("paper_sr"), c("baseline_sr"), se_sharpe(c("paper_sr"), F.coalesce("paper_n", F.lit(0)), c("paper_skew"), F.coalesce("paper_kurt", F.lit(3.0)))).alias("z_sharpe"),
        z_score(c("paper_win"), c("baseline_win"), F.sqrt(F.try_divide(c("baseline_win") * (1 - c("baseline_win")), n))).alias("z_win"),
        z_score(c("paper_mean"), c("baseline_mean"), F.try_divide(c("baseline_std"), F.sqrt(n))).alias("z_trade"),
        n.alias("n_trades"),
    )


def ks_p_value(distance: float, n: int, m: int) -> float:
    """Chance that two samples of n and m from one distribution are at least so
    far apart: by the random walks that stay within the distance, counted along
    their diagonals, and beyond ten million places by Kolmogorov's limit."""
    if n * m > 10_000_000:
        t = math.sqrt(n * m / (n + m)) * distance
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)))) if t > 0.2 else 1.0
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    i = np.arange(n + 1)
    for step in range(1, n + m + 1):
        j = step - i
        grown = inside * np.where((j > 0) & (j <= m), j, 0) / step  # one more of the second
        grown[1:] += (inside * (i + 1) / step)[:-1]  # one more of the first
        near = (j >= 0) & (j <= m) & (np.abs(i / n - j / m) < distance - 1e-12)
        inside = np.where(near, grown, 0.0)
    return float(min(1.0, max(0.0, 1 - inside[n])))


def ks_distance(values: DataFrame) -> DataFrame:
    """Largest distance of two empirical distributions (side 'a' or 'b', x), and
    its two-sided p-value; 1 where a side has fewer than two values."""

    @F.pandas_udf("double")
    def p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([ks_p_value(x, int(a), int(b)) if a > 1 and b > 1 else 1.0 for x, a, b in zip(d, n, m)], dtype="float64")

    sizes = values.agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    steps = values.groupBy("x").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    upto = Window.partitionBy(F.lit(0)).orderBy("x")  # losses of one strategy: few
    steps = steps.withColumns({"ca": F.sum("a").over(upto), "cb": F.sum("b").over(upto)}).crossJoin(F.broadcast(sizes))
    d = steps.groupBy("na", "nb").agg(F.max(F.abs(F.try_divide("ca", "na") - F.try_divide("cb", "nb"))).alias("distance"))
    return d.withColumn("p_value", p(F.coalesce("distance", F.lit(0.0)), "na", "nb"))


#: A z-score below the first is a signal and below the second red by itself; so is a smaller p-value of
#: losses than the third; so many signals are orange, and fewer trades than the last give no verdict.
SIGNAL, RED, LOSSES, ORANGE, LEAST_TRADES = -1.5, -3.0, 0.01, 2, 20


def level(signals: DataFrame) -> DataFrame:
    """Health from z_sharpe, z_win, z_trade, p_loss, weak_regime, n_trades. In a
    regime that the baseline was weak in red counts as orange and orange as
    yellow, and yellow stays."""
    zs = [F.col(z) for z in ("z_sharpe", "z_win", "z_trade")]
    odd = F.col("p_loss") < LOSSES
    low = sum(F.coalesce((z < SIGNAL).cast("int"), F.lit(0)) for z in zs) + F.coalesce(odd.cast("int"), F.lit(0))
    rank = F.when((F.least(*zs) < RED) | odd, 3).when(low >= ORANGE, 2).when(low >= 1, 1).otherwise(0)
    eased = F.when(F.col("weak_regime") & (rank > 1), rank - 1).otherwise(rank)
    final = F.when(F.col("n_trades") < LEAST_TRADES, 0).otherwise(eased)
    return signals.withColumn("level", F.element_at(F.array(*map(F.lit, ("green", "yellow", "orange", "red"))), final + 1))


def level_changes(log: DataFrame) -> DataFrame:
    before = F.lag("level").over(Window.partitionBy("entity").orderBy("at", "id"))
    return log.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col("level")))


def new_trades(trades: DataFrame, known: DataFrame, breached: str | None = None) -> DataFrame:
    out = trades.join(known.select("instrument", "entry_date"), ["instrument", "entry_date"], "left_anti")
    return out.filter(F.col("entry_date") < F.lit(breached).cast("date")) if breached else out


def progress(trades: DataFrame) -> DataFrame:
    """Running count of trades and the regimes seen so far."""
    upto = Window.partitionBy("entity").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumns({"n": F.count("*").over(upto), "regimes": F.array_sort(F.collect_set("regime").over(upto))})
