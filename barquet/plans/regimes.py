"""Market regimes: labels of each date, and results by label."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import sharpe

LABELS = ("crisis", "high_vol", "low_vol", "trending", "sideways")


def market_returns(panel: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``bar_ix, date, market``: the mean return of what is listed, 0 if nothing is."""
    return panel.groupBy(*keys, "bar_ix", "date").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("market"))


def _medians(pdf: pd.DataFrame) -> pd.DataFrame:
    """``reference``: the median of vol so far; null before the first one. Two
    heaps hold the lower and the upper half, so a bar costs the logarithm of those before it."""
    pdf, low, high, out = pdf.sort_values("bar_ix"), [], [], []
    for v in pdf["vol"].tolist():
        if v is not None and v == v:
            heapq.heappush(high, -heapq.heappushpop(low, -v))
            if len(high) > len(low):
                heapq.heappush(low, -heapq.heappop(high))
        out.append(None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
    return pdf[["market_key", "bar_ix"]].assign(reference=pd.Series(out, index=pdf.index, dtype="float64"))


def trailing(market: DataFrame, lookback: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``vol, mean`` of the bars before each one, ``drawdown``, and ``reference``,
    the median of vol so far. ``keys`` tell markets apart; one market is as long
    as the calendar, so its windows are one task by nature."""
    market = market.withColumn("market_key", F.to_json(F.struct(*keys)) if keys else F.lit("all"))
    own = Window.partitionBy("market_key")
    order = own.orderBy("bar_ix")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(-lookback, -1)
    enough = F.row_number().over(order) > lookback
    x = market.withColumns({"equity": F.product(1 + F.col("market")).over(upto), "vol": F.when(enough, F.stddev_pop("market").over(before)), "mean": F.when(enough, F.avg("market").over(before)), "n": F.count("*").over(own)})
    medians = x.select("market_key", "bar_ix", "vol").groupBy("market_key").applyInPandas(_medians, "market_key string, bar_ix long, reference double")
    x = x.withColumn("drawdown", 1 - F.col("equity") / F.max("equity").over(upto))
    return x.join(medians.withColumn("bar_ix", F.col("bar_ix").cast(market.schema["bar_ix"].dataType)), ["market_key", "bar_ix"]).drop("market_key")


def label(market: DataFrame, lookback: int = 63, crisis: float = 0.20, high: float = 1.5, low: float = 0.6, strength: float = 0.10, keys: tuple[str, ...] = ()) -> DataFrame:
    """``regime`` of each bar of each market (``keys``), from the bars before it: a deep drawdown first, then
    volatility against its median so far, then the trend's strength."""
    x = trailing(market, lookback, keys)
    trend = F.when(F.col("vol") > 0, F.abs("mean") / F.col("vol")).otherwise(0.0)
    regime = (
        F.when(F.col("n") < lookback + 2, "sideways")
        .when(F.col("drawdown") >= crisis, "crisis")
        .when(F.col("vol").isNull() | (F.col("reference") <= 0), "sideways")
        .when(F.col("vol") >= high * F.col("reference"), "high_vol")
        .when(F.col("vol") <= low * F.col("reference"), "low_vol")
        .when(trend >= strength, "trending")
        .otherwise("sideways")
    )
    return x.withColumn("regime", regime).select(*keys, "bar_ix", "date", "market", "regime")


def by_regime(curve: DataFrame, labels: DataFrame, periods: float, keys: tuple[str, ...] = (), market: tuple[str, ...] = ()) -> DataFrame:
    """Results of each run (``keys``) on each regime's bars joined end to end;
    dates without a label are sideways. ``market``: the columns of ``curve`` that
    name the market whose labels are meant."""
    joined = curve.join(labels.select(*market, "date", "regime"), [*market, "date"], "left").withColumn("regime", F.coalesce("regime", F.lit("sideways")))
    upto = Window.partitionBy(*keys, "regime").orderBy("bar_ix").rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("equity", F.product(1 + F.col("net")).over(upto))
    joined = joined.withColumn("drawdown", F.col("equity") / F.max("equity").over(upto) - 1)
    return joined.groupBy(*keys, "regime").agg(sharpe(F.col("net"), periods).alias("sharpe"), (F.product(1 + F.col("net")) - 1).alias("total"), (-F.min("drawdown")).alias("max_drawdown"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_bars"))


def weak(results: DataFrame, labels: DataFrame | None = None, keys: tuple[str, ...] = (), market: tuple[str, ...] = ()) -> DataFrame:
    """Each run's regimes with a Sharpe under 0; with labels, whether each is that of its market's last bar."""
    out = results.filter("sharpe < 0").select(*keys, *[m for m in market if m not in keys], "regime")
    if labels is None:
        return out
    current = labels.groupBy(*market).agg(F.max_by("regime", "bar_ix").alias("__current"))  # a row a market
    met = out.join(current, list(market)) if market else out.crossJoin(F.broadcast(current))
    return met.withColumn("is_current", F.col("regime") == F.col("__current")).drop("__current")
