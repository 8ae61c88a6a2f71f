"""Metrics of return curves and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backtest import Keys, equity


def sharpe(r: Column, periods: float) -> Column:
    std = F.stddev_samp(r)
    return F.coalesce(F.when(std > 0, F.avg(r) / std * F.sqrt(F.lit(float(periods)))), F.lit(0.0))


def sortino(r: Column, periods: float) -> Column:
    std = F.stddev_samp(F.when(r < 0, r))
    return F.coalesce(F.when(std > 0, F.avg(r) / std * F.sqrt(F.lit(float(periods)))), F.lit(0.0))


def summary(curve: DataFrame, periods: float, keys: Keys = ()) -> DataFrame:
    """One row a run: Sharpe, Sortino, total return, growth a year (0 where all is lost), drawdowns, Calmar."""
    marked = equity(curve, keys)
    out = marked.groupBy(*keys).agg(
        F.count("*").alias("n_bars"),
        sharpe(F.col("net"), periods).alias("sharpe"),
        sortino(F.col("net"), periods).alias("sortino"),
        (F.product(1 + F.col("net")) - 1).alias("total_return"),
        (-F.min("drawdown")).alias("max_drawdown"),
        F.coalesce(-F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))), F.lit(0.0)).alias("avg_drawdown"),
    )
    years = F.col("n_bars") / float(periods)
    out = out.withColumn("cagr", F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), 1 / years) - 1).otherwise(0.0))
    return out.withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("cagr") / F.col("max_drawdown")).otherwise(0.0))


def longest_underwater(curve: DataFrame, keys: Keys = ()) -> DataFrame:
    """Days of the longest stretch under the peak; it ends at the bar that recovers, or at the last one."""
    order = Window.partitionBy(*keys).orderBy("bar_ix") if keys else Window.partitionBy(F.lit(0)).orderBy("bar_ix")
    marked = equity(curve, keys).withColumn("under", F.col("drawdown") < 0)
    marked = marked.withColumn("__new", (F.col("under") != F.coalesce(F.lag("under").over(order), F.lit(False))).cast("int")).withColumn("island", F.sum("__new").over(order)).withColumn("after", F.lead("date").over(order))
    spans = marked.filter("under").groupBy(*keys, "island").agg(F.min("date").alias("a"), F.max_by(F.coalesce("after", "date"), "bar_ix").alias("b"))
    days = spans.groupBy(*keys).agg(F.max(F.datediff("b", "a")).alias("underwater_days"))
    if keys:
        return curve.select(*keys).distinct().join(days, list(keys), "left").na.fill(0, ["underwater_days"])
    return days.select(F.coalesce("underwater_days", F.lit(0)).alias("underwater_days"))


def trade_summary(trades: DataFrame, keys: Keys = ()) -> DataFrame:
    """Closed trades' profit factor, win rate and expectancy, each 0 where nothing
    is there to divide by; the count has open ones too."""
    closed = ~F.col("open_at_end")
    net = F.when(closed, F.col("net_return"))
    won, lost = F.sum(F.when(net > 0, net)), F.sum(F.when(net < 0, -net))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trade_count"),
        F.count_if(closed).alias("closed_count"),
        F.coalesce(F.when(lost > 0, F.coalesce(won, F.lit(0.0)) / lost), F.lit(0.0)).alias("profit_factor"),
        F.coalesce(F.try_divide(F.count_if(net > 0), F.count(net)), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(net), F.lit(0.0)).alias("expectancy"),
    )


def periods_per_year(frame: DataFrame) -> DataFrame:
    """From columns bar_seconds, session_seconds, trading_days: intraday bars by the session, days, or longer bars by the calendar."""
    bar, day = F.col("bar_seconds"), 86_400
    return frame.withColumn("periods", F.when(bar < day, F.col("trading_days") * F.col("session_seconds") / bar).when(bar == day, F.col("trading_days").cast("double")).otherwise(365.25 * day / bar))


def outliers(curve: DataFrame, keys: Keys = ()) -> DataFrame:
    """How much of the total return rests on single bars."""
    down, n = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(F.desc("net"), "bar_ix"), F.count("*").over(Window.partitionBy(*(keys or (F.lit(0),))))
    ranked = curve.withColumn("k", F.row_number().over(down)).withColumn("n", n)
    total = F.sum("net")
    share = lambda c: F.when(total != 0, F.sum(F.when(c, F.col("net")).otherwise(0.0)) / total)
    return ranked.groupBy(*keys).agg(
        F.max("net").alias("best_bar"),
        F.min("net").alias("worst_bar"),
        share(F.col("k") <= 5).alias("top5_share"),
        share(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.05))).alias("top_5pct_share"),
    )


def histogram(curve: DataFrame, bins: int = 24, keys: Keys = ()) -> DataFrame:
    """Counts in equal bins from the smallest to the largest return; the last bin is closed."""
    ends = curve.groupBy(*keys).agg(F.min("net").alias("low"), F.max("net").alias("high"))
    joined = curve.join(ends, list(keys)) if keys else curve.crossJoin(F.broadcast(ends))  # one row of ends
    place = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("net") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)))).otherwise(0)
    return joined.groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def correlation(a: Column, b: Column) -> Column:
    """Correlation over the rows that have both; null where either doesn't vary."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(candidate: DataFrame, others: DataFrame, least: int = 10) -> DataFrame:
    """Correlation of the candidate's returns (date, net) with each other run (run, date, net) on common dates."""
    both = others.join(candidate.select("date", F.col("net").alias("own")), "date")
    return both.groupBy("run").agg(correlation(F.col("own"), F.col("net")).alias("rho"), F.count("*").alias("n_common")).filter(F.col("n_common") >= least)
