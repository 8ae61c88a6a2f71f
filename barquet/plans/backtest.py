"""A backtest as table operators: signal, lag, cap, costs, equity, trades.

Everything is keyed by the run's columns, so that many specs, folds and
parameter sets are scored by one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as w

Keys = tuple[str, ...]

#: Bps and share rates of one cash-equity cost model.
COSTS = {"stt_bps": 10.0, "stamp_bps": 1.5, "exchange_bps": 0.297, "sebi_bps": 0.01, "brokerage_bps": 3.0, "slippage_bps": 5.0, "gst_rate": 0.18, "funding_bps_day": 0.0}
#: Fixed value: what an unknown market pays a side, marked as a placeholder.
PLACEHOLDER_BPS = 25.0


def side_bps(c: dict[str, float] | None = None) -> Column:
    """Cost of one side in bps from the columns (or values) of a cost model."""
    x = (lambda n: F.lit(c[n])) if c else F.col
    taxed = x("brokerage_bps") + x("exchange_bps") + x("sebi_bps")
    return x("stt_bps") + x("stamp_bps") + x("exchange_bps") + x("sebi_bps") + x("brokerage_bps") + x("slippage_bps") + x("gst_rate") * taxed


def with_cost_model(frame: DataFrame, models: DataFrame) -> DataFrame:
    """``bps`` of (market, asset_class), or the placeholder where the pair is unknown. ``models``: one row a pair."""
    known = models.select("market", "asset_class", "bps")
    return frame.join(known, ["market", "asset_class"], "left").withColumns({"is_placeholder": F.col("bps").isNull(), "bps": F.coalesce("bps", F.lit(PLACEHOLDER_BPS))})


def lag_and_cap(frame: DataFrame, signal: str = "signal", keys: Keys = ()) -> DataFrame:
    """``weight``: yesterday's signal within -1 and 1, zero where nothing is
    listed, and scaled down where a date's gross weight is above 1."""
    own = (*keys, "instrument")
    raw = F.coalesce(F.lag(signal).over(w.by_bar(own)), F.lit(0.0))
    listed = F.when(F.col("close").isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    out = frame.withColumn("__w", listed)
    gross = F.sum(F.abs("__w")).over(Window.partitionBy(*keys, "date"))
    return out.withColumn("weight", F.when(gross > 1, F.col("__w") / gross).otherwise(F.col("__w"))).drop("__w")


def traded_split(frame: DataFrame, keys: Keys = ()) -> DataFrame:
    """``held, opened, closed``, signed; a flip closes all and opens all."""
    before = F.coalesce(F.lag("weight").over(w.by_bar((*keys, "instrument"))), F.lit(0.0))
    now, old = F.col("weight"), F.col("__before")
    held = F.when(now * old > 0, F.signum(now) * F.least(F.abs(now), F.abs(old))).otherwise(0.0)
    return frame.withColumn("__before", before).withColumn("held", held).withColumns({"opened": now - F.col("held"), "closed": old - F.col("held")}).drop("__before")


def fill_price(model: str = "bar_close", keys: Keys = ()) -> Column:
    own = (*keys, "instrument")
    if model == "bar_close":
        return w.shift(F.col("close"), 1, own)
    if model == "next_open":
        return F.col("open")
    if model == "vwap":
        return (F.col("high") + F.col("low") + F.col("close")) / 3
    raise ValueError(f"no fills by {model}")


def with_returns(frame: DataFrame, model: str = "bar_close", keys: Keys = ()) -> DataFrame:
    """``hold_ret`` (close to close), ``entry_ret`` (fill to close), ``exit_ret`` (close to fill)."""
    before = w.shift(F.col("close"), 1, (*keys, "instrument"))
    filled = frame.withColumns({"__fill": fill_price(model, keys), "__before": before})
    return filled.withColumns({"hold_ret": F.try_divide("close", "__before") - 1, "entry_ret": F.try_divide("close", "__fill") - 1, "exit_ret": F.try_divide("__fill", "__before") - 1}).drop("__fill", "__before")


def run(frame: DataFrame, bps: float | None = None, multiplier: float = 1.0, model: str = "bar_close", funding_bps: float = 0.0, keys: Keys = ()) -> DataFrame:
    """Bar by bar: ``weight, held, opened, closed, gross, cost, net``. A zero weight beats a missing return."""
    rate = side_bps(COSTS) if bps is None else F.lit(bps)
    out = with_returns(traded_split(lag_and_cap(frame, keys=keys), keys), model, keys)
    part = lambda q, r: F.when(F.col(q) == 0, 0.0).otherwise(F.coalesce(F.col(q) * F.col(r), F.lit(0.0)))
    gross = part("held", "hold_ret") + part("opened", "entry_ret") + part("closed", "exit_ret")
    traded = F.abs("opened") + F.abs("closed")
    cost = (traded * rate / 10_000 + F.abs("weight") * F.lit(funding_bps) / 10_000) * F.lit(multiplier)
    bad = sum(F.when((F.col(q) != 0) & F.col(r).isNull(), 1).otherwise(0) for q, r in (("held", "hold_ret"), ("opened", "entry_ret"), ("closed", "exit_ret")))
    return out.withColumns({"gross": gross, "cost": cost, "non_finite": bad}).withColumn("net", F.col("gross") - F.col("cost"))


def portfolio(bars: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row a date: sums over instruments; the first bar is dropped."""
    return bars.groupBy(*keys, "date", "bar_ix").agg(F.sum("gross").alias("gross"), F.sum("cost").alias("cost"), F.sum("net").alias("net"), F.sum(F.abs("weight")).alias("exposure")).filter("bar_ix > 0")


def growth(r: Column, over) -> Column:
    """Compounded growth. A return of -100 % or less ends at zero or changes the sign, as a product does."""
    return F.product(1 + r).over(over)


def equity(curve: DataFrame, keys: Keys = ()) -> DataFrame:
    """``equity, drawdown`` of a portfolio's net returns; a date's peak is the highest equity so far."""
    order = Window.partitionBy(*keys).orderBy("bar_ix") if keys else Window.partitionBy(F.lit(0)).orderBy("bar_ix")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out = curve.withColumn("equity", growth(F.col("net"), upto))
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(upto) - 1)


def turnover(bars: DataFrame, keys: Keys = ()) -> DataFrame:
    """Sum of weight changes, the first kept bar against zero, and the mean gross exposure."""
    kept = bars.filter("bar_ix > 0")
    before = F.coalesce(F.lag("weight").over(w.by_bar((*keys, "instrument"))), F.lit(0.0))
    moves = kept.withColumn("move", F.abs(F.col("weight") - before))
    by_date = moves.groupBy(*keys, "date").agg(F.sum("move").alias("move"), F.sum(F.abs("weight")).alias("gross"))
    return by_date.groupBy(*keys).agg(F.sum("move").alias("turnover"), F.avg("gross").alias("exposure"))


def islands(bars: DataFrame, keys: Keys = ()) -> DataFrame:
    """``side`` of each bar and ``island``, a number for each stretch on one side."""
    own = w.by_bar((*keys, "instrument"))
    sided = bars.withColumn("side", F.signum("weight"))
    changed = sided.withColumn("__new", (F.col("side") != F.coalesce(F.lag("side").over(own), F.lit(0.0))).cast("int"))
    return changed.withColumn("island", F.sum("__new").over(own)).drop("__new")


def trades(bars: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row a round trip. It ends at the first bar after it, or at the last bar if it is still open."""
    own = (*keys, "instrument")
    marked = islands(bars.filter("bar_ix > 0"), keys).withColumn("next_date", F.lead("date").over(w.by_bar(own)))
    out = marked.filter("side <> 0").groupBy(*own, "island", "side").agg(
        F.min("date").alias("entry_date"),
        F.max("date").alias("last_date"),
        F.max_by("next_date", "bar_ix").alias("after"),
        F.count("*").alias("bars_held"),
        F.avg(F.abs("weight")).alias("weight"),
        F.sum("gross").alias("gross_return"),
        F.sum("cost").alias("cost_return"),
        F.sum("net").alias("net_return"),
    )
    return out.select(*own, F.col("side").cast("int").alias("side"), "entry_date", F.coalesce("after", "last_date").alias("exit_date"), "bars_held", "weight", "gross_return", "cost_return", "net_return", F.col("after").isNull().alias("open_at_end"))


def trade_counts(bars: DataFrame, keys: Keys = ()) -> DataFrame:
    """Entries and profit of each instrument."""
    now = F.signum("weight")
    kept = bars.filter("bar_ix > 0")
    before = F.coalesce(F.lag(now).over(w.by_bar((*keys, "instrument"))), F.lit(0.0))
    marked = kept.withColumn("enters", (now != 0) & (now != before))
    return marked.groupBy(*keys, "instrument").agg(F.count_if("enters").alias("n_trades"), F.sum("net").alias("pnl"), F.count_if(F.col("weight") != 0).alias("bars_in"))


def holding_period(counts: DataFrame, bars: int) -> DataFrame:
    """Estimated bars a trade is held: between 1 and 60, or 5 without a trade."""
    return counts.withColumn("holding", F.when(F.col("n_trades") == 0, 5.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(60.0), F.lit(bars) / F.col("n_trades")))))


def cost_models(spark: SparkSession, rows: list[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "market string, asset_class string, bps double")
