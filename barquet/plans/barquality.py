"""Adjustment, universe membership and quality checks of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAG = "validator string, instrument string, date date, detail double"


def ratio(kind: Column, terms: Column) -> Column:
    """Price factor of an action: ``a:b`` splits to a/b, a bonus gives b/(a+b), a consolidation a/b."""
    a, b = F.split(terms, ":")[0].cast("double"), F.split(terms, ":")[1].cast("double")
    return F.when(kind.isin("split", "consolidation"), a / b).when(kind == "bonus", b / (a + b))


def dividend_ratio(price: Column, dividend: Column) -> Column:
    return F.when((price > 0) & (dividend < price), (price - dividend) / price)


def select_actions(actions: DataFrame, kinds: tuple[str, ...] = ("split", "bonus", "consolidation"), allow_unverified: bool = False) -> DataFrame:
    chosen = actions.filter(F.col("action_type").isin(*kinds))
    if not allow_unverified and not chosen.filter("verified_by IS NULL").isEmpty():
        raise ValueError("some actions are not verified")
    return chosen


def adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars times the product of ratios whose ex-date is after them; volume is divided by it.

    An instrument's actions are one array of its row, so bars don't multiply."""
    arrays = actions.groupBy("instrument").agg(F.collect_list(F.struct("ex_date", "ratio")).alias("actions"))
    joined = bars.join(arrays, "instrument", "left")
    later = F.filter("actions", lambda a: a["ex_date"] > F.col("date"))
    factor = F.coalesce(F.aggregate(later, F.lit(1.0), lambda p, a: p * a["ratio"]), F.lit(1.0))
    out = joined.withColumn("factor", factor).drop("actions")
    return out.withColumns({**{f: F.col(f) * F.col("factor") for f in ("open", "high", "low", "close")}, "volume": F.col("volume") / F.col("factor")})


def members(membership: DataFrame, day: str) -> DataFrame:
    """Members on a day; an interval holds its first day and not its last."""
    on = F.lit(day).cast("date")
    return membership.filter((F.col("effective_from") <= on) & (F.col("effective_to").isNull() | (F.col("effective_to") > on))).select("instrument").distinct()


def point_in_time(bars: DataFrame, membership: DataFrame) -> DataFrame:
    """Bars of dates on which the instrument was a member; intervals that overlap don't repeat a bar."""
    m = membership.select(F.col("instrument").alias("m_instrument"), "effective_from", "effective_to")
    inside = (F.col("date") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("date") < F.col("effective_to")))
    return bars.join(m, (F.col("instrument") == F.col("m_instrument")) & inside, "left_semi")


def overlaps(membership: DataFrame) -> DataFrame:
    """Intervals that begin before an earlier one of the instrument has ended."""
    order = Window.partitionBy("instrument").orderBy("effective_from")
    before = membership.withColumns({"prev_to": F.lag("effective_to").over(order), "prev_from": F.lag("effective_from").over(order)})
    return before.filter(F.col("prev_from").isNotNull() & (F.col("prev_to").isNull() | (F.col("prev_to") > F.col("effective_from")))).select("instrument", "effective_from", "prev_from")


def _flags(frame: DataFrame, validator: str, instrument: Column, date: Column, detail: Column) -> DataFrame:
    return frame.select(F.lit(validator).alias("validator"), instrument.alias("instrument"), date.cast("date").alias("date"), detail.cast("double").alias("detail"))


def _order():
    return Window.partitionBy("instrument").orderBy("date")


def unexplained_jumps(bars: DataFrame, actions: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Returns beyond the threshold with no action within a day."""
    change = bars.withColumn("change", F.col("close") / F.lag("close").over(_order()) - 1).filter(F.abs("change") > threshold)
    a = actions.select(F.col("instrument").alias("a_instrument"), "ex_date")
    odd = change.join(a, (F.col("instrument") == F.col("a_instrument")) & (F.abs(F.datediff("date", "ex_date")) <= 1), "left_anti")
    return _flags(odd, "unexplained_jump", F.col("instrument"), F.col("date"), F.col("change"))


def narrow_universe(bars: DataFrame, index_size: int) -> DataFrame:
    """Too few instruments were ever seen for the years covered; one alone is no universe."""
    seen = bars.agg(F.countDistinct("instrument").alias("n"), (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"))
    expected = 0.5 * (index_size + 2 * F.col("years")) + 0.5 * index_size
    return _flags(seen.filter((F.col("years") >= 3) & (F.col("n") > 1) & (F.col("n") < expected)), "universe_too_narrow", F.lit(None).cast("string"), F.lit(None), F.col("n"))


def zero_volume(bars: DataFrame, limit: float = 0.0) -> DataFrame:
    """Instruments with a larger share of bars with no or a negative volume than the limit; an unknown volume isn't one."""
    share = bars.groupBy("instrument").agg((F.count_if(F.col("volume") <= 0) / F.count("*")).alias("share"))
    return _flags(share.filter(F.col("share") > limit), "zero_volume", F.col("instrument"), F.lit(None), F.col("share"))


def stale_prices(bars: DataFrame, longest: int = 5) -> DataFrame:
    runs = bars.withColumn("new", F.coalesce((F.col("close") != F.lag("close").over(_order())).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(_order()))
    return _flags(runs.groupBy("instrument", "run").agg(F.count("*").alias("n"), F.min("date").alias("date")).filter(F.col("n") > longest), "stale_price", F.col("instrument"), F.col("date"), F.col("n"))


def gaps(bars: DataFrame, longest: int = 5) -> DataFrame:
    days = bars.withColumn("days", F.datediff("date", F.lag("date").over(_order()))).filter(F.col("days") > longest)
    return _flags(days, "gap", F.col("instrument"), F.col("date"), F.col("days"))


def validate(bars: DataFrame, actions: DataFrame, index_size: int = 5, jump: float = 0.3, zero_share: float = 0.0, stale: int = 5, gap: int = 5) -> DataFrame:
    out = unexplained_jumps(bars, actions, jump)
    for more in (narrow_universe(bars, index_size), zero_volume(bars, zero_share), stale_prices(bars, stale), gaps(bars, gap)):
        out = out.unionByName(more)
    return out


def snapshot_status(snapshots: DataFrame, flags: DataFrame) -> DataFrame:
    """``pending`` while a flag is, else ``invalid`` if one is a data error, else ``valid``. Flags: (snapshot_id, resolution)."""
    sums = flags.groupBy("snapshot_id").agg(F.count_if(F.col("resolution") == "pending").alias("pending"), F.count_if(F.col("resolution") == "data_error").alias("errors"))
    status = F.when(F.coalesce("pending", F.lit(0)) > 0, "pending").when(F.coalesce("errors", F.lit(0)) > 0, "invalid").otherwise("valid")
    return snapshots.join(sums, "snapshot_id", "left").withColumn("status", status).drop("pending", "errors")


#: What a flag may be resolved as.
RESOLUTIONS = ("genuine_move", "missing_action_added", "data_error")


def resolve(flags: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Flags (flag_id, resolution) with the newest verdict (flag_id, resolution,
    resolved_by, resolved_at) on each. A verdict of another kind, or by nobody, is an error."""
    odd = verdicts.filter(~F.coalesce(F.col("resolution").isin(*RESOLUTIONS), F.lit(False)) | (F.coalesce(F.trim("resolved_by"), F.lit("")) == ""))
    if not odd.isEmpty():
        raise ValueError(f"a flag is resolved as one of {RESOLUTIONS}, by a person")
    newest = latest(verdicts, ["flag_id"], [F.desc("resolved_at"), "resolution"]).select("flag_id", F.col("resolution").alias("__new"), "resolved_by", "resolved_at")
    return flags.join(newest, "flag_id", "left").withColumn("resolution", F.coalesce("__new", "resolution")).drop("__new")


def latest(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order: newest snapshot, latest evaluation, current bar."""
    return frame.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def outside_vault(bars: DataFrame, locked: DataFrame) -> DataFrame:
    """Bars that no locked range (instrument or null for all, from, to) touches."""
    return bars.join(locked.withColumnRenamed("instrument", "l_instrument"), (F.col("l_instrument").isNull() | (F.col("l_instrument") == F.col("instrument"))) & F.col("date").between(F.col("locked_from"), F.col("locked_to")), "left_anti")


def research_range(bars: DataFrame, months: int = 24) -> DataFrame:
    """Bars before the vault: the last months of the data."""
    end = bars.agg(F.date_add(F.add_months(F.max("date"), -months), 1).alias("vault_start"))
    return bars.crossJoin(F.broadcast(end)).filter("date < vault_start").drop("vault_start")  # one row
