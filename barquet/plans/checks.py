"""Checks, the bar a run must clear, and the funnel that stops at the first failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import correlation


def check_row(name: str, category: str, ok: Column, value: Column, threshold: Column) -> Column:
    """One check. A null threshold isn't set: the value is measured, and the outcome a warning."""
    outcome = F.when(threshold.isNull(), "warn").when(ok, "pass").otherwise("fail")
    return F.struct(F.lit(name).alias("test_name"), F.lit(category).alias("category"), outcome.alias("outcome"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold"))


def as_rows(frame: DataFrame, keys: list[str], checks: list[Column]) -> DataFrame:
    return frame.select(*keys, F.explode(F.array(*checks)).alias("c")).select(*keys, "c.*")


#: Shares of the history after which it is cut off, bars before a cut that may differ, fewest bars.
CUTS, KEEP_LAST, LEAST_BARS = (0.5, 0.7, 0.85), 5, 10


def truncations(bars: DataFrame, signal: Callable[[DataFrame], Column], cuts: tuple[float, ...] = CUTS, tolerance: float = 1e-9) -> DataFrame:
    """``cut, instrument, n_differ, n``: bars whose signal changes when the history
    ends after a share of its bars. ``signal`` makes the signal's column, with
    windows by instrument. All cuts are runs of one job: a cut's instrument has a name of its own."""
    size = bars.groupBy("instrument").agg(F.count("*").alias("__all"))
    shares = F.explode(F.array(*map(F.lit, cuts))).alias("cut")
    cut = bars.join(size, "instrument").select("*", shares).withColumn("__end", F.floor(F.col("__all") * F.col("cut"))).filter((F.col("bar_ix") < F.col("__end")) & (F.col("__end") >= LEAST_BARS))
    cut = cut.withColumnRenamed("instrument", "__own").withColumn("instrument", F.concat_ws("|", "cut", "__own"))
    cut = cut.withColumn("value", signal(cut)).select("cut", F.col("__own").alias("instrument"), "bar_ix", "value", "__end").filter(F.col("bar_ix") < F.col("__end") - KEEP_LAST)
    whole = bars.withColumn("whole", signal(bars)).select("instrument", "bar_ix", "whole")
    differ = F.coalesce(F.abs(F.col("whole") - F.col("value")) > tolerance, F.col("whole").isNull() != F.col("value").isNull())
    return cut.join(whole, ["instrument", "bar_ix"]).groupBy("cut", "instrument").agg(F.count_if(differ).alias("n_differ"), F.count("*").alias("n"))


def last_quarter(bars: DataFrame, share: float = 0.75) -> DataFrame:
    """The bars from that share of each instrument's history on, counted anew."""
    size = bars.groupBy("instrument").agg(F.count("*").alias("__n"))
    first = F.floor(F.col("__n") * share)
    return bars.join(size, "instrument").filter(F.col("bar_ix") >= first).withColumn("bar_ix", F.col("bar_ix") - first).drop("__n")


#: Order in which failures of the bar are named, and the reason of an experiment each stands for.
FAILURES = {"min_trades": "insufficient_trades", "max_drawdown": "monte_carlo_ruin_risk", "cost_stress": "costs_exceed_edge", "breadth": "capacity_constrained"}


def bar_checks(least_trades: int = 30, most_drawdown: float = 0.15, least_breadth: float | None = None, most_nodes: int | None = None) -> list[Column]:
    """Checks of a run (n_trades, max_drawdown, total, breadth and, if asked for, nodes) against its bar. What isn't set only warns."""
    out = [
        check_row("min_trades", "performance", F.col("n_trades") >= least_trades, F.col("n_trades"), F.lit(least_trades)),
        check_row("max_drawdown", "performance", F.col("max_drawdown") <= most_drawdown, F.col("max_drawdown"), F.lit(most_drawdown)),
        check_row("cost_stress", "cost", F.col("total") > 0, F.col("total"), F.lit(0.0)),
        check_row("breadth", "performance", F.col("breadth") >= F.lit(least_breadth), F.col("breadth"), F.lit(least_breadth).cast("double")),
    ]
    return out + [complexity_check(most_nodes)] if most_nodes is not None else out


def complexity_check(most_nodes: int | None = None) -> Column:
    return check_row("complexity", "correctness", F.col("nodes") <= F.lit(most_nodes), F.col("nodes"), F.lit(most_nodes).cast("double"))


def bar_verdict(runs: DataFrame, least_trades: int = 30, most_drawdown: float = 0.15, least_breadth: float | None = None) -> DataFrame:
    """``failures`` in a fixed order, the first one, the reason it stands for, and whether the run passed."""
    failed = F.transform(F.filter(F.array(*bar_checks(least_trades, most_drawdown, least_breadth)), lambda c: c["outcome"] == "fail"), lambda c: c["test_name"])
    reasons = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    out = runs.withColumn("failures", failed).withColumn("first_failure", F.get("failures", F.lit(0))).withColumn("passed", F.size("failures") == 0)
    return out.withColumn("reason", F.try_element_at(reasons, F.col("first_failure")))


def breadth(pnl: DataFrame, keys: list[str]) -> DataFrame:
    """Share of traded instruments with a profit."""
    return pnl.filter("n_trades > 0").groupBy(*keys).agg((F.count_if(F.col("pnl") > 0) / F.count("*")).alias("breadth"))


def worst_outcome(checks: DataFrame, keys: list[str]) -> DataFrame:
    rank = F.when(F.col("outcome") == "fail", 2).when(F.col("outcome") == "warn", 1).otherwise(0)
    return checks.groupBy(*keys).agg(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.max(rank) + 1).alias("worst"))


def capacity(bars: DataFrame, capital: float) -> DataFrame:
    """Largest share of a bar's traded value that a weight change would take; 0 where nothing trades."""
    move = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(Window.partitionBy("instrument").orderBy("bar_ix")), F.lit(0.0)))
    traded = F.col("close") * (F.col("volume") if "volume" in bars.columns else F.lit(None).cast("double"))
    share = F.when(traded > 0, F.col("move") * capital / traded).otherwise(0.0)
    return bars.withColumn("move", move).groupBy("instrument").agg(F.max(share).alias("capacity"))


def equities_gate(bars: DataFrame, capital: float, cap: float | None, hazard: bool, handled: bool) -> DataFrame:
    """Survivorship, a warning where the market has no such hazard, and the
    largest share of a bar's traded value against the market's cap; a warning
    without a value where no bar has a volume."""
    worst = capacity(bars, capital).agg(F.coalesce(F.max("capacity"), F.lit(0.0)).alias("worst"))
    known = bars.agg((F.count("volume") > 0).alias("known")) if "volume" in bars.columns else worst.select(F.lit(False).alias("known"))
    worst = worst.crossJoin(F.broadcast(known)).withColumn("worst", F.when(F.col("known"), F.col("worst")))  # a row each
    survivorship = check_row("equities_survivorship", "correctness", F.lit(handled), F.lit(None), F.lit(0.0 if hazard else None).cast("double"))
    return as_rows(worst, [], [survivorship, check_row("equities_capacity", "performance", F.col("worst") <= F.lit(cap), F.col("worst"), F.when(F.col("known"), F.lit(cap).cast("double")))])


#: Multiples of funding, least correlation with a second venue and common bars for it, largest share of a session.
FUNDING, LEAST_CORRELATION, LEAST_COMMON, MOST_SESSION = (1.0, 2.0, 3.0, 5.0), 0.5, 10, 0.80


def funding_sweep(curve: DataFrame, multiples: tuple[float, ...] = FUNDING) -> DataFrame:
    sums = curve.agg(F.sum("gross").alias("g"), F.sum("cost").alias("c"))
    return sums.select("g", "c", F.explode(F.array(*map(F.lit, multiples))).alias("multiple")).select("multiple", (F.col("g") - F.col("multiple") * F.col("c")).alias("net"), (F.col("g") - F.col("multiple") * F.col("c") > 0).alias("survives"))


def crypto_gate(bars: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """From bars with (gross, cost, funding) by date: the largest multiple of funding, none failing before
    it, that leaves a profit after costs; and the correlation of net returns with those of a second
    venue (date, net), the last bars of both side by side."""
    sums = bars.agg(F.sum(F.col("gross") - F.col("cost")).alias("base"), F.sum("funding").alias("f"))
    first_bad = F.coalesce(*[F.when(F.col("base") - m * F.col("f") <= 0, F.lit(i)) for i, m in enumerate(FUNDING)], F.lit(len(FUNDING)))
    survives = sums.select(F.get(F.array(F.lit(0.0), *map(F.lit, FUNDING)), first_bad).alias("survives"))
    out = as_rows(survives, [], [check_row("crypto_funding_sensitivity", "cost", F.col("survives") >= FUNDING[0], F.col("survives"), F.lit(FUNDING[0]))])
    if second is None:
        return out.union(as_rows(survives, [], [check_row("crypto_venue_robustness", "robustness", F.lit(True), F.lit(None), F.lit(None).cast("double"))]))
    mine = bars.groupBy("date").agg((F.sum("gross") - F.sum("cost") - F.sum("funding")).alias("net"))
    from_end = lambda frame, name: frame.select(F.row_number().over(Window.orderBy(F.desc("date"))).alias("k"), F.col("net").alias(name))
    both = from_end(mine, "a").join(from_end(second, "b"), "k").agg(F.coalesce(correlation(F.col("a"), F.col("b")), F.lit(0.0)).alias("rho"), F.count("*").alias("n"))
    enough = F.when(F.col("n") >= LEAST_COMMON, F.lit(LEAST_CORRELATION))
    return out.union(as_rows(both, [], [check_row("crypto_venue_robustness", "robustness", F.col("rho") >= LEAST_CORRELATION, F.col("rho"), enough)]))


def session_shares(pnl: DataFrame, ts: str = "ts", value: str = "pnl") -> DataFrame:
    """Profit of each third of the day, and its share of the sizes of all three."""
    by = pnl.groupBy(F.floor((F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 28_800).cast("int").alias("session")).agg(F.sum(value).alias("total"))
    all_of = F.sum(F.abs("total")).over(Window.partitionBy(F.lit(0)))  # three rows
    return by.withColumn("share", F.when(all_of > 0, F.abs("total") / all_of).otherwise(0.0))


def forex_gate(pnl: DataFrame, ts: str = "ts", value: str = "pnl", carry: str = "carry", intraday: bool = True, funded: bool = True) -> DataFrame:
    """The largest session's share, not asked of daily bars, and carry as a share of
    gross profit, which never fails; where no funding rate is declared (``funded``) it only warns."""
    worst = session_shares(pnl, ts, value).agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("worst"))
    carried = pnl.agg(F.coalesce(F.try_divide(F.sum(F.abs(carry)), F.sum(F.abs(value))), F.lit(0.0)).alias("carried"))
    out = as_rows(worst, [], [check_row("forex_session_dependence", "regime", F.col("worst") <= MOST_SESSION, F.col("worst"), F.lit(MOST_SESSION if intraday else None).cast("double"))])
    return out.union(as_rows(carried, [], [check_row("forex_carry_decomposition", "cost", F.lit(True), F.col("carried"), F.lit(0.0 if funded else None).cast("double"))]))


def funnel(runs: DataFrame) -> DataFrame:
    """The first phase that stops a run, and why."""
    stop = (
        F.when(F.col("n_trades") < 5, F.struct(F.lit("p1").alias("phase"), F.lit("too few trades").alias("reason")))
        .when(F.col("gross") <= 0, F.struct(F.lit("p2").alias("phase"), F.lit("no gross profit").alias("reason")))
        .when(F.col("net") <= 0, F.struct(F.lit("p2").alias("phase"), F.lit("costs take the profit").alias("reason")))
        .otherwise(F.struct(F.lit("p3").alias("phase"), F.lit(None).cast("string").alias("reason")))
    )
    return runs.withColumn("stop", stop).withColumns({"phase": F.col("stop.phase"), "reason": F.col("stop.reason")}).drop("stop")


def ratchet(scored: DataFrame, key: str, order: str, floor: float) -> DataFrame:
    """Kept only if above the best kept before, or at the floor if there is none. The best
    kept before is the best score before, once that reaches the floor."""
    before = F.max("score").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    best = F.when(before >= floor, before)
    return scored.withColumn("best_before", best).withColumn("kept", F.when(best.isNull(), F.col("score") >= floor).otherwise(F.col("score") > best))
