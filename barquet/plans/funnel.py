"""Many specs through the phases of one evaluation, each phase over the survivors of those before."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..operators import specs
from ..shared import apart, written
from . import backtest, checks, compiled, regimes, walkforward
from .metrics import sharpe
from .stats import honest_scores, moments

BARS = ("date", "open", "high", "low", "close", "volume")
SPEC = ("spec_id",)


@dataclasses.dataclass(frozen=True)
class Settings:
    """What a campaign asks of a spec; a limit that is None only warns (``checks.check_row``)."""

    periods: float = 252
    train_years: tuple[int, ...] = (1, 2, 3)
    embargo_days: int = 7
    bps: float | None = None
    multiplier: float = 1.0
    most_nodes: int | None = None
    first_trades: int = 5
    least_trades: int = 30
    most_drawdown: float = 0.15
    least_breadth: float | None = None
    least_score: float | None = None
    trials: int = 3
    cuts: tuple[float, ...] = checks.CUTS


@dataclasses.dataclass(frozen=True)
class Report:
    """``evaluations``: a row a spec; ``tests``: its check rows; ``regimes``: results by market regime of the specs that came to p3."""

    evaluations: DataFrame
    tests: DataFrame
    regimes: DataFrame


def _held_back(tests: DataFrame, phase: str, reason: Column) -> DataFrame:
    """The specs that a phase stops: its first failing check, in the checks' order, gives the reason."""
    failed = tests.filter("outcome = 'fail'").groupBy("spec_id").agg(F.min_by("test_name", "place").alias("failed_on"))
    return failed.select("spec_id", F.lit(phase).alias("phase"), "failed_on", reason.alias("reason"))


def _rows(frame: DataFrame, rows: list[Column]) -> DataFrame:
    made = F.posexplode(F.array(*rows)).alias("place", "c")
    return frame.select("spec_id", made).select("spec_id", "place", "c.*")


def _alike(held: DataFrame) -> DataFrame:
    """``spec_id, __of``: the smallest id of the specs with the same roots in every role."""
    named = written(specs.roots(held, SPEC).select("spec_id", F.sha2(F.to_json(F.struct(*specs.ROLES)), 256).alias("roots")))
    return named.join(named.groupBy("roots").agg(F.min("spec_id").alias("__of")), "roots").select("spec_id", "__of")


def _runs(bars: DataFrame, held: DataFrame, s: Settings, keys: tuple[str, ...] = (), bps: float | None = None) -> DataFrame:
    signals = compiled.signals_of(bars, held, SPEC, (*keys, "instrument"), BARS)
    return backtest.run(signals.repartition("spec_id", *keys), bps=bps, multiplier=s.multiplier, keys=(*SPEC, *keys))


def _truncated(bars: DataFrame, held: DataFrame, s: Settings, tolerance: float = 1e-9) -> DataFrame:
    """``spec_id, n_differ``: bars whose signal changes when the history ends early; all cuts are runs of one job."""
    size = bars.groupBy("instrument").agg(F.count("*").alias("__n"))
    cut = bars.join(F.broadcast(size), "instrument").withColumn("cut", F.explode(F.array(*map(F.lit, (*s.cuts, 1.0)))))  # a row an instrument
    cut = cut.withColumn("__end", F.floor(F.col("__n") * F.col("cut"))).filter((F.col("bar_ix") < F.col("__end")) & (F.col("__end") >= checks.LEAST_BARS))
    got = compiled.signals_of(cut.drop("__n", "__end"), held, SPEC, ("cut", "instrument"), ())
    got = got.join(F.broadcast(size), "instrument").filter((F.col("cut") == 1.0) | (F.col("bar_ix") < F.floor(F.col("__n") * F.col("cut")) - checks.KEEP_LAST))
    spread = got.groupBy("spec_id", "instrument", "bar_ix").agg((F.max("signal") - F.min("signal")).alias("d"))
    return spread.groupBy("spec_id").agg(F.count_if(F.col("d") > tolerance).alias("n_differ"))


def evaluate(bars: DataFrame, nodes: DataFrame, settings: Settings = Settings(), until: str = "p3") -> Report:
    """Every spec of ``nodes`` (``operators.specs.SCHEMA``) through the funnel over
    ``bars`` (instrument, bar_ix and BARS).

    bar: no more nodes than asked for (``plateaued_below_bar``). p0: the spec
    holds (``code_error``) and signals don't change when the history ends early
    (``look_ahead_detected``). p1: some trades over the last quarter at no cost
    (``no_signal``). p2: a profit before and after costs over the whole history
    (``negative_expectancy``, ``costs_exceed_edge``). p3: out of sample over the
    folds of every train window, the best window's run against the bar
    (``checks.FAILURES``) and its honest score (``deflated_sharpe_insufficient``).

    Each phase reads the specs alone that all phases before let through: they
    are taken from a written table, and stopped specs are not evaluated again.
    Specs with the same roots have the same signals: the one with the smallest id
    is evaluated, and its results are those of all of them.
    With ``until`` p2 the survivors of p2 are told as come to p3, unscored.
    """
    s = settings
    stopped, tests = [], []

    def close(found: DataFrame, phase: str, reason: Column) -> DataFrame:
        found = written(found.withColumn("phase", F.lit(phase)))
        tests.append(found)
        stopped.append(written(_held_back(found, phase, reason)))
        return stopped[-1].select("spec_id")

    named = F.col("failed_on")
    every = nodes.select("spec_id").distinct()
    size = nodes.groupBy("spec_id").agg(F.count_distinct("node").alias("nodes"))
    gone = close(_rows(size, [checks.complexity_check(s.most_nodes)]), "bar", F.lit("plateaued_below_bar"))
    held, problems = specs.structure(nodes.join(gone, "spec_id", "left_anti"), SPEC)
    bad = problems.groupBy("spec_id").agg(F.count("*").alias("n"))
    left = every.join(gone, "spec_id", "left_anti").join(bad, "spec_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    alike = written(_alike(held))
    held = written(held.join(apart(alike.filter("spec_id = __of").select("spec_id")), "spec_id", "left_semi"))

    def each(found: DataFrame) -> DataFrame:
        """The rows of a spec for all that are like it."""
        return alike.join(apart(found.withColumnRenamed("spec_id", "__of")), "__of").select(*found.columns)

    holds = _rows(left, [checks.check_row("p0_spec_holds", "correctness", F.col("n") == 0, F.col("n"), F.lit(0.0))])
    if not held.isEmpty():
        same = _rows(_truncated(bars, held, s), [checks.check_row("p0_truncation_invariance", "correctness", F.col("n_differ") == 0, F.col("n_differ"), F.lit(0.0))])
        holds = holds.unionByName(each(same.withColumn("place", F.lit(1))))
    gone = close(holds, "p0", F.when(named.contains("truncation"), "look_ahead_detected").otherwise("code_error"))
    held = written(held.join(gone, "spec_id", "left_anti"))

    if not held.isEmpty():
        trades = backtest.trade_counts(_runs(checks.last_quarter(bars), held, s, bps=0.0), SPEC).groupBy("spec_id").agg(F.sum("n_trades").alias("n"))
        gone = close(each(_rows(trades, [checks.check_row("p1_any_signal", "performance", F.col("n") >= s.first_trades, F.col("n"), F.lit(float(s.first_trades)))])), "p1", F.lit("no_signal"))
        held = written(held.join(gone, "spec_id", "left_anti"))
    whole = None
    if not held.isEmpty():
        whole = written(_runs(bars, held, s, bps=s.bps))
        sums = backtest.portfolio(whole, SPEC).groupBy("spec_id").agg(F.sum("gross").alias("g"), F.sum("net").alias("n"))
        found = _rows(sums, [checks.check_row("p2_gross_expectancy", "performance", F.col("g") > 0, F.col("g"), F.lit(0.0)), checks.check_row("p2_cost_survival", "cost", F.col("n") > 0, F.col("n"), F.lit(0.0))])
        gone = close(each(found), "p2", F.when(named == "p2_gross_expectancy", "negative_expectancy").otherwise("costs_exceed_edge"))
        held = written(held.join(gone, "spec_id", "left_anti"))
    scores = by_regime = None
    if until == "p3" and not held.isEmpty():
        scores, curves = _out_of_sample(bars, held, whole.join(held.select("spec_id").distinct(), "spec_id", "left_semi"), s)
        bar = [*checks.bar_checks(s.least_trades, s.most_drawdown, s.least_breadth), checks.check_row("min_score", "performance", F.col("score") >= F.lit(s.least_score), F.col("score"), F.lit(s.least_score).cast("double"))]
        reasons = F.create_map(*[F.lit(x) for pair in {**checks.FAILURES, "min_score": "deflated_sharpe_insufficient"}.items() for x in pair])
        close(each(_rows(scores, bar)), "p3", F.try_element_at(reasons, named))
        labels = regimes.label(regimes.market_returns(bars.withColumn("ret", w.simple_return(F.col("close")))))
        by_regime = each(regimes.by_regime(curves, labels, s.periods, SPEC))
        scores = each(scores)
    end = stopped[0]
    for more in stopped[1:]:
        end = end.unionByName(more)
    out = every.join(end, "spec_id", "left").select("spec_id", F.coalesce("phase", F.lit("p3")).alias("phase"), F.when(F.col("phase").isNull(), "passed" if until == "p3" else "open").otherwise("failed").alias("outcome"), "failed_on", "reason")
    fields = "train_years int, n_folds long, sharpe double, total double, max_drawdown double, n_trades long, breadth double, score double"
    if scores is None:
        spark = nodes.sparkSession
        scores = spark.createDataFrame([], f"spec_id {nodes.schema['spec_id'].dataType.simpleString()}, {fields}")
        by_regime = spark.createDataFrame([], f"spec_id {nodes.schema['spec_id'].dataType.simpleString()}, regime string, sharpe double, total double, max_drawdown double, first_date date, last_date date, n_bars long")
    out = out.join(scores, "spec_id", "left")
    rows = tests[0]
    for more in tests[1:]:
        rows = rows.unionByName(more)
    return Report(written(out), rows.drop("place"), by_regime)


def _out_of_sample(bars: DataFrame, held: DataFrame, whole: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """``spec_id, train_years, n_folds, sharpe, total, max_drawdown, n_trades, breadth,
    score`` of each spec's best train window (of equal ones the shortest), and
    its test returns ``spec_id, bar_ix, date, net``, all folds in a row."""
    span = bars.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    tests = walkforward.slices(bars, walkforward.folds(span, list(s.train_years), 1, s.embargo_days)).filter("part = 'test'")
    keys = ("train_years", "fold")
    runs = written(_runs(tests, held, s, keys, bps=s.bps))
    net = backtest.portfolio(runs, (*SPEC, *keys))
    by_window = net.groupBy("spec_id", "train_years").agg(sharpe(F.col("net"), s.periods).alias("sharpe"), F.sum("net").alias("total"), F.count_distinct("fold").alias("n_folds"))
    best = written(by_window.groupBy("spec_id").agg(F.max_by(F.struct("train_years", "sharpe", "total", "n_folds"), F.struct(F.round("sharpe", 9), -F.col("train_years"))).alias("b")).select("spec_id", "b.*"))
    mine = net.join(best.select("spec_id", "train_years"), ["spec_id", "train_years"])
    curve = written(mine.select("spec_id", F.row_number().over(Window.partitionBy("spec_id").orderBy("date", "fold")).alias("bar_ix"), "date", "net"))
    down = backtest.equity(curve, SPEC).groupBy("spec_id").agg((-F.min("drawdown")).alias("max_drawdown"))
    trades = backtest.trade_counts(runs.join(best.select("spec_id", "train_years"), ["spec_id", "train_years"]), (*SPEC, *keys)).groupBy("spec_id").agg(F.sum("n_trades").alias("n_trades"))
    wide = checks.breadth(backtest.trade_counts(whole, SPEC), ["spec_id"])
    scored = honest_scores(moments(curve, SPEC, periods=s.periods).withColumn("trials", F.lit(s.trials))).select("spec_id", F.col("honest").alias("score"))
    out = best
    for part in (down, trades, wide, scored):
        out = out.join(part, "spec_id", "left")
    return written(out.withColumn("breadth", F.coalesce("breadth", F.lit(0.0)))), curve
