"""Walk-forward: folds, parameter grids and train windows as keys of one frame."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..shared import written
from . import backtest
from .metrics import sharpe


def add_years(day: Column, years: int) -> Column:
    """The same day some years on; the 29th of February becomes the 28th."""
    return F.add_months(day, 12 * years)


def folds(span: DataFrame, train_years: list[int], test_years: int = 1, embargo_days: int = 0, least_embargo: int = 0) -> DataFrame:
    """``train_years, fold, train_start, train_end, test_start, test_end`` from a
    frame with one row (first, last): start, train, embargo in calendar days,
    test, on by a test's length, until a test would end after the data."""
    embargo = max(embargo_days, least_embargo)
    out = None
    for years in train_years:
        train_end, test_start = add_years(F.col("train_start"), years), F.date_add(add_years(F.col("train_start"), years), embargo)
        one = span.select("last", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.months_between("last", "first") / 12)).cast("int"))).alias("fold"), F.col("first"))
        one = one.withColumn("train_start", F.add_months("first", F.col("fold") * 12 * test_years)).select("last", F.lit(years).alias("train_years"), "fold", "train_start", train_end.alias("train_end"), test_start.alias("test_start"))
        one = one.withColumn("test_end", add_years(F.col("test_start"), test_years)).filter("test_end <= last").drop("last")
        out = one if out is None else out.union(one)
    return out


def grid(spark: SparkSession, space: dict[str, list[float]], most: int = 50, seed: int = 0) -> DataFrame:
    """``params_ix`` and one column a parameter: the product of the values. Of a
    larger product ``most`` places are drawn by a keyed hash, without listing it.
    A parameter of a node is named ``node.parameter``."""
    sizes = [len(v) for v in space.values()]
    every = math.prod(sizes)
    places, k = set(range(every)) if every <= most else set(), 0
    while len(places) < min(every, most):
        places.add(int(hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:13], 16) % every)
        k += 1
    rows = []
    for i in sorted(places):
        row, rest = [], i
        for values in reversed(list(space.values())):
            rest, at = divmod(rest, len(values))
            row.append(float(values[at]))
        rows.append((i, *reversed(row)))
    return spark.createDataFrame(rows, f"params_ix {'int' if every < 1 << 31 else 'long'}" + "".join(f", `{n}` double" for n in space))


def override(params: DataFrame, node: str, **defaults: float) -> dict[str, Column]:
    """The parameters of a spec's node: the grid's column ``node.parameter`` where it has one, else the default."""
    unknown = [x for x in params.columns if x.startswith(f"{node}.") and x[len(node) + 1 :] not in defaults]
    if unknown:
        raise ValueError(f"node {node} has no parameters {unknown}")
    return {n: F.col(f"`{node}.{n}`") if f"{node}.{n}" in params.columns else F.lit(v) for n, v in defaults.items()}


def slices(bars: DataFrame, fold_table: DataFrame) -> DataFrame:
    """Bars of each fold's train and test part, both ends included, with
    ``bar_ix`` counted anew: what is computed on a slice sees nothing before it."""
    parts = fold_table.select("train_years", "fold", F.explode(F.array(F.struct(F.lit("train").alias("part"), F.col("train_start").alias("a"), F.col("train_end").alias("z")), F.struct(F.lit("test").alias("part"), F.col("test_start").alias("a"), F.col("test_end").alias("z")))).alias("s")).select("train_years", "fold", "s.*")
    # Folds are few (years of data times train windows): a range join against a small side.
    joined = bars.join(F.broadcast(parts), F.col("date").between(F.col("a"), F.col("z"))).drop("a", "z")
    order = Window.partitionBy("train_years", "fold", "part", "instrument").orderBy("date")
    return joined.withColumn("bar_ix", F.row_number().over(order) - 1)


#: What tells runs of one walk-forward apart.
RUN = ("train_years", "fold", "part", "params_ix")
#: A rule turns slices and a table of parameters into bars of each run (keyed by RUN and instrument) with a ``signal``.
Rule = Callable[[DataFrame, DataFrame], DataFrame]


def crossover(lengths: list[int], fast: str = "fast", slow: str = "slow") -> Rule:
    """Moving-average crossovers whose lengths, all of them in ``lengths``, are
    two columns of the grid. Means are made once a length on the slices, before
    parameters multiply the bars."""

    def rule(sliced: DataFrame, params: DataFrame) -> DataFrame:
        means = sliced.withColumns({f"__mean{n}": w.rolling_mean(F.col("close"), n, (*RUN[:3], "instrument")) for n in lengths})
        runs = means.crossJoin(F.broadcast(params))  # at most the grid's bound of rows
        pick = lambda name: F.coalesce(*[F.when(F.col(f"`{name}`") == n, F.col(f"__mean{n}")) for n in lengths])
        gap = pick(fast) - pick(slow)
        return runs.withColumn("signal", F.when(gap > 0, 1.0).when(gap < 0, -1.0).when(gap == 0, 0.0)).select(*sliced.columns, "params_ix", "signal")

    return rule


def by_function(function: Callable[[pd.DataFrame, dict], pd.Series]) -> Rule:
    """A rule from ``function(bars, parameters) -> series``, called once for each
    run and instrument with its bars in order; missing values are no position."""

    def rule(sliced: DataFrame, params: DataFrame) -> DataFrame:
        names = {n: f"__p{k}" for k, n in enumerate(params.columns) if n != "params_ix"}  # a dot in a name means something to Spark

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bar_ix").reset_index(drop=True)
            bars = pdf.drop(columns=list(names.values()))
            signal = function(bars, {n: pdf[p].iloc[0] for n, p in names.items()})
            return bars.assign(signal=pd.Series(signal, index=pdf.index, dtype="float64"))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sliced.schema)
        plain = params.toDF(*[names.get(n, n) for n in params.columns])
        runs = sliced.crossJoin(F.broadcast(plain))  # at most the grid's bound of rows
        return runs.groupBy(*RUN, "instrument").applyInPandas(run, f"{fields}, params_ix {params.schema['params_ix'].dataType.simpleString()}, signal double")

    return rule


def run_returns(sliced: DataFrame, params: DataFrame, rule: Rule, bps: float = 10.0) -> DataFrame:
    """Net returns by (train_years, fold, part, params_ix, date) of any rule: all
    folds, windows and parameters in one job, written once, as tuning, testing and
    joining test windows all read them."""
    return written(_portfolios(rule(sliced, params), bps))


def _portfolios(runs: DataFrame, bps: float) -> DataFrame:
    """Runs are dealt by their keys once, which then serves every window and sum of the backtest."""
    return backtest.portfolio(backtest.run(runs.repartition(*RUN), bps=bps, keys=RUN), RUN)


def campaign(bars: DataFrame, params: DataFrame, rule: Rule, train_years: list[int], periods: float, embargo_days: int = 7, bps: float = 10.0) -> DataFrame:
    """Many specs at once: each row of ``params`` is a spec of its own, scored out
    of sample over every fold of each train window; the best of its windows, the
    shortest of equals, is its score. One row a spec."""
    span = bars.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    tests = slices(bars, folds(span, train_years, 1, embargo_days)).filter("part = 'test'")
    net = _portfolios(rule(tests, params), bps)
    scores = net.groupBy("params_ix", "train_years").agg(sharpe(F.col("net"), periods).alias("sharpe"), F.count("*").alias("n_bars"), F.sum("net").alias("total"), F.countDistinct("fold").alias("n_folds"))
    best = F.max_by(F.struct("train_years", "sharpe", "n_bars", "total", "n_folds"), F.struct(F.round("sharpe", 9), -F.col("train_years")))
    return scores.groupBy("params_ix").agg(best.alias("best"), (F.max("sharpe") - F.min("sharpe")).alias("spread")).select("params_ix", "best.*", "spread")


def tuned(returns: DataFrame, periods: float) -> DataFrame:
    """Each fold's parameters with the best train Sharpe to nine digits, so that the order of sums doesn't decide; the first wins ties."""
    scores = returns.filter("part = 'train'").groupBy("train_years", "fold", "params_ix").agg(sharpe(F.col("net"), periods).alias("train_sharpe"), F.count("*").alias("train_bars"))
    best = Window.partitionBy("train_years", "fold").orderBy(F.desc(F.round("train_sharpe", 9)), "params_ix")
    return scores.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")


def fold_results(returns: DataFrame, periods: float, least_train: int = 30, least_test: int = 5) -> DataFrame:
    """``train_years, fold, params_ix, train_sharpe, test_sharpe, test_return, test_bars``; folds with too few bars go."""
    best = tuned(returns, periods)
    test = returns.filter("part = 'test'").groupBy("train_years", "fold", "params_ix").agg(sharpe(F.col("net"), periods).alias("test_sharpe"), F.sum("net").alias("test_return"), F.count("*").alias("test_bars"))
    return best.join(test, ["train_years", "fold", "params_ix"]).filter((F.col("train_bars") >= least_train) & (F.col("test_bars") >= least_test))


def out_of_sample(returns: DataFrame, results: DataFrame) -> DataFrame:
    """The chosen parameters' test returns: all folds of a train window in a row."""
    return returns.filter("part = 'test'").join(results.select("train_years", "fold", "params_ix"), ["train_years", "fold", "params_ix"])


def window_scores(returns: DataFrame, results: DataFrame, periods: float) -> DataFrame:
    """One row a train window: its Sharpe out of sample, efficiency, profitable folds and their spread."""
    oos = out_of_sample(returns, results).groupBy("train_years").agg(sharpe(F.col("net"), periods).alias("sharpe"), F.count("*").alias("n_bars"), F.sum("net").alias("total"))
    by_fold = results.groupBy("train_years").agg(
        F.coalesce(F.when(F.avg("train_sharpe") != 0, F.avg("test_sharpe") / F.avg("train_sharpe")), F.lit(0.0)).alias("efficiency"),
        F.count_if(F.col("test_return") > 0).alias("folds_profitable"),
        F.count("*").alias("n_folds"),
    )
    return oos.join(by_fold, "train_years")


def best_window(scores: DataFrame) -> DataFrame:
    """The train window with the highest Sharpe, the shortest of equals, and the spread of all."""
    top = F.max(F.struct("sharpe", (-F.col("train_years")).alias("y")))
    return scores.agg((-top["y"]).alias("train_years"), top["sharpe"].alias("sharpe"), (F.max("sharpe") - F.min("sharpe")).alias("spread"))


def stability(results: DataFrame) -> DataFrame:
    """Diagnostics over folds: mean, deviation, worst, folds above 0 and 1, decay from the first to the last three."""
    first = F.row_number().over(Window.partitionBy("train_years").orderBy("fold"))
    last = F.row_number().over(Window.partitionBy("train_years").orderBy(F.desc("fold")))
    ranked = results.withColumns({"a": first, "z": last})
    s = F.col("test_sharpe")
    return ranked.groupBy("train_years").agg(
        F.avg(s).alias("mean"),
        F.stddev_pop(s).alias("std"),
        F.min(s).alias("worst"),
        F.count_if(s > 0).alias("above_0"),
        F.count_if(s > 1).alias("above_1"),
        (F.avg(F.when(F.col("z") <= 3, s)) - F.avg(F.when(F.col("a") <= 3, s))).alias("decay"),
    )
