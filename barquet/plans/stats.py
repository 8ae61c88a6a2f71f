"""Selection-aware statistics of many runs at once."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

EULER = 0.5772156649015329
#: Fixed value: standard errors that the honest score takes off.
Z = 1.65
#: Fixed value: each experiment reports the best of three train windows.
WINDOWS_A_TRIAL = 3


def moments(returns: DataFrame, keys: tuple[str, ...], r: str = "net", periods: float = 1.0) -> DataFrame:
    """``n, sr`` (Sharpe, of a year with ``periods`` bars), and unbiased ``skew, kurt``
    (3 for a normal); 0 and 3 for a series that is flat or of fewer than 4 bars."""
    m = returns.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"), F.avg(F.abs(r)).alias("size"))
    n = F.col("n").cast("double")
    shaped = (n > 3) & (F.col("std") > 1e-9 * F.greatest(F.col("size"), F.lit(1.0)))
    return m.withColumns(
        {
            "sr": F.coalesce(F.when(F.col("std") > 0, F.col("mean") / F.col("std") * F.sqrt(F.lit(float(periods)))), F.lit(0.0)),
            "skew": F.coalesce(F.when(shaped, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)), F.lit(0.0)),
            "kurt": F.coalesce(F.when(shaped, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6) + 3), F.lit(3.0)),
        }
    ).drop("g1", "g2", "size")


def se_sharpe(sr: Column, n: Column, skew: Column, kurt: Column) -> Column:
    inner = F.greatest(F.lit(0.0), 1 + sr * sr / 2 - skew * sr + (kurt - 3) / 4 * sr * sr)
    return F.when(n > 1, F.sqrt(inner / n)).otherwise(F.lit(math.inf))


#: Coefficients of the normal quantile's rational approximations (Wichura, AS 241, PPND16):
#: numerator and denominator in the middle, in the tails and far out.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: Column) -> Column:
    """The standard normal's quantile for 0 < p < 1."""

    def ratio(parts: tuple, x: Column) -> Column:
        up, down = (sum((F.lit(c) * F.pow(x, F.lit(i)) for i, c in enumerate(some)), F.lit(0.0)) for some in parts)
        return up / down

    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(TAIL, r - 1.6)).otherwise(ratio(FAR, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * ratio(MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def normal_share(z: Column, terms: int = 160) -> Column:
    """The standard normal's distribution function, by the series of positive terms z (2k)!! ... / (2k+1)!!; beyond nine deviations 0 or 1."""
    x = F.abs(F.greatest(F.lit(-9.0), F.least(F.lit(9.0), z)))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(x.alias("term"), x.alias("sum")),
        lambda s, k: F.struct((s["term"] * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * x * x / (2 * k + 1)).alias("sum")),
        lambda s: s["sum"],
    )
    return 0.5 + F.signum(z) * series * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def haircut_factor(trials: Column) -> Column:
    """Expected largest of so many standard normal draws; 0 for one or none."""
    n = F.greatest(trials, F.lit(2)).cast("double")
    return F.when(trials > 1, (1 - EULER) * normal_quantile(1 - 1 / n) + EULER * normal_quantile(1 - 1 / (n * math.e))).otherwise(0.0)


def family_trials(prior: Column, iterations: Column) -> Column:
    """Earlier trials of the family and this one's iterations, each with its train windows."""
    return F.greatest(prior + iterations, F.lit(1)) * WINDOWS_A_TRIAL


def honest_scores(m: DataFrame, z: float = Z) -> DataFrame:
    """Of runs with ``sr`` (of a year), ``n, skew, kurt`` and ``trials``: ``se``,
    ``haircut``, ``honest = sr - z * se - haircut``, and ``deflated``, the chance
    that the Sharpe beats the best of so many trials without an edge. A run of
    fewer than 4 bars or without an error has 0 there; one of a single bar has
    no finite error, and no haircut."""
    out = m.withColumn("se", se_sharpe(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt")))
    out = out.withColumn("haircut", F.when(F.col("n") > 1, F.col("se") * haircut_factor(F.col("trials"))).otherwise(0.0))
    out = out.withColumn("honest", F.col("sr") - z * F.col("se") - F.col("haircut"))
    known = (F.col("n") >= 4) & (F.col("se") > 0)
    return out.withColumn("deflated", F.when(known, normal_share(F.try_divide(F.col("sr") - F.col("haircut"), F.col("se")))).otherwise(0.0))


def uniform(*what: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the seed and labels alone, however Spark deals the rows: 52 bits of a hash of their texts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *what)), 1, 13), 16, 10).cast("long") * F.lit(2.0**-52)


def _fresh(labels: list[str], block: float, seed: int) -> Column:
    """Whether a block starts at this place of a path."""
    return (F.col("pos") == 0) | (uniform(F.lit("restart"), *labels, seed=seed) < 1 / block)


def _begin(labels: list[str], seed: int) -> Column:
    """The bar that a block starts from, of ``n``."""
    return F.floor(uniform(F.lit("start"), *labels, seed=seed) * F.col("n"))


def bootstrap(returns: DataFrame, replications: int, block: float, seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``replication, pos, source``: a stationary bootstrap of the bars 0..n-1 of
    each run: blocks of geometric length that start anywhere and wrap around."""
    n = returns.groupBy(*keys).agg((F.max("bar_ix") + 1).alias("n"))
    pos = n.withColumn("replication", F.explode(F.sequence(F.lit(0), F.lit(replications - 1)))).withColumn("pos", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    labels = [*keys, "replication", "pos"]
    order = Window.partitionBy(*keys, "replication").orderBy("pos")
    start = F.when(_fresh(labels, block, seed), F.struct(_begin(labels, seed).alias("at"), F.col("pos").alias("since")))
    marked = pos.withColumn("block", F.last(start, ignorenulls=True).over(order))
    return marked.select(*keys, "replication", "pos", ((F.col("block.at") + F.col("pos") - F.col("block.since")) % F.col("n")).alias("source"))


def resampled(returns: DataFrame, draws: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return draws.join(returns.withColumnRenamed("bar_ix", "source"), [*keys, "source"])


#: Paths that travel in one row.
PATHS = 32
#: Parts that runs which share their draws are dealt over.
SALTS = 64


def blocks(lengths: DataFrame, replications: int, block: float, seed: int, on: tuple[str, ...], labels: tuple[str, ...]) -> DataFrame:
    """The draws of ``bootstrap`` as runs of consecutive bars: of each row of
    ``on`` and ``n``, rows of ``PATHS`` paths with ``replication, pos, at`` of
    every block, in order. Places where no block starts never leave their task."""
    many = lengths.sparkSession.conf.get("spark.sql.shuffle.partitions")
    drawn = lengths.withColumn("replication", F.explode(F.sequence(F.lit(0), F.lit(replications - 1)))).withColumn("__part", F.floor(F.col("replication") / PATHS))
    placed = drawn.repartition(int(many), *on, "__part").withColumn("pos", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    names = [*labels, "replication", "pos"]
    begun = placed.filter(_fresh(names, block, seed)).withColumn("at", _begin(names, seed).cast("int"))
    made = begun.groupBy(*on, "__part").agg(F.sort_array(F.collect_list(F.struct("replication", "pos", "at"))).alias("d"))
    return made.select(*on, F.col("d.replication").alias("replication"), F.col("d.pos").alias("pos"), F.col("d.at").alias("at"))


def _series(returns: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row a run, as long as its calendar: ``bars`` of number and return in order."""
    return returns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bar_ix", F.col("net").cast("double").alias("net")))).alias("bars")).filter(F.size("bars") > 0)


def _shared(runs: DataFrame, draws: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Runs with the draws of their length ``n``; all runs may have one length, so they are dealt over parts that each hold the draws."""
    salted = runs.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    return salted.join(draws.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["n", "__salt"])


def _each_path(met: DataFrame, keys: tuple[str, ...], names: tuple[str, ...], walk: Callable) -> DataFrame:
    """``keys, replication`` and the named numbers that ``walk(bars, nets, n, path
    ends, pos, at)`` gives for each path of a row: arrays, a number a path."""

    def run(batches):
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i]
                replication = np.asarray(row["replication"])
                first = np.flatnonzero(np.r_[True, replication[1:] != replication[:-1]])
                numbers = walk(np.asarray(row["bar_ix"]), np.asarray(row["net"], dtype=float), int(row["n"]), first, np.asarray(row["pos"]), np.asarray(row["at"]))
                yield pd.DataFrame({**{k: pd.Series([row[k]] * len(first), dtype=pdf[k].dtype) for k in keys}, "replication": replication[first], **dict(zip(names, numbers))})

    flat = met.select(*keys, "n", F.col("bars.bar_ix").alias("bar_ix"), F.col("bars.net").alias("net"), "replication", "pos", "at")
    types = [f"`{k}` {met.schema[k].dataType.simpleString()}" for k in keys] + ["replication int"] + [f"`{name}` double" for name in names]
    return flat.mapInPandas(run, ", ".join(types))


def _compound(bars: np.ndarray, nets: np.ndarray, n: int, first: np.ndarray, pos: np.ndarray, at: np.ndarray) -> tuple:
    """Total return and deepest drawdown of each path; a bar without a return leaves equity as it is."""
    grown = np.ones(n)
    grown[bars] = np.where(np.isnan(nets), 1.0, 1.0 + nets)
    total, worst = np.empty(len(first)), np.empty(len(first))
    place = np.arange(n)
    for k, (a, b) in enumerate(zip(first, np.r_[first[1:], len(pos)])):
        ahead = np.repeat(at[a:b] - pos[a:b], np.diff(np.r_[pos[a:b], n]))
        equity = np.cumprod(grown[(place + ahead) % n])
        total[k] = equity[-1] - 1
        with np.errstate(invalid="ignore"):  # a path that has lost all from its first bar on has no peak to fall from
            worst[k] = np.fmin.reduce(equity / np.maximum.accumulate(equity) - 1)
    return total, worst


def _excess(bars: np.ndarray, nets: np.ndarray, n: int, first: np.ndarray, pos: np.ndarray, at: np.ndarray) -> tuple:
    """By how much the root of the length times each path's mean exceeds that of
    the run, and the run's: a block's sum is a difference of prefix sums over the bars, twice round."""
    known = ~np.isnan(nets)
    twice = lambda x: np.r_[0.0, np.cumsum(np.r_[x, x])]
    sums, counts = twice(np.where(known, nets, 0.0)), twice(known)
    stop = np.r_[pos[1:], n]
    stop[first[1:] - 1] = n
    ends = at + stop - pos
    own = np.add.reduceat(counts[ends] - counts[at], first)
    mean = sums[n] / counts[n] if counts[n] else np.nan
    drawn = np.divide(np.add.reduceat(sums[ends] - sums[at], first), own, out=np.full(len(first), np.nan), where=own > 0)
    return np.sqrt(n) * (drawn - mean), np.full(len(first), np.sqrt(n) * mean)


def monte_carlo(returns: DataFrame, replications: int = 500, block: float = 10, seed: int = 0, keys: tuple[str, ...] = (), shared: bool = False) -> DataFrame:
    """Percentiles of the total return over bootstrap paths, and the share of paths that halve, of each run.

    No drawn bar is a row: a run travels as one row of its returns, paths as
    their blocks. With ``shared`` all runs of a length take the same draws,
    which are then made once; otherwise a run's keys decide its own, as in
    ``bootstrap``. A bar that is missing or null leaves equity as it is."""
    runs = _series(returns, keys).withColumn("n", (F.element_at("bars.bar_ix", -1) + 1).cast("long"))
    if shared or not keys:
        met = _shared(runs, blocks(runs.select("n").distinct(), replications, block, seed, ("n",), ()), keys or ("n",))
    else:
        met = runs.join(blocks(runs.select(*keys, "n"), replications, block, seed, keys, keys), list(keys))
    by_path = _each_path(met, keys, ("total", "worst"), _compound)
    return by_path.groupBy(*keys).agg(*[F.percentile("total", F.lit(p / 100)).alias(f"p{p}") for p in (5, 50, 95)], F.try_divide(F.count_if(F.col("worst") <= -0.5), F.count("*")).alias("ruin"), F.count("*").alias("n_paths"))


def reality_check(returns: DataFrame, replications: int = 500, block: float = 20, seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """White's p-value over the candidates (run, bar_ix, net) of each family, cut
    to the family's last common bars (those of its shortest run of two bars or
    more; shorter runs go): how often the best of the centred bootstrap means
    beats the best observed mean, each times the root of the common length; 1
    without a candidate. Candidates share their family's draws, which the
    common length and the seed decide, so a family has the same value alone as among others."""
    runs = _series(returns, (*keys, "run")).withColumn("__long", F.size("bars") > 1)
    least = runs.groupBy(*keys).agg(F.min(F.when(F.col("__long"), F.size("bars"))).alias("__least"))
    joined = runs.join(least, list(keys)) if keys else runs.crossJoin(F.broadcast(least))  # one row
    cut = joined.filter("__long").withColumn("n", F.col("__least").cast("long"))
    tail = F.slice("bars", -F.col("__least"), F.col("__least"))
    renumbered = cut.withColumn("bars", F.transform(tail, lambda x, i: F.struct(i.alias("bar_ix"), x["net"].alias("net"))))
    met = _shared(renumbered, blocks(cut.select("n").distinct(), replications, block, seed, ("n",), ()), (*keys, "run"))
    paths = _each_path(met, (*keys, "run"), ("excess", "observed"), _excess)
    number = lambda x: F.nanvl(x, F.lit(None).cast("double"))
    best = paths.groupBy(*keys, "replication").agg(F.max(number("excess")).alias("best_drawn"), F.max(number("observed")).alias("best"))
    p = (F.count_if(F.col("best_drawn") >= F.col("best")) + 1) / (F.count("best_drawn") + 1)
    made = best.groupBy(*keys).agg(p.alias("p_value"), F.max("best").alias("best"))
    return least.select(*keys).join(made, list(keys), "left").fillna(1.0, ["p_value"]) if keys else made


def splits(chunks: int, most: int = 4096) -> list[tuple[int, list[int]]]:
    """Half-and-half splits of the chunks, thinned evenly to ``most``."""
    every = math.comb(chunks, chunks // 2)
    wanted = {int(i * every / most) for i in range(most)} if every > most else range(every)
    return [(i, list(own)) for i, own in enumerate(own for k, own in enumerate(itertools.combinations(range(chunks), chunks // 2)) if k in wanted)]


def overfitting(returns: DataFrame, chunks: int = 16, most: int = 4096, keys: tuple[str, ...] = ()) -> DataFrame:
    """Probability of backtest overfitting over each family's runs (run, bar_ix,
    net) of equal length: in how many half-and-half splits of contiguous chunks
    the in-sample winner ranks in the lower half out of sample, where equal
    results rank high. No more chunks than the family's longest run has bars; 0
    for fewer than four chunks or two runs.

    Only chunk sums leave the returns. The sums of every subset of the first and
    of the second half of the chunks are made once a run, so a split adds two of
    them. A split's winner is found by a partial aggregate; winners travel to the
    runs as one array a family, and runs' scores are never shuffled."""
    spark = returns.sparkSession
    chunks -= chunks % 2
    half = max(chunks // 2, 1)
    run = Window.partitionBy(*keys, "run")
    counted = returns.withColumns({"n": F.count("*").over(run), "place": F.row_number().over(run.orderBy("bar_ix")) - 1})
    longest = returns.groupBy(*keys, "run").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.least(F.max("n"), F.lit(chunks)).cast("int").alias("chunks"))
    longest = written(longest)
    counts = [r["chunks"] for r in longest.select("chunks").distinct().collect() if (r["chunks"] or 0) >= 4]  # at most `chunks` numbers
    table = spark.createDataFrame([(k, i, sum(1 << j for j in own if j < half), sum(1 << (j - half) for j in own if j >= half)) for k in counts for i, own in splits(k, most)], "chunks int, split int, lo int, hi int")  # at most `most` rows a number
    with_chunks = lambda rows: rows.join(longest, list(keys)) if keys else rows.crossJoin(F.broadcast(longest))  # noqa: E731 # one row
    parts = F.greatest("chunks", F.lit(1))
    size, extra = F.floor(F.col("n") / parts), F.col("n") % parts
    chunk = F.when(F.col("place") < extra * (size + 1), F.floor(F.col("place") / (size + 1))).otherwise(extra + F.floor((F.col("place") - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    sums = with_chunks(counted).groupBy(*keys, "run", "chunks", chunk.cast("int").alias("chunk")).agg(F.count("*").cast("double").alias("c"), F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("q"))
    held = F.map_from_entries(F.collect_list(F.struct("chunk", F.struct("c", "s", "q"))))
    nothing = F.struct(*[F.lit(0.0).alias(f) for f in "csq"])

    def subsets(first: int) -> Column:
        """Sums of every subset of ``half`` chunks from ``first`` on, at the place that its bits name."""
        own = F.transform(F.sequence(F.lit(first), F.lit(first + half - 1)), lambda i: F.coalesce(F.col("held")[i], nothing))
        plus = lambda x, y: F.struct(*[(F.coalesce(x[f], F.lit(0.0)) + F.coalesce(y[f], F.lit(0.0))).alias(f) for f in "csq"])
        return F.aggregate(own, F.array(nothing), lambda made, x: F.concat(made, F.transform(made, lambda y: plus(y, x))))

    by_run = sums.groupBy(*keys, "run", "chunks").agg(held.alias("held")).select(*keys, "run", "chunks", subsets(0).alias("low"), subsets(half).alias("high"))
    by_run = written(by_run)  # read once for winners and once for ranks
    whole = (1 << half) - 1

    def score(lo: Column, hi: Column) -> Column:
        a, b = F.get("low", lo), F.get("high", hi)
        c, s, q = (a[f] + b[f] for f in "csq")
        var = F.when(c > 1, (q - s * s / c) / (c - 1))
        return F.coalesce(F.when(var > 1e-18 * F.greatest(q, F.lit(1e-300)), s / c / F.sqrt(var)), F.lit(0.0))

    lo, hi = F.col("lo"), F.col("hi")
    seen, unseen = score(lo, hi), score(whole - lo, whole - hi)
    splitted = lambda rows: rows.join(F.broadcast(table), "chunks")  # noqa: E731 # the bounded table of splits
    winner = splitted(by_run).select(*keys, "split", "run", seen.alias("seen"), unseen.alias("unseen")).groupBy(*keys, "split").agg(F.min_by("unseen", F.struct(-F.col("seen"), F.col("run"))).alias("won"))
    winners = winner.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("split", "won"))).alias("__m"), F.max("split").alias("__last")).select(*keys, F.transform(F.sequence(F.lit(0), F.col("__last")), lambda i: F.col("__m")[i]).alias("won"))
    salted = winners.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = by_run.withColumn("__salt", F.pmod(F.xxhash64("run"), F.lit(SALTS))).join(salted, [*keys, "__salt"])
    ranked = splitted(dealt).groupBy(*keys, "split").agg(F.count_if(unseen <= F.get("won", F.col("split"))).alias("below"), F.count("*").alias("runs")).filter("runs > 1")
    made = ranked.groupBy(*keys).agg(F.coalesce(F.try_divide(F.count_if(F.col("below") / (F.col("runs") + 1) <= 0.5), F.count("*")), F.lit(0.0)).alias("pbo"), F.count("*").alias("n_splits"))
    return longest.select(*keys).join(made, list(keys), "left").fillna(0.0, ["pbo"]).fillna(0, ["n_splits"]) if keys else made


def param_sensitivity(scores: DataFrame) -> DataFrame:
    """Deviation of Sharpes over parameter sets against their mean size."""
    mean = F.avg(F.abs("sharpe"))
    return scores.agg(F.coalesce(F.when(mean > 0, F.stddev_samp("sharpe") / mean), F.lit(0.0)).alias("sensitivity"))


def cost_breakeven(curve: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The largest cost multiplier, in tenths up to 10 and without a failure before it, that leaves a profit."""
    sums = curve.groupBy(*keys).agg(F.sum("gross").alias("g"), F.sum("cost").alias("c"))
    tried = sums.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(100)))).withColumn("ok", F.col("g") - F.col("m") / 10 * F.col("c") > 0)
    first_bad = F.coalesce(F.min(F.when(~F.col("ok"), F.col("m"))), F.lit(101))
    return tried.groupBy(*keys).agg(((first_bad - 1) / 10).alias("breakeven"))


def permuted(returns: DataFrame, seed: int = 0) -> DataFrame:
    """Returns of each run in an order that the seed decides: same values, no memory."""
    a = returns.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("bar_ix")))
    b = returns.select("run", "net", F.row_number().over(Window.partitionBy("run").orderBy(uniform("run", "bar_ix", seed=seed), "bar_ix")).alias("k"))
    return a.drop("net").join(b, ["run", "k"]).drop("k")


def calibration(scores: DataFrame, bar: float) -> DataFrame:
    """Share of null-world replications whose score clears the bar."""
    return scores.agg(F.count("*").alias("replications"), F.count_if(F.col("score") > bar).alias("discoveries"), F.coalesce(F.try_divide(F.count_if(F.col("score") > bar), F.count("*")), F.lit(0.0)).alias("fdr"), F.max("score").alias("max_score"))
