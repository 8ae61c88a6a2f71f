"""Registered queries over many runs: walk-forward, statistics, regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry as r
from .plans import regimes, stats, walkforward
from .registry import PERIODS, WITH, WITH_RUN, add, base, c, curve

GRID = {"fast": [2.0, 4.0], "slow": [8.0, 13.0]}


def _span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).agg(F.min("date").alias("first"), F.max("date").alias("last"))


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walkforward.folds(_span(spark, sf_dir), [1, 2, 3], 1, 7)


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = walkforward.slices(base(spark, sf_dir).select("instrument", "date", "open", "high", "low", "close"), _folds(spark, sf_dir))
    return walkforward.run_returns(sliced, walkforward.grid(spark, GRID), walkforward.crossover([2, 4, 8, 13]))


FOLDS = f"""{WITH}, span AS (SELECT min(date) AS first, max(date) AS last FROM panel),
y AS (SELECT unnest([1, 2, 3]) AS train_years), k AS (SELECT unnest(range(0, 12)) AS fold),
f0 AS (SELECT train_years, fold, CAST(first + to_years(fold) AS DATE) AS train_start, last FROM span, y, k),
f1 AS (SELECT *, CAST(train_start + to_years(train_years) AS DATE) AS train_end FROM f0),
f2 AS (SELECT *, train_end + 7 AS test_start FROM f1),
folds AS (SELECT CAST(train_years AS INTEGER) AS train_years, CAST(fold AS INTEGER) AS fold, train_start, train_end, test_start, CAST(test_start + to_years(1) AS DATE) AS test_end FROM f2 WHERE test_start + to_years(1) <= last)"""
_KEY = "train_years, fold, part, params_ix"
_OWN = f"OVER (PARTITION BY {_KEY}, instrument ORDER BY bar_ix)"
_SH = f"coalesce(CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt({PERIODS}) END, 0)"
RETURNS = f"""{FOLDS}, parts AS (SELECT train_years, fold, 'train' AS part, train_start AS a, train_end AS z FROM folds UNION ALL SELECT train_years, fold, 'test', test_start, test_end FROM folds),
grid AS (SELECT * FROM (VALUES (0, 2, 8), (1, 2, 13), (2, 4, 8), (3, 4, 13)) g(params_ix, fast, slow)),
s AS (SELECT train_years, fold, part, instrument, date, close, row_number() OVER (PARTITION BY train_years, fold, part, instrument ORDER BY date) - 1 AS bar_ix FROM panel JOIN parts ON date BETWEEN a AND z),
c0 AS (SELECT s.*, params_ix, fast, slow FROM s, grid),
c1 AS (SELECT *, CASE WHEN count(close) OVER (PARTITION BY {_KEY}, instrument ORDER BY bar_ix ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 THEN avg(close) OVER (PARTITION BY {_KEY}, instrument ORDER BY bar_ix ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) END AS m2,
  CASE WHEN count(close) OVER (PARTITION BY {_KEY}, instrument ORDER BY bar_ix ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 THEN avg(close) OVER (PARTITION BY {_KEY}, instrument ORDER BY bar_ix ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS m4,
  CASE WHEN count(close) OVER (PARTITION BY {_KEY}, instrument ORDER BY bar_ix ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = 8 THEN avg(close) OVER (PARTITION BY {_KEY}, instrument ORDER BY bar_ix ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) END AS m8,
  CASE WHEN count(close) OVER (PARTITION BY {_KEY}, instrument ORDER BY bar_ix ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 13 THEN avg(close) OVER (PARTITION BY {_KEY}, instrument ORDER BY bar_ix ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) END AS m13 FROM c0),
c2 AS (SELECT *, CAST(sign((CASE fast WHEN 2 THEN m2 ELSE m4 END) - (CASE slow WHEN 8 THEN m8 ELSE m13 END)) AS DOUBLE) AS signal, lag(close) {_OWN} AS prev FROM c1),
c3 AS (SELECT *, CASE WHEN close IS NULL THEN 0.0 ELSE coalesce(lag(signal) {_OWN}, 0) END AS w1 FROM c2),
c4 AS (SELECT *, CASE WHEN sum(abs(w1)) OVER (PARTITION BY {_KEY}, date) > 1 THEN w1 / sum(abs(w1)) OVER (PARTITION BY {_KEY}, date) ELSE w1 END AS weight FROM c3),
c5 AS (SELECT *, coalesce(lag(weight) {_OWN}, 0) AS old FROM c4),
c6 AS (SELECT *, CASE WHEN weight * old > 0 THEN sign(weight) * least(abs(weight), abs(old)) ELSE 0 END AS held FROM c5),
rets AS (SELECT {_KEY}, date, bar_ix, sum(CASE WHEN weight = 0 THEN 0.0 ELSE coalesce(weight * (close / prev - 1), 0) END - (abs(weight - held) + abs(old - held)) * 10.0 / 10000) AS net FROM c6 WHERE bar_ix > 0 GROUP BY {_KEY}, date, bar_ix),
sc AS (SELECT {_KEY}, {_SH} AS sharpe, sum(net) AS total, count(*) AS n FROM rets GROUP BY {_KEY}),
best AS (SELECT *, row_number() OVER (PARTITION BY train_years, fold ORDER BY round(sharpe, 9) DESC, params_ix) AS k FROM sc WHERE part = 'train'),
res AS (SELECT b.train_years, b.fold, b.params_ix, b.sharpe AS train_sharpe, b.n AS train_bars, t.sharpe AS test_sharpe, t.total AS test_return, t.n AS test_bars
        FROM best b JOIN sc t ON t.part = 'test' AND t.train_years = b.train_years AND t.fold = b.fold AND t.params_ix = b.params_ix WHERE k = 1 AND b.n >= 30 AND t.n >= 5),
oos AS (SELECT rets.* FROM rets JOIN res ON res.train_years = rets.train_years AND res.fold = rets.fold AND res.params_ix = rets.params_ix WHERE part = 'test'),
ws AS (SELECT o.*, efficiency, folds_profitable, n_folds FROM (SELECT train_years, {_SH} AS sharpe, count(*) AS n_bars, sum(net) AS total FROM oos GROUP BY train_years) o
       JOIN (SELECT train_years, coalesce(CASE WHEN avg(train_sharpe) <> 0 THEN avg(test_sharpe) / avg(train_sharpe) END, 0) AS efficiency, count(*) FILTER (test_return > 0) AS folds_profitable, count(*) AS n_folds FROM res GROUP BY train_years) e ON e.train_years = o.train_years)"""


def _results(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    returns = _returns(s, d)
    return returns, walkforward.fold_results(returns, PERIODS)


add("f1_folds", _folds, f"{FOLDS} SELECT * FROM folds")
add("f2_add_years", lambda s, d: s.createDataFrame([(0,)], "x int").join(r.source.table(s, d, "orders").select(c("o_orderdate").cast("date").alias("day")).distinct(), F.lit(True)).select("day", walkforward.add_years(c("day"), 1).alias("later")), "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) + to_years(1) AS DATE) AS later FROM orders")
add("f3_slices", lambda s, d: walkforward.slices(base(s, d).select("instrument", "date", "close"), _folds(s, d)).groupBy("train_years", "fold", "part", "instrument").agg(F.count("*").alias("n_bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date")), f"{RETURNS} SELECT train_years, fold, part, instrument, count(*) AS n_bars, min(date) AS first_date, max(date) AS last_date FROM s GROUP BY 1, 2, 3, 4")
add("f3_run_returns", lambda s, d: _returns(s, d).groupBy("train_years", "fold", "part", "params_ix").agg(F.sum("net").alias("total"), F.count("*").alias("n")), f"{RETURNS} SELECT train_years, fold, part, params_ix, total, n FROM sc")
def _mean_rule(pdf, p):
    """The same crossover as a function of bars and parameters."""
    gap = pdf["close"].rolling(int(p["fast"])).mean() - pdf["close"].rolling(int(p["slow"])).mean()
    return gap.where(gap.isna(), (gap > 0).astype(float) - (gap < 0))


_SUMS = lambda returns: returns.groupBy("train_years", "fold", "part", "params_ix").agg(F.sum("net").alias("total"), F.count("*").alias("n"))
_sliced = lambda s, d: walkforward.slices(base(s, d).select("instrument", "date", "open", "high", "low", "close"), _folds(s, d))
add("c8_node_overrides", lambda s, d: _SUMS(walkforward.run_returns(_sliced(s, d), walkforward.grid(s, {f"cross.{k}": v for k, v in GRID.items()}), walkforward.crossover([2, 4, 8, 13], "cross.fast", "cross.slow"))), f"{RETURNS} SELECT train_years, fold, part, params_ix, total, n FROM sc")
add("f3_function_runs", lambda s, d: _SUMS(walkforward.run_returns(_sliced(s, d), walkforward.grid(s, GRID), walkforward.by_function(_mean_rule))), f"{RETURNS} SELECT train_years, fold, part, params_ix, total, n FROM sc")
add("f4_grid", lambda s, d: walkforward.grid(s, GRID).join(r.source.table(s, d, "region").agg(F.count("*").alias("regions")), F.lit(True)), "SELECT g.*, regions FROM (VALUES (0, 2.0, 8.0), (1, 2.0, 13.0), (2, 4.0, 8.0), (3, 4.0, 13.0)) g(params_ix, fast, slow), (SELECT count(*) AS regions FROM region)")
add("f5_tuned", lambda s, d: walkforward.tuned(_returns(s, d), PERIODS).select("train_years", "fold", "train_sharpe", "train_bars"), f"{RETURNS} SELECT train_years, fold, sharpe AS train_sharpe, n AS train_bars FROM best WHERE k = 1")
add("f7_fold_results", lambda s, d: _results(s, d)[1].select("train_years", "fold", "params_ix", "train_sharpe", "test_sharpe", "test_return", "test_bars"), f"{RETURNS} SELECT train_years, fold, params_ix, train_sharpe, test_sharpe, test_return, test_bars FROM res")
add("f8_out_of_sample", lambda s, d: walkforward.out_of_sample(*_results(s, d)).select("train_years", "fold", "date", "net"), f"{RETURNS} SELECT train_years, fold, date, net FROM oos")
add("f9_window_scores", lambda s, d: walkforward.window_scores(*_results(s, d), PERIODS), f"{RETURNS} SELECT * FROM ws")
add("f10_best_window", lambda s, d: walkforward.best_window(walkforward.window_scores(*_results(s, d), PERIODS)), f"{RETURNS} SELECT (SELECT train_years FROM ws ORDER BY sharpe DESC, train_years LIMIT 1) AS train_years, max(sharpe) AS sharpe, max(sharpe) - min(sharpe) AS spread FROM ws")
add(
    "m9_fold_stability",
    lambda s, d: walkforward.stability(_results(s, d)[1]),
    f"""{RETURNS}, st AS (SELECT *, row_number() OVER (PARTITION BY train_years ORDER BY fold) AS a, row_number() OVER (PARTITION BY train_years ORDER BY fold DESC) AS b FROM res)
SELECT train_years, avg(test_sharpe) AS mean, stddev_pop(test_sharpe) AS std, min(test_sharpe) AS worst, count(*) FILTER (test_sharpe > 0) AS above_0, count(*) FILTER (test_sharpe > 1) AS above_1,
avg(test_sharpe) FILTER (b <= 3) - avg(test_sharpe) FILTER (a <= 3) AS decay FROM st GROUP BY train_years""",
)
add("m14_out_of_sample_mask", lambda s, d: base(s, d).select("date").distinct().join(F.broadcast(_folds(s, d).select("test_start", "test_end")), c("date").between(c("test_start"), c("test_end")), "left_semi"), f"{FOLDS} SELECT DISTINCT p.date FROM panel p JOIN folds f ON p.date BETWEEN f.test_start AND f.test_end")

# Statistics: each instrument's own returns as a run
_inst = lambda s, d: base(s, d).filter("bar_ix > 0").select(c("instrument").alias("run"), (c("bar_ix") - 1).alias("bar_ix"), "date", F.coalesce("ret", F.lit(0.0)).alias("net"))
INST = f"{WITH}, i AS (SELECT instrument AS run, bar_ix - 1 AS bar_ix, date, coalesce(ret, 0) AS net FROM p WHERE bar_ix > 0)"
_moments = lambda s, d: stats.moments(_inst(s, d), ("run",), periods=PERIODS)
MOM = f"""{INST}, m0 AS (SELECT run, avg(net) AS mean, stddev_samp(net) AS std, count(*) AS n FROM i GROUP BY run),
m1 AS (SELECT i.run, any_value(m0.n) AS n, any_value(m0.mean) AS mean, any_value(m0.std) AS std, avg(pow(net - m0.mean, 2)) AS c2, avg(pow(net - m0.mean, 3)) AS c3, avg(pow(net - m0.mean, 4)) AS c4 FROM i JOIN m0 ON m0.run = i.run GROUP BY i.run),
m AS (SELECT run, n, mean, std, mean / std * sqrt({PERIODS}) AS sr, c3 / pow(c2, 1.5) * sqrt(n * (n - 1.0)) / (n - 2) AS skew, (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * (c4 / (c2 * c2) - 3) + 6) + 3 AS kurt FROM m1),
se AS (SELECT *, sqrt(greatest(0, 1 + sr * sr / 2 - skew * sr + (kurt - 3) / 4 * sr * sr) / n) AS se FROM m)"""
add("q2_moments", _moments, f"{MOM} SELECT * FROM m")
add("q1_se_sharpe", lambda s, d: _moments(s, d).select("run", stats.se_sharpe(c("sr"), c("n"), c("skew"), c("kurt")).alias("se")), f"{MOM} SELECT run, se FROM se")
_family = lambda s, d: r.source.table(s, d, "orders").groupBy(c("o_orderpriority").alias("run")).agg(F.count("*").alias("prior"))
_trials = lambda s, d: _moments(s, d).join(_family(s, d), "run").withColumn("trials", stats.family_trials(c("prior"), F.lit(1)))
_scores = lambda s, d: stats.honest_scores(_trials(s, d))


def _quantile_sql(p: str) -> str:
    ratio = lambda parts, x: "(" + ") / (".join(" + ".join(f"{k!r} * pow({x}, {i})" for i, k in enumerate(some)) for some in parts) + ")"
    far = f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * ({ratio(stats.MIDDLE, f'(0.180625 - pow({p} - 0.5, 2))')}) WHEN {far} <= 5 THEN sign({p} - 0.5) * ({ratio(stats.TAIL, f'({far} - 1.6)')}) ELSE sign({p} - 0.5) * ({ratio(stats.FAR, f'({far} - 5)')}) END)"


_PHI = "0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2)))"
SCORES = f"""{MOM}, fam AS (SELECT o_orderpriority AS run, (count(*) + 1) * 3 AS trials FROM orders GROUP BY 1),
qn AS (SELECT trials, {1 - stats.EULER!r} * {_quantile_sql("(1 - 1.0 / trials)")} + {stats.EULER!r} * {_quantile_sql("(1 - 1.0 / (trials * exp(1)))")} AS factor FROM (SELECT DISTINCT trials FROM fam)),
hs AS (SELECT se.*, fam.trials, se.se * qn.factor AS haircut, sr - 1.65 * se.se - se.se * qn.factor AS honest, (sr - se.se * qn.factor) / se.se AS z FROM se JOIN fam ON fam.run = se.run JOIN qn ON qn.trials = fam.trials)"""


def _draws(replications: int, block: float, seed: int, runs: str = "i") -> str:
    """Common tables of a stationary bootstrap of each run's bars."""
    u = lambda what: f"CAST('0x' || substr(md5('{seed}|{what}|' || run || '|' || replication || '|' || pos), 1, 13) AS BIGINT) / 4503599627370496.0"
    return f"""nb AS (SELECT run, max(bar_ix) + 1 AS n FROM {runs} GROUP BY run),
ps AS (SELECT run, n, replication, unnest(range(0, CAST(n AS BIGINT))) AS pos FROM (SELECT run, n, unnest(range(0, {replications})) AS replication FROM nb)),
fr AS (SELECT *, CASE WHEN pos = 0 OR {u("restart")} < 1.0 / {block} THEN {{'at': floor({u("start")} * n), 'since': pos}} END AS st FROM ps),
bk AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY run, replication ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM fr),
dr AS (SELECT run, replication, pos, CAST((b['at'] + pos - b['since']) % n AS BIGINT) AS source FROM bk),
rs AS (SELECT dr.run, dr.replication, dr.pos, x.net FROM dr JOIN {runs} x ON x.run = dr.run AND x.bar_ix = dr.source)"""
add("q3_haircut", lambda s, d: _scores(s, d).select("run", "trials", "haircut"), f"{SCORES} SELECT run, trials, haircut FROM hs")
add("q4_honest_score", lambda s, d: _scores(s, d).select("run", "honest"), f"{SCORES} SELECT run, honest FROM hs")
add("q5_deflated_sharpe", lambda s, d: _scores(s, d).select("run", "deflated"), f"{SCORES} SELECT run, {_PHI} AS deflated FROM hs")
add("q6_family_trials", lambda s, d: r.source.table(s, d, "customer").groupBy("c_nationkey").agg((F.count("*") * 3).alias("trials")), "SELECT c_nationkey, count(*) * 3 AS trials FROM customer GROUP BY c_nationkey")
add("q7_bootstrap", lambda s, d: stats.bootstrap(_inst(s, d), 20, 8, 1, ("run",)), f"{INST}, {_draws(20, 8, 1)} SELECT run, replication, pos, source FROM dr")
add(
    "q8_monte_carlo",
    lambda s, d: stats.monte_carlo(curve(s, d).select((c("bar_ix") - 1).alias("bar_ix"), "net", F.lit("all").alias("run")), 500, 10, 1, ("run",)),
    f"""{WITH_RUN}, cv AS (SELECT 'all' AS run, bar_ix - 1 AS bar_ix, net FROM curve), {_draws(500, 10, 1, "cv")},
mq AS (SELECT *, product(1 + net) OVER (PARTITION BY replication ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM rs),
md AS (SELECT *, equity / max(equity) OVER (PARTITION BY replication ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM mq),
mp AS (SELECT run, replication, last(equity ORDER BY pos) - 1 AS total, min(drawdown) AS worst FROM md GROUP BY 1, 2)
SELECT run, quantile_cont(total, 0.05) AS p5, quantile_cont(total, 0.5) AS p50, quantile_cont(total, 0.95) AS p95, count(*) FILTER (worst <= -0.5) / count(*) AS ruin, count(*) AS n_paths FROM mp GROUP BY run""",
)
_RC = _draws(500, 20, 1, "rb").replace("|' || run || '|' || ", "|' || ")
add(
    "q9_reality_check",
    lambda s, d: stats.reality_check(_inst(s, d), 500, 20, 1),
    f"""{INST}, rb AS (SELECT DISTINCT 'all' AS run, bar_ix, 0.0 AS net FROM i), {_RC},
mn AS (SELECT run, avg(net) AS mean, count(*) AS n FROM i GROUP BY run), ob AS (SELECT max(sqrt(n) * mean) AS best FROM mn),
sm AS (SELECT dr.replication, i.run, avg(i.net) AS drawn FROM dr JOIN i ON i.bar_ix = dr.source GROUP BY 1, 2),
bs AS (SELECT replication, max(sqrt(mn.n) * (drawn - mean)) AS best_drawn FROM sm JOIN mn ON mn.run = sm.run GROUP BY 1)
SELECT (count(*) FILTER (best_drawn >= best) + 1) / (count(*) + 1) AS p_value, any_value(best) AS best FROM bs, ob""",
)
_CH = f"""{INST}, z AS (SELECT *, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY bar_ix) - 1 AS k FROM i),
ch AS (SELECT run, CASE WHEN k < n % 16 * (n // 16 + 1) THEN k // (n // 16 + 1) ELSE n % 16 + (k - n % 16 * (n // 16 + 1)) // (n // 16) END AS chunk, net FROM z),
cs AS (SELECT run, chunk, count(*) AS c, sum(net) AS s, sum(net * net) AS q FROM ch GROUP BY 1, 2),
al AS (SELECT mask, row_number() OVER (ORDER BY mask DESC) - 1 AS ix FROM range(65536) t(mask) WHERE bit_count(mask) = 8),
sp AS (SELECT mask, ix FROM al WHERE ix IN (SELECT CAST(floor(i * 12870 / 4096.0) AS BIGINT) FROM range(4096) t(i))),
h AS (SELECT ix AS split, run, (mask >> CAST(15 - chunk AS BIGINT)) & 1 = 1 AS inside, sum(c) AS c, sum(s) AS s, sum(q) AS q FROM cs, sp GROUP BY 1, 2, 3),
h2 AS (SELECT *, CASE WHEN q - s * s / c > 0 THEN s / c / sqrt((q - s * s / c) / (c - 1)) ELSE 0 END AS score FROM h),
g AS (SELECT split, run, max(score) FILTER (inside) AS seen, max(score) FILTER (NOT inside) AS unseen FROM h2 GROUP BY split, run),
k2 AS (SELECT *, first_value(unseen) OVER (PARTITION BY split ORDER BY seen DESC, run) AS won FROM g),
k3 AS (SELECT split, count(*) FILTER (unseen <= won) / (count(*) + 1) AS share FROM k2 GROUP BY split)"""
add("q10_overfitting", lambda s, d: stats.overfitting(_inst(s, d)), f"{_CH} SELECT count(*) FILTER (share <= 0.5) / count(*) AS pbo, count(*) AS n_splits FROM k3")
add("q11_param_sensitivity", lambda s, d: stats.param_sensitivity(_inst(s, d).groupBy("run").agg(r.metrics.sharpe(c("net"), PERIODS).alias("sharpe"))), f"{INST}, x AS (SELECT run, {_SH} AS sharpe FROM i GROUP BY run) SELECT coalesce(CASE WHEN avg(abs(sharpe)) > 0 THEN stddev_samp(sharpe) / avg(abs(sharpe)) END, 0) AS sensitivity FROM x")
add("q12_cost_breakeven", lambda s, d: stats.cost_breakeven(curve(s, d)), f"{WITH_RUN}, t AS (SELECT sum(gross) AS g, sum(cost) AS c FROM curve), m AS (SELECT m, g - m / 10 * c > 0 AS ok FROM t, (SELECT unnest(range(1, 101)) AS m)) SELECT (coalesce(min(m) FILTER (NOT ok), 101) - 1) / 10 AS breakeven FROM m")
add("q13_seeded_uniform", lambda s, d: _inst(s, d).select("run", "bar_ix", stats.uniform("run", "bar_ix", seed=7).alias("u")), f"{INST} SELECT run, bar_ix, CAST('0x' || substr(md5('7|' || run || '|' || bar_ix), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM i")
add("q15_regime_match", lambda s, d: walkforward.out_of_sample(*_results(s, d)).select("train_years", "fold", "date").join(_labels(s, d).select("date", "regime"), "date", "left").select("train_years", "fold", "date", F.coalesce("regime", F.lit("sideways")).alias("regime")))
add("q16_permuted", lambda s, d: stats.permuted(_inst(s, d), 3).select("run", "bar_ix", "net"), f"{INST}, pa AS (SELECT run, bar_ix, row_number() OVER (PARTITION BY run ORDER BY bar_ix) AS k FROM i), pb AS (SELECT run, net, row_number() OVER (PARTITION BY run ORDER BY substr(md5('3|' || run || '|' || bar_ix), 1, 13), bar_ix) AS k FROM i) SELECT pa.run, pa.bar_ix, pb.net FROM pa JOIN pb ON pb.run = pa.run AND pb.k = pa.k")
add("q17_block_bootstrap_null", lambda s, d: stats.resampled(_inst(s, d), stats.bootstrap(_inst(s, d), 10, 20, 5, ("run",)), ("run",)).select("run", "replication", "pos", "net"), f"{INST}, {_draws(10, 20, 5)} SELECT run, replication, pos, net FROM rs")
add("q19_calibration", lambda s, d: stats.calibration(stats.resampled(_inst(s, d), stats.bootstrap(_inst(s, d), 30, 1, 9, ("run",)), ("run",)).groupBy("run", "replication").agg(r.metrics.sharpe(c("net"), PERIODS).alias("score")), 10.0), f"{INST}, {_draws(30, 1, 9)}, sq AS (SELECT run, replication, {_SH} AS score FROM rs GROUP BY 1, 2) SELECT count(*) AS replications, count(*) FILTER (score > 10) AS discoveries, count(*) FILTER (score > 10) / count(*) AS fdr, max(score) AS max_score FROM sq")

# Regimes
LOOK = 26


def _labels(s: SparkSession, d: str) -> DataFrame:
    return regimes.label(regimes.market_returns(base(s, d)), LOOK)


_B = f"OVER (ORDER BY bar_ix ROWS BETWEEN {LOOK} PRECEDING AND 1 PRECEDING)"
_U = "OVER (ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
REG = f"""{WITH_RUN}, mk AS (SELECT bar_ix, date, coalesce(avg(ret), 0) AS market FROM p GROUP BY bar_ix, date),
g1 AS (SELECT *, product(1 + market) {_U} AS equity, CASE WHEN bar_ix >= {LOOK} THEN stddev_pop(market) {_B} END AS vol, CASE WHEN bar_ix >= {LOOK} THEN avg(market) {_B} END AS mean, count(*) OVER () AS n FROM mk),
g2 AS (SELECT *, 1 - equity / max(equity) {_U} AS drawdown, quantile_cont(vol, 0.5) {_U} AS reference FROM g1),
lab AS (SELECT bar_ix, date, market, CASE WHEN n < {LOOK + 2} THEN 'sideways' WHEN drawdown >= 0.2 THEN 'crisis' WHEN vol IS NULL OR reference <= 0 THEN 'sideways' WHEN vol >= 1.5 * reference THEN 'high_vol'
        WHEN vol <= 0.6 * reference THEN 'low_vol' WHEN vol > 0 AND abs(mean) / vol >= 0.1 THEN 'trending' ELSE 'sideways' END AS regime FROM g2),
j AS (SELECT curve.*, coalesce(lab.regime, 'sideways') AS regime FROM curve LEFT JOIN lab ON lab.date = curve.date),
j2 AS (SELECT *, product(1 + net) OVER (PARTITION BY regime ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM j),
j3 AS (SELECT *, equity / max(equity) OVER (PARTITION BY regime ORDER BY bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM j2),
br AS (SELECT regime, {_SH} AS sharpe, product(1 + net) - 1 AS total, -min(drawdown) AS max_drawdown, min(date) AS first_date, max(date) AS last_date, count(*) AS n_bars FROM j3 GROUP BY regime)"""
add("g1_market_returns", lambda s, d: regimes.market_returns(base(s, d)), f"{REG} SELECT bar_ix, date, market FROM mk")
add("g4_regime_labels", _labels, f"{REG} SELECT * FROM lab")
add("g5_by_regime", lambda s, d: regimes.by_regime(curve(s, d), _labels(s, d), PERIODS), f"{REG} SELECT * FROM br")
add("g6_weak_regimes", lambda s, d: regimes.weak(regimes.by_regime(curve(s, d), _labels(s, d), PERIODS), _labels(s, d)), f"{REG} SELECT regime, regime = (SELECT last(regime ORDER BY bar_ix) FROM lab) AS is_current FROM br WHERE sharpe < 0")
r.SQL["q15_regime_match"] = RETURNS + REG[len(WITH):].replace("bars_never", "") + " SELECT oos.train_years, oos.fold, oos.date, coalesce(lab.regime, 'sideways') AS regime FROM oos LEFT JOIN lab ON lab.date = oos.date"
