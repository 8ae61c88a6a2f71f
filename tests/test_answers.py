"""Known answers, and plain recomputations of what SQL doesn't state."""

import datetime as dt
import glob
import gzip
import hashlib
import itertools
import math
import random
import sys
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers all queries)
from barquet import registry
from barquet.operators import clusters, pca, specs
from barquet.plans import backtest, barquality, checks, documents, ledger, metrics, monitor, regimes, stats, walkforward
from barquet.sources import archive
from barquet.streaming import jobs
from barquet.functions import windows as w

DATA = "/root/testdata/sf0.001"


def curve(spark, series):
    return spark.createDataFrame([(run, t, float(x)) for run, xs in series.items() for t, x in enumerate(xs)], "run string, bar_ix int, net double")


# Statistics
def test_normal_quantile_and_share(spark):
    ps = [1e-12, 1e-6, 0.01, 0.2, 0.5, 0.6, 0.95, 0.9999, 1 - 1e-9]
    zs = [-12.0, -8.5, -3.0, -1.0, 0.0, 0.4, 1.65, 5.0, 8.9, 20.0]
    got = [r["q"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").select("i", stats.normal_quantile(F.col("p")).alias("q")).orderBy("i").collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-14)
    got = [r["q"] for r in spark.createDataFrame([(i, z) for i, z in enumerate(zs)], "i int, z double").select("i", stats.normal_share(F.col("z")).alias("q")).orderBy("i").collect()]
    assert got == pytest.approx([0.5 * math.erfc(-z / math.sqrt(2)) for z in zs], abs=1e-14)


def test_honest_score_of_a_year(spark):
    """Formula by hand on an annualised Sharpe; a run of any number of trials stays."""
    rng = random.Random(2)
    series = {f"r{k}": [rng.gauss(0.001, 0.01) for _ in range(250)] for k in range(3)} | {"flat": [0.0] * 50, "short": [0.01, 0.02]}
    trials = {"r0": 1, "r1": 3, "r2": 5000, "flat": 50, "short": 2}
    m = stats.moments(curve(spark, series), ("run",), periods=252).withColumn("trials", F.element_at(F.create_map(*[F.lit(x) for p in trials.items() for x in p]), F.col("run")))
    got = {r["run"]: r for r in stats.honest_scores(m).collect()}
    assert set(got) == set(series)
    for run, xs in series.items():
        x, n = np.array(xs), len(xs)
        std = x.std(ddof=1)
        sr = x.mean() / std * math.sqrt(252) if std > 0 else 0.0
        skew, kurt = 0.0, 3.0
        if n > 3 and std > 1e-9:
            d = x - x.mean()
            g1, g2 = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
            skew, kurt = g1 * math.sqrt(n * (n - 1)) / (n - 2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3
        se = math.sqrt(max(0.0, 1 + sr**2 / 2 - skew * sr + (kurt - 3) / 4 * sr**2) / n)
        q, k = NormalDist().inv_cdf, trials[run]
        cut = se * ((1 - stats.EULER) * q(1 - 1 / k) + stats.EULER * q(1 - 1 / (k * math.e))) if k > 1 else 0.0
        assert got[run]["honest"] == pytest.approx(sr - 1.65 * se - cut)
        assert got[run]["deflated"] == pytest.approx(NormalDist().cdf((sr - cut) / se) if n >= 4 else 0.0)


def test_overfitting_counts_ties_as_high(spark):
    """One run that trades and two that don't: equal results out of sample rank with the winner's."""
    rng = random.Random(5)
    xs = [rng.gauss(0, 1) for _ in range(40)]
    got = stats.overfitting(curve(spark, {"a": xs, "b": [0.0] * 40, "c": [0.0] * 40}), 4).first()
    low = 0
    for own in itertools.combinations(range(4), 2):
        part = lambda keep: np.array([x for i, x in enumerate(xs) if (i // 10 in own) == keep])
        score = lambda v: v.mean() / v.std(ddof=1)
        seen, unseen = [score(part(True)), 0.0, 0.0], [score(part(False)), 0.0, 0.0]
        won = unseen[int(np.argmax(seen))]
        low += sum(u <= won for u in unseen) / 4 <= 0.5
    assert got["pbo"] == pytest.approx(low / 6) and got["n_splits"] == 6
    assert stats.overfitting(curve(spark, {"a": xs})).first()["pbo"] == 0.0
    assert stats.overfitting(curve(spark, {"a": xs[:3], "b": xs[3:6]})).first()["pbo"] == 0.0
    assert len(stats.splits(16)) == 4096 and stats.splits(16)[1][1] == list(list(itertools.combinations(range(16), 8))[3])


def test_reality_check_cuts_to_the_last_common_bars(spark):
    rng = random.Random(7)
    a, b = [rng.gauss(0.05, 1) for _ in range(60)], [rng.gauss(0, 1) for _ in range(40)]
    whole = stats.reality_check(curve(spark, {"a": a, "b": b, "one": [9.0]}), 50, 5, 3).first()
    cut = stats.reality_check(curve(spark, {"a": a[20:], "b": b}), 50, 5, 3).first()
    assert whole["p_value"] == cut["p_value"] and whole["best"] == pytest.approx(max(np.mean(a[20:]), np.mean(b)) * math.sqrt(40))
    assert stats.reality_check(curve(spark, {"one": [9.0]}), 10).first()["p_value"] == 1.0


def test_monte_carlo_by_hand(spark):
    xs = [0.1, -0.2, 0.3, 0.0, -0.6, 0.2]
    frame = curve(spark, {"a": xs})
    draws = {}
    for r in stats.bootstrap(frame, 30, 3, 4, ("run",)).collect():
        draws.setdefault(r["replication"], {})[r["pos"]] = r["source"]
    totals, ruin = [], 0
    for own in draws.values():
        path = np.cumprod([1 + xs[own[t]] for t in range(6)])
        totals.append(path[-1] - 1)
        ruin += (path / np.maximum.accumulate(path) - 1).min() <= -0.5
    got = stats.monte_carlo(frame, 30, 3, 4, ("run",)).first()
    assert [got["p5"], got["p50"], got["p95"]] == pytest.approx(np.percentile(totals, [5, 50, 95]).tolist()) and got["ruin"] == ruin / 30


def test_empty_series_divide_by_nothing(spark):
    none = curve(spark, {}) if False else spark.createDataFrame([], "run string, bar_ix int, net double")
    assert stats.calibration(none.select(F.col("net").alias("score")), 0.0).first()["fdr"] == 0.0
    assert ledger.repeat_failures(spark.createDataFrame([], "reason string, market string, at int"), spark.createDataFrame([], "reason string, market string, at int")).first()["rate"] == 0.0
    trades = spark.createDataFrame([("a", 0.1, True), ("b", 0.2, False), ("c", -0.1, False)], "run string, net_return double, open_at_end boolean")
    got = {r["run"]: tuple(r)[3:] for r in metrics.trade_summary(trades, ("run",)).collect()}
    assert got == {"a": (0.0, 0.0, 0.0), "b": (0.0, 1.0, 0.2), "c": (0.0, 0.0, -0.1)}
    lost = curve(spark, {"a": [0.1, -1.0, 0.2]})
    assert metrics.summary(lost, 252, ("run",)).first()["cagr"] == 0.0


# Monitoring
@pytest.mark.parametrize("z, p, weak, n, want", [((-2.5, 0, 0), 1.0, True, 30, "yellow"), ((-1.6, 0, 0), 1.0, False, 30, "yellow"), ((0, 0, 0), 0.03, False, 30, "green"), ((0, 0, 0), 0.009, False, 30, "red"), ((-1.6, -1.6, 0), 1.0, False, 30, "orange"), ((-1.6, -1.6, 0), 1.0, True, 30, "yellow"), ((-3.1, 0, 0), 1.0, True, 30, "orange"), ((-3.1, 0, 0), 0.001, False, 19, "green"), ((-1.5, -1.5, -1.5), 0.01, False, 20, "green")])
def test_health(spark, z, p, weak, n, want):
    row = spark.createDataFrame([(*map(float, z), p, weak, n)], "z_sharpe double, z_win double, z_trade double, p_loss double, weak_regime boolean, n_trades int")
    assert monitor.level(row).first()["level"] == want


def test_z_scores_by_hand(spark):
    rng = random.Random(3)
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    net = [rng.gauss(0.01, 0.05) for _ in days]
    marked = monitor.eras(spark.createDataFrame([(i, d, x) for i, (d, x) in enumerate(zip(days, net))], "bar_ix int, date date, net double"), "2001-02-09")
    rows = [(days[i], net[i] * 3, i == 58) for i in range(0, 60, 2)]
    got = monitor.z_scores(marked, spark.createDataFrame(rows, "entry_date date, net_return double, open_at_end boolean"), "2001-02-09", 252).first()
    old, new = np.array(net[:40]), np.array(net[40:])
    sr = lambda x: x.mean() / x.std(ddof=1) * math.sqrt(252)
    d, n = new - new.mean(), len(new)
    g1, g2 = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
    skew, kurt = g1 * math.sqrt(n * (n - 1)) / (n - 2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3
    s = sr(new)
    assert got["z_sharpe"] == pytest.approx((s - sr(old)) / math.sqrt((1 + s * s / 2 - skew * s + (kurt - 3) / 4 * s * s) / n))
    before, after = np.array([r[1] for r in rows[:20]]), np.array([r[1] for r in rows[20:] if not r[2]])
    win = (before > 0).mean()
    assert got["z_win"] == pytest.approx(((after > 0).mean() - win) / math.sqrt(win * (1 - win) / len(after)))
    assert got["z_trade"] == pytest.approx((after.mean() - before.mean()) / (before.std(ddof=1) / math.sqrt(len(after)))) and got["n_trades"] == len(after)


def test_ks_p_value_by_every_order():
    """All ways to lay two samples in a row are as likely; the p-value is the share that is as far apart."""
    for n, m in ((2, 3), (4, 4), (3, 6)):
        found = []
        for own in itertools.combinations(range(n + m), n):
            a = np.cumsum([k in own for k in range(n + m)]) / n
            b = np.cumsum([k not in own for k in range(n + m)]) / m
            found.append(np.abs(a - b).max())
        for d in {round(x, 9): x for x in found}.values():
            assert monitor.ks_p_value(float(d), n, m) == pytest.approx(np.mean(np.array(found) >= d - 1e-9))


# Spec graphs
def chain(name, first, n=12, level="threshold"):
    nodes = [(name, "n0", first, "1", "price.close", "filter"), *((name, f"n{k}", "rolling_mean", "1", f"n{k - 1}", "filter") for k in range(1, n))]
    return [*nodes, (name, "level", level, "1", f"n{n - 1}", "filter")]


NODES = "spec_id string, node string, operator string, version string, input string, role string"


def test_deep_specs(spark):
    frame = spark.createDataFrame(chain("raw", "rolling_mean") + chain("free", "frac_diff") + chain("sign", "rolling_mean", level="crossover"), NODES)
    assert {r["spec_id"] for r in specs.absolute_levels(frame).collect()} == {"raw"}
    assert {(r["spec_id"], r["operator"]) for r in specs.usage(frame).collect()} == {("raw", "threshold"), ("raw", "rolling_mean"), ("free", "threshold"), ("free", "rolling_mean"), ("free", "frac_diff"), ("sign", "crossover"), ("sign", "rolling_mean")}


def test_usage_is_of_a_role_s_roots(spark):
    rows = [("a", "fast", "ema", "1", "price.close", "entry"), ("a", "x", "crossover", "1", "fast", "entry"), ("a", "v", "atr", "1", "price.high", "exit"), ("a", "e", "threshold", "1", "v", "exit")]
    assert {(r["role"], r["operator"]) for r in specs.usage(spark.createDataFrame(rows, NODES)).collect()} == {("entry", "ema"), ("entry", "crossover"), ("exit", "atr"), ("exit", "threshold")}


def test_near_duplicates_keep_every_link(spark):
    rng = random.Random(4)
    rows, sets = [], {}
    for spec in range(80):
        own = rng.sample(range(12), rng.randint(1, 9)) if spec % 3 else list(range(spec % 2, 9))
        sets[spec] = (spec % 2, frozenset(own))
        rows += [(spec % 2, spec, f"o{x}", "1", "entry") for x in own]
    got = {r["spec_id"]: (r["class_id"], r["n_links"]) for r in ledger.near_duplicates(spark.createDataFrame(rows, "family int, spec_id int, operator string, version string, role string")).collect()}
    for a, (family, own) in sets.items():
        near = [b for b, (f, x) in sets.items() if b != a and f == family and 5 * len(own & x) >= 4 * len(own | x)]
        assert got[a] == (min(b for b, y in sets.items() if y == sets[a]), len(near))


# Bars
def test_zero_volume(spark):
    rows = [("neg", v) for v in [5.0] * 30 + [-1.0]] + [("none", v) for v in [5.0, None]] + [("zero", 0.0)] + [("fine", 1.0)]
    got = {r["instrument"]: r["detail"] for r in barquality.zero_volume(spark.createDataFrame(rows, "instrument string, volume double")).collect()}
    assert got == {"neg": 1 / 31, "zero": 1.0}


def test_one_instrument_is_no_universe(spark):
    bars = spark.createDataFrame([("a", dt.date(2000, 1, 1)), ("a", dt.date(2010, 1, 1))], "instrument string, date date")
    assert barquality.narrow_universe(bars, 50).count() == 0 and barquality.narrow_universe(bars.union(bars.withColumn("instrument", F.lit("b"))), 50).count() == 1


def some_bars(spark, n=80, instruments=2, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(instruments):
        price = 100.0
        for t in range(n):
            price *= math.exp(rng.gauss(0, 0.02))
            rows.append((f"i{k}", t, dt.date(2001, 1, 1) + dt.timedelta(days=14 * t), price, price * 1.01, price * 0.99, price, 1000.0))
    return spark.createDataFrame(rows, "instrument string, bar_ix int, date date, open double, high double, low double, close double, volume double")


def test_truncation_finds_a_look_ahead(spark):
    bars = some_bars(spark)
    honest = checks.truncations(bars, lambda f: w.rolling_mean(F.col("close"), 5)).collect()
    assert {r["cut"] for r in honest} == {0.5, 0.7, 0.85} and not any(r["n_differ"] for r in honest)
    assert {(r["cut"], r["n"]) for r in honest} == {(0.5, 35), (0.7, 51), (0.85, 63)}
    cheat = checks.truncations(bars, lambda f: F.avg("close").over(w.Window.partitionBy("instrument"))).collect()
    assert all(r["n_differ"] == r["n"] for r in cheat)


def test_bar_and_gates(spark):
    runs = spark.createDataFrame([("a", 10, 0.5, -1.0, 0.1), ("b", 100, 0.1, 1.0, 0.1)], "run string, n_trades int, max_drawdown double, total double, breadth double")
    got = {r["run"]: (r["failures"], r["reason"], r["passed"]) for r in checks.bar_verdict(runs).collect()}
    assert got == {"a": (["min_trades", "max_drawdown", "cost_stress"], "insufficient_trades", False), "b": ([], None, True)}
    bars = spark.createDataFrame([("i", t, dt.date(2001, 1, 1) + dt.timedelta(days=t), float(t % 2), 10.0, v, 0.3, 0.1, 0.06) for t, v in enumerate([1.0, 0.0, 100.0] * 4)], "instrument string, bar_ix int, date date, weight double, close double, volume double, gross double, cost double, funding double")
    rows = {r["test_name"]: r for r in checks.equities_gate(bars, 100.0, None, False, False).collect()}
    assert rows["equities_survivorship"]["outcome"] == rows["equities_capacity"]["outcome"] == "warn" and rows["equities_capacity"]["value"] == pytest.approx(10.0)
    rows = {r["test_name"]: r["outcome"] for r in checks.equities_gate(bars, 1.0, 0.2, True, True).collect()}
    assert rows == {"equities_survivorship": "pass", "equities_capacity": "pass"}
    rows = {r["test_name"]: (r["outcome"], r["value"]) for r in checks.crypto_gate(bars).collect()}
    assert rows == {"crypto_funding_sensitivity": ("pass", 3.0), "crypto_venue_robustness": ("warn", None)}
    short = bars.limit(9).select("date", F.col("gross").alias("net"))
    assert {r["test_name"]: r["outcome"] for r in checks.crypto_gate(bars, short).collect()}["crypto_venue_robustness"] == "warn"
    ticks = spark.createDataFrame([(dt.datetime(2001, 1, 1, h), x, 0.1) for h, x in ((1, 5.0), (2, -4.0), (9, 0.5), (20, -0.5))], "ts timestamp, pnl double, carry double")
    rows = {r["test_name"]: (r["outcome"], r["value"]) for r in checks.forex_gate(ticks).collect()}
    assert rows["forex_session_dependence"] == ("pass", 0.5) and rows["forex_carry_decomposition"] == ("pass", pytest.approx(0.04))
    assert {r["outcome"] for r in checks.forex_gate(ticks, intraday=False).collect()} == {"warn", "pass"}


def test_regimes_of_two_markets(spark):
    """Markets are keys: each has its own median, drawdown and volatility."""
    rng = random.Random(9)
    rows = [(m, t, rng.gauss(0, 0.01 * k)) for k, m in enumerate("ab", 1) for t in range(40)]
    both = spark.createDataFrame(rows, "market_id string, bar_ix int, market double")
    got = {(r["market_id"], r["bar_ix"]): r for r in regimes.trailing(both, 5, ("market_id",)).collect()}
    for m in "ab":
        xs = [x for k, _, x in rows if k == m]
        vols = [np.std(xs[t - 5 : t]) if t >= 5 else None for t in range(40)]
        for t in range(40):
            seen = [v for v in vols[: t + 1] if v is not None]
            assert got[m, t]["reference"] == (pytest.approx(np.median(seen)) if seen else None)


# Walk-forward
def test_grid_draws_places_of_a_large_product(spark):
    space = {"a.x": list(range(100)), "b": list(range(1000)), "c": list(range(10**6))}
    rows = walkforward.grid(spark, space, 50, 3).collect()
    assert len({r["params_ix"] for r in rows}) == 50
    for r in rows:
        i = r["params_ix"]
        assert (r["a.x"], r["b"], r["c"]) == (i // 10**9, i // 10**6 % 1000, i % 10**6)
    assert [tuple(r) for r in walkforward.grid(spark, {"a": [1, 2], "b": [3]}).collect()] == [(0, 1.0, 3.0), (1, 2.0, 3.0)]


def test_any_rule_is_tuned_and_scored(spark):
    """A rule of columns with a node's parameters, the same one as a function, and a campaign of single specs."""
    bars = some_bars(spark, 140)
    folds = walkforward.folds(bars.agg(F.min("date").alias("first"), F.max("date").alias("last")), [1, 2], 1, 7)
    sliced = walkforward.slices(bars, folds)
    params = walkforward.grid(spark, {"level.lookback": [2, 4], "level.cut": [0.0, 0.02]})

    def columns(sliced, params):
        runs = sliced.withColumns({f"m{n}": F.col("close") / F.lag("close", n).over(w.by_bar((*walkforward.RUN[:3], "instrument"))) - 1 for n in (2, 4)}).crossJoin(F.broadcast(params))
        p = walkforward.override(params, "level", lookback=3, cut=0.5, side=1.0)
        move = F.when(p["lookback"] == 2, F.col("m2")).otherwise(F.col("m4"))
        return runs.withColumn("signal", F.when(move > p["cut"], p["side"]).when(move < -p["cut"], -p["side"]).otherwise(0.0)).select(*sliced.columns, "params_ix", "signal")

    def function(pdf, p):
        move = pdf["close"].pct_change(int(p["level.lookback"]))
        return (move > p["level.cut"]).astype(float) - (move < -p["level.cut"])

    keys = [*walkforward.RUN, "date"]
    a, b = (walkforward.run_returns(sliced, params, rule) for rule in (columns, walkforward.by_function(function)))
    left, right = ({tuple(r[k] for k in keys): r["net"] for r in x.collect()} for x in (a, b))
    assert left == pytest.approx(right) and any(left.values())
    results = walkforward.fold_results(a, 26, 10, 5)
    assert results.count() == folds.count()
    scores = {(r["params_ix"], r["train_years"]): r["sharpe"] for r in a.filter("part = 'test'").groupBy("params_ix", "train_years").agg(metrics.sharpe(F.col("net"), 26).alias("sharpe")).collect()}
    got = {r["params_ix"]: r for r in walkforward.campaign(bars, params, columns, [1, 2], 26).collect()}
    assert set(got) == {0, 1, 2, 3}
    for k, r in got.items():
        assert r["sharpe"] == pytest.approx(max(scores[k, 1], scores[k, 2])) and r["spread"] == pytest.approx(abs(scores[k, 1] - scores[k, 2]))
    with pytest.raises(ValueError):
        walkforward.override(params, "level", lookback=3)


# Streaming
TICK = "event_id long, ts timestamp, user_id long, value double"


def ticks(spark, folder, batches):
    """One file a batch, read one at a time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, dt.datetime(2001, 1, 1) + dt.timedelta(minutes=m), 1, v) for i, m, v in rows], TICK).coalesce(1).write.parquet(f"{folder}/{k}")
    return lambda n: spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(f"{folder}/[0-{n - 1}]")


def test_state_and_late_rows_over_batches(spark, tmp_path):
    """Rows out of order are stepped in order as long as none after them was (5); later ones are dropped (9); what isn't final waits (8)."""
    of = ticks(spark, str(tmp_path / "in"), [[(1, 0, 1.0), (3, 40, 1.0)], [(2, 20, 1.0), (4, 100, 2.0)], [(5, 30, 9.0), (6, 200, 2.0), (7, 190, 2.0)], [(8, 400, 2.0), (9, 35, 7.0)]])
    step = jobs.stale_run()
    out = jobs.finish(jobs.stateful(of(4), "user_id", ["value"], step, "1 hour"), log=str(tmp_path / "log"), table=str(tmp_path / "out"))
    assert sorted((r["event_id"], r["value"]) for r in out.collect()) == [(1, 1.0), (2, 2.0), (3, 1.0), (4, 1.0), (5, 1.0), (6, 3.0), (7, 2.0)]


def test_no_worker_holds_a_key_s_rows(spark, tmp_path):
    """The step sees no more in its worker's memory with 200,000 rows of a key than with 10."""

    def step(state, row):
        return state, float(sys.getallocatedblocks())

    def most(n):
        spark.range(n).selectExpr("id AS event_id", "timestamp_seconds(1000000000 + id) AS ts", "1L AS user_id", "1D AS value").write.parquet(f"{tmp_path}/in{n}")
        return jobs.finish(jobs.stateful(spark.readStream.schema(TICK).parquet(f"{tmp_path}/in{n}"), "user_id", ["value"], step, "0 seconds")).agg(F.max("value")).first()[0]

    assert most(200_000) < most(10) + 400_000


def test_state_goes_on_and_is_forgotten(spark, tmp_path):
    """Two keys over three calls: states and waiting rows are those of the call before, and a state ends with its time."""
    days = lambda n: dt.datetime(2001, 1, 1) + dt.timedelta(days=n)

    def call(k, *rows):
        spark.createDataFrame([(i, days(d), u, v) for i, d, u, v in rows], TICK).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(TICK).parquet(f"{tmp_path}/in/*")
        out = jobs.finish(jobs.stateful(source, "user_id", ["value"], jobs.stale_run(), "1 day", 10.0), log=str(tmp_path / "log"), table=str(tmp_path / "out"))
        return sorted((r["event_id"], r["user_id"], r["value"]) for r in out.collect())

    first = [(1, 1, 1.0), (2, 2, 1.0), (3, 1, 2.0)]
    assert call(0, (1, 0, 1, 7.0), (2, 1, 2, 7.0), (3, 2, 1, 7.0), (4, 5, 1, 7.0), (5, 6, 2, 8.0)) == sorted([*first, (4, 1, 3.0)])
    second = sorted([*first, (4, 1, 3.0), (5, 2, 1.0)])
    assert call(1, (6, 20, 1, 7.0)) == second
    assert call(2, (7, 21, 2, 8.0), (8, 30, 1, 7.0)) == sorted([*second, (6, 1, 4.0), (7, 2, 1.0)])


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    spark.createDataFrame([(1, dt.datetime(2001, 1, 1), 1, 1.0)], TICK).write.parquet(str(tmp_path / "in/0"))
    source = lambda: spark.readStream.schema(TICK).parquet(f"{tmp_path}/in/*")
    where = {"log": str(tmp_path / "log"), "table": str(tmp_path / "out")}
    run = lambda: sorted(r["event_id"] for r in jobs.finish(jobs.once_each(source(), ["event_id"]), **where).collect())
    assert run() == [1] and run() == [1]
    spark.createDataFrame([(1, dt.datetime(2001, 1, 1), 1, 1.0), (2, dt.datetime(2001, 1, 2), 1, 1.0)], TICK).write.parquet(str(tmp_path / "in/1"))
    assert run() == [1, 2]


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    write = jobs.sink(str(tmp_path / "t"))
    for number, n in ((0, 3), (1, 2), (1, 2), (0, 3)):
        write(spark.range(n), number)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_windows_close_with_the_watermark(spark, tmp_path):
    of = ticks(spark, str(tmp_path / "in"), [[(1, 0, 1.0)], [(2, 300, 1.0), (3, 350, 1.0), (6, 450, 1.0)], [(5, 1000, 1.0)], [(4, 10, 5.0)]])
    spent = jobs.finish(jobs.budgets(of(4).withColumn("event_type", F.lit("x")), "6 hours"))
    assert sorted((r["used"], r["n"]) for r in spent.collect()) == [(1.0, 1), (3.0, 3)]
    runs = jobs.finish(jobs.sessions(of(4), "2 hours"))
    assert sorted((r["start"].hour, r["n"]) for r in runs.collect()) == [(0, 1), (5, 3)]


def test_live_flags():
    step, st, out = jobs.live_flags(0.3, 2, 5.0), None, []
    for row in [(1.0, 10.0, 5.0, 0.0), (2.0, 14.0, 0.0, 0.0), (3.0, 20.0, None, 1.0), (9.0, 20.0, 5.0, 0.0), (10.0, 20.0, -1.0, 0.0)]:
        st, v = step(st, row)
        out.append(v)
    assert out == [0.0, 3.0, 0.0, 8.0, 6.0]


# Queries without SQL
def test_rolling_pca(spark):
    bars = some_bars(spark, 60, 1).select("instrument", "bar_ix", "close")
    got = {r["bar_ix"]: r["value"] for r in pca.rolling_pca(bars, "close", 20, 3, "value").collect()}
    xs = np.array([r["close"] for r in bars.orderBy("bar_ix").collect()])
    assert all(got[t] is None or math.isnan(got[t]) for t in range(19))
    checked = 0
    for t in range(25, 60):
        lagged = np.stack([xs[t - 19 - k : t + 1 - k] for k in range(3)], axis=1)
        centred = lagged - lagged.mean(axis=0)
        axis = np.linalg.svd(centred, full_matrices=False)[2][0]
        if got[t] is not None:
            checked += math.isclose(abs(got[t]), abs(centred[-1] @ axis), rel_tol=1e-6)
    assert checked == 35


def test_cluster_weights(spark):
    rng = random.Random(1)
    base = [rng.gauss(0, 1) for _ in range(12)]
    other = [rng.gauss(0, 1) for _ in range(12)]
    rows = [(n, t, dt.date(2001, 1, 1) + dt.timedelta(days=t), float(v)) for n, xs in (("a", base), ("b", [2 * x for x in base]), ("c", other)) for t, v in enumerate(xs)]
    got = {(r["instrument"], r["bar_ix"]): r["weight"] for r in clusters.cluster_weights(spark.createDataFrame(rows, "instrument string, bar_ix long, date date, ret double"), 10, 2, 2).collect()}
    assert got["a", 8] is None and [got[k, 11] for k in "abc"] == [0.25, 0.25, 0.5]
    assert clusters.average_linkage(np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]]), 2) == [0, 0, 1]


def test_average_linkage_is_the_plain_one():
    """Against merging by the means over all pairs of members; rounded distances make ties."""
    rng = np.random.default_rng(3)
    for n, groups, digits in [(1, 1, 9), (2, 1, 9), (9, 3, 9), (30, 4, 9), (30, 1, 9), (12, 3, 0), (20, 5, 1)]:
        points = rng.normal(size=(n, 3))
        distance = np.round(np.linalg.norm(points[:, None] - points[None], axis=2), digits)
        members = [[i] for i in range(n)]
        while len(members) > groups:
            gaps = {(i, j): round(distance[np.ix_(members[i], members[j])].mean(), 12) for i in range(len(members)) for j in range(i + 1, len(members))}
            i, j = min(gaps, key=lambda k: (gaps[k], k))
            members[i] += members.pop(j)
        want = {frozenset(m) for m in members}
        label = clusters.average_linkage(distance, groups)
        got = {frozenset(i for i in range(n) if label[i] == k) for k in set(label)}
        assert len(got) == groups and [min(m) for m in sorted(got, key=lambda m: label[min(m)])] == sorted(min(m) for m in got)
        if digits == 9:
            assert got == want


def test_correlations_in_tiles(spark, monkeypatch):
    """Several tiles, with missing bars, nulls and a flat series, against each pair by itself."""
    monkeypatch.setattr(clusters, "TILE", 3)
    rng = np.random.default_rng(8)
    series = {f"i{k}": rng.normal(0.01, 0.02, 14) for k in range(10)} | {"flat": np.full(14, 0.1)}
    gone = {("i1", 5), ("i2", 12), ("i3", 13)}
    rows = [(n, t, None if (n, t) == ("i4", 9) else float(v)) for n, xs in series.items() for t, v in enumerate(xs) if (n, t) not in gone]
    early = [("early", t, 0.1 * t) for t in range(3)]  # has no bar in common with `late` before the second rebalance, nor any then
    late = [("late", t, 0.1 * t) for t in range(5, 14)]
    frame = spark.createDataFrame(rows + early + late, "instrument string, bar_ix long, ret double")
    every = {(r["at"], r["a"], r["b"]) for r in clusters.pair_correlations(frame, 10, 3).collect()}
    assert not {k for k in every if {"early", "late"} <= set(k)} and (9, "early", "i0") in every and (12, "early", "i0") not in every
    frame = spark.createDataFrame(rows, "instrument string, bar_ix long, ret double")
    got = {(r["at"], r["a"], r["b"]): r["rho"] for r in clusters.pair_correlations(frame, 10, 3).collect()}
    have = {(n, t): v for n, t, v in rows if v is not None}
    assert len(got) == 2 * 11 * 10 // 2
    for (at, a, b), rho in got.items():
        both = [(have[a, t], have[b, t]) for t in range(at - 9, at + 1) if (a, t) in have and (b, t) in have]
        assert a < b and at in (9, 12) and (rho is None if "flat" in (a, b) else rho == pytest.approx(np.corrcoef(np.array(both).T)[0, 1]))


def test_chunks_of_pages(spark):
    pages = {r["page_id"]: r["text"] for r in registry.QUERIES["n6_pages_text"](spark, DATA).collect()}
    own = {}
    for r in registry.QUERIES["n10_chunks"](spark, DATA).collect():
        own.setdefault(r["page_id"], []).append((r["chunk"], r["title"], r["start"], r["end"], r["text"]))
    for page, text in pages.items():
        parts = sorted(own.get(page, []))
        assert [p[0] for p in parts] == list(range(len(parts))) and all(text[a:z] == t for _, _, a, z, t in parts)
        heads = [i for i in range(len(text)) if text.startswith("# ", i) and (i == 0 or text[i - 1] == "\n")]
        assert "".join(p[4] for p in parts) == text and {p[2] for p in parts if p[1]} >= set(heads)
        assert all(z - a <= documents.LONGEST or "\n\n" not in t.strip("\n") for _, _, a, z, t in parts)
    capped = {r["page_id"]: r["n"] for r in registry.QUERIES["n18_chunk_cap"](spark, DATA).collect()}
    assert capped == {k: min(documents.PER_DOCUMENT, len(v)) for k, v in own.items()}


def test_content_hash(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"f{n}.bin").write_bytes(bytes([n]) * 10)
    files = [hashlib.sha256(f"{p.name}:{hashlib.sha256(p.read_bytes()).hexdigest()}".encode()).hexdigest() for p in map(type(tmp_path), glob.glob(f"{tmp_path}/*"))]
    groups = {}
    for h in files:
        groups.setdefault(h[:4], []).append(h)
    want = hashlib.sha256("\n".join(sorted(p + hashlib.sha256("\n".join(sorted(v)).encode()).hexdigest() for p, v in groups.items())).encode()).hexdigest()
    assert archive.content_hash(spark, str(tmp_path)).first()["content_hash"] == want
    one, two = ({"f": f} for f in ("a", "b"))
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "k int, f string")
    assert archive.version_of(frame, ["k"], ["f"]).first() == archive.version_of(frame.orderBy(F.desc("k")), ["k"], ["f"]).first() and one != two
    assert archive.version_of(frame, ["k"], ["f"]).first() != archive.version_of(spark.createDataFrame([(1, "b"), (2, "a")], "k int, f string"), ["k"], ["f"]).first()


def test_content_hash_of_large_files(spark, tmp_path):
    """Files beyond a size are read by many tasks, and every byte counts: hashes of blocks, of lists of blocks, of the file."""
    rng, sha = random.Random(3), lambda x: hashlib.sha256(x).hexdigest()
    made = {"r+ a%20b": rng.randbytes(70_000), "lines": b"\n" * 5000, "end": b"ab\r\n" * 900 + b"\n", "none": b"x" * 3000, "mark": b"\xef\xbb\xbf" + rng.randbytes(3000), "marked": b"\xef\xbb\xbf" + b"q\n" * 1000, "small": b"s" * 1000, "z.gz": gzip.compress(rng.randbytes(4000))}
    for n, x in made.items():
        (tmp_path / n).write_bytes(x)

    def of_file(name, x, block=64):
        if len(x) <= 1000 or name.endswith(".gz"):
            return sha(x)
        blocks = [sha(x[i : i + block]) for i in range(0, len(x), block)]
        return sha("\n".join(sha("\n".join(blocks[i : i + archive.LISTED]).encode()) for i in range(0, len(blocks), archive.LISTED)).encode())

    groups = {}
    for h in (sha(f"{n}:{of_file(n, x)}".encode()) for n, x in made.items()):
        groups.setdefault(h[:4], []).append(h)
    want = sha("\n".join(sorted(p + sha("\n".join(sorted(v)).encode()) for p, v in groups.items())).encode())
    names = {"spark.sql.files.maxPartitionBytes": ["1000", "128m"], "spark.sql.files.openCostInBytes": ["1", "1"]}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for values in zip(*names.values()):
            for k, v in zip(names, values):
                spark.conf.set(k, v)
            assert archive.content_hash(spark, str(tmp_path), large=1000, block=64).first()["content_hash"] == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_answers_meet_in_more_partitions_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(ledger, "ANSWERS", 50, raising=False)
    questions = spark.range(100).selectExpr("id AS question_id", "1 AS priority", "array(id) AS ids")
    findings = spark.range(1000).selectExpr("id AS finding_id", "array(id % 100, id % 100 + 1000) AS ids")
    got = ledger.answered(questions, findings)
    assert {(r["question_id"], r["n_answers"], tuple(r["ids"])) for r in got.collect()} == {(i, 10, (i, i + 1000)) for i in range(100)}
    assert "hashpartitioning(question_id" in (plan := got._jdf.queryExecution().toString()) and ", 20)" in plan


def test_flags_are_resolved_by_people(spark):
    flags = spark.createDataFrame([(1, "pending"), (2, "pending")], "flag_id int, resolution string")
    of = lambda *rows: spark.createDataFrame(list(rows), "flag_id int, resolution string, resolved_by string, resolved_at int")
    got = barquality.resolve(flags, of((1, "data_error", "a", 1), (1, "genuine_move", "b", 2))).collect()
    assert {(r["flag_id"], r["resolution"], r["resolved_by"]) for r in got} == {(1, "genuine_move", "b"), (2, "pending", None)}
    for bad in ((1, "pending", "a", 1), (1, "data_error", " ", 1), (1, None, "a", 1)):
        with pytest.raises(ValueError):
            barquality.resolve(flags, of(bad))


def test_marks_add_up(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, engine string")
    once = ledger.mark_incomparable(frame, engine="a")
    assert [r["comparable"] for r in ledger.mark_incomparable(once, id=2).orderBy("id").collect()] == [False, False, True]


def test_import_counts(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", None), ("b", None)], "instrument string, verified_by string")
    assert tuple(archive.import_summary(rows).first()) == (3, 2, 2) and tuple(archive.import_summary(rows.drop("verified_by")).first()) == (3, 2)


def test_sections_name_a_long_value_once(spark):
    """Lines, headings and sections are worked out once a page, not for each of their elements."""
    plan = spark.range(1).select(documents.sections(F.concat_ws("\n", F.col("id"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("aggregate(") == 1


def test_nearest_in_blocks(spark, monkeypatch):
    """Blocks of queries and corpus, with copies that tie, a zero, a null and no pair as a row."""
    draw = random.Random(3)
    own = [[draw.choice([-1.0, 0.5, 2.0]) for _ in range(3)] for _ in range(120)]
    own[7], own[8] = [0.0, 0.0, 0.0], None
    frame = spark.createDataFrame(list(enumerate(own)), "vec_id long, embedding array<float>")
    monkeypatch.setattr(documents, "CORPUS_ROWS", 16)
    monkeypatch.setattr(documents, "QUERY_ROWS", 3)
    found = documents.nearest(frame.filter("vec_id % 10 = 7 OR vec_id = 8"), frame, 4)
    assert "vec_id <> query_id" not in found._jdf.queryExecution().toString() and "MapInArrow" in found._jdf.queryExecution().toString()

    def score(a, b):
        if a is None or b is None or not any(a) or not any(b):
            return 0.0
        dot = lambda x, y: sum((p * q for p, q in zip(x, y)), 0.0)
        return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))

    want = {(q, i, place) for q in (*range(7, 120, 10), 8) for place, (_, i) in enumerate(sorted((-score(own[i], own[q]), i) for i in range(120) if i != q)[:4], 1)}
    assert {(r["query_id"], r["vec_id"], r["place"]) for r in found.collect()} == want


def test_novelty_in_blocks(spark, monkeypatch):
    """Vectors meet in blocks, not row by row; null, zero, short and repeated vectors, and ids that are null in the history."""
    monkeypatch.setattr(documents, "CORPUS_ROWS", 3)
    monkeypatch.setattr(documents, "QUERY_ROWS", 2)
    rng = random.Random(3)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    new = [(1, vector()), (2, vector()), (2, vector()), (3, None), (4, [0.0] * 4), (5, vector()), (None, vector())]
    old = [(None if i == 4 else i, vector()) for i in range(10)] + [(11, None), (12, [0.0] * 4), (13, [1.0])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = documents.novelty(frame(new), frame(old))
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    single = lambda x: np.array(x, np.float32).astype(float)

    def cosine(x, y):
        if x is None or y is None or not np.linalg.norm(x) * np.linalg.norm(y):
            return 0.0
        return float(single(x) @ single(y) / (np.linalg.norm(single(x)) * np.linalg.norm(single(y)))) if len(x) == len(y) else -1.0

    want = {i: 1 - max(cosine(x, y) for k, x in new if k == i for _, y in old) for i in (1, 2, 3, 4, 5)}
    got = [(r["vec_id"], r["novelty"]) for r in out.collect()]
    assert sorted(i for i, _ in got) == [1, 2, 2, 3, 4, 5] and all(v == pytest.approx(want[i]) for i, v in got)
    assert {r["novelty"] for r in documents.novelty(frame(new), frame([])).collect()} == {1.0}


def test_sums_follow_the_file(spark, tmp_path):
    """0.1 + 0.2 + 0.3 isn't 0.3 + 0.2 + 0.1: rows are added as they lie, however they are dealt and whichever comes first."""
    rows = [(k, v) for k, own in ((1, [0.1, 0.2, 0.3]), (2, [0.3, 0.2, 0.1]), (3, [None, 1e16, 1.0, -1e16]), (4, [None])) for v in own]
    spark.createDataFrame(rows, "k int, v double").coalesce(1).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t")).select("k", "v", F.col("_metadata.row_index").alias("i")).repartition(5).orderBy(F.desc("i"))
    got = {r["k"]: r["v"] for r in ledger.sums_in_order(read, "k", ["v"], ["i"]).collect()}
    assert got == {1: 0.1 + 0.2 + 0.3, 2: 0.3 + 0.2 + 0.1, 3: 1e16 + 1.0 - 1e16, 4: None} and got[1] != got[2]
