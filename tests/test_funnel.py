"""The funnel of many specs, and runs as keys of one frame."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barquet.operators import specs
from barquet.plans import backtest, checks, funnel, monitor, regimes, walkforward

CLOSE = {"series": "price.close"}


def n(spec, role, place, name, operator, params=None, inputs=CLOSE):
    return (spec, role, place, name, operator, None, params or {}, inputs)


@pytest.fixture(scope="module")
def bars(spark):
    """Three instruments over four years of weekly bars: one that trends by turns, two that wander."""
    rng = np.random.default_rng(5)
    start = datetime.date(2015, 1, 5)
    rows = []
    for k, i in enumerate("abc"):
        drift = np.repeat(rng.choice([-0.02, 0.02], 21), 10) if k == 0 else 0.0
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.008, 210) + drift))
        for b in range(210):
            x = float(close[b])
            rows.append((i, b, start + datetime.timedelta(weeks=b), x * 0.999, x * 1.01, x * 0.99, x, 1000.0))
    return spark.createDataFrame(rows, "instrument string, bar_ix long, date date, open double, high double, low double, close double, volume double")


def specs_of(spark):
    mom = lambda s, p, least="0": n(s, "entry", 0, "m", "momentum", {"period": p, "min_return": least})
    rows = [
        mom(1, "3"),
        mom(2, "2"),
        *[n(3, "entry", k, f"m{k}", "rolling_mean", {"window": "3"}) for k in range(9)],
        n(4, "entry", 0, "m", "momentum", {"perod": "3"}),
        mom(5, "3", "9"),
        n(6, "entry", 0, "m", "mean_reversion", {"window": "10", "entry_z": "0.2"}),  # against the trend
        n(7, "entry", 0, "s", "mean_reversion", {"window": "2", "entry_z": "0.1"}),
        mom(8, "3"),
        n(8, "risk", 0, "t", "time_stop", {"max_bars": "1"}, {}),
    ]
    return spark.createDataFrame(rows, specs.SCHEMA)


def test_phases_and_reasons(spark, bars):
    s = funnel.Settings(periods=52, train_years=(1, 2), bps=2.0, most_nodes=5, least_trades=10, most_drawdown=0.9, least_breadth=0.1)
    report = funnel.evaluate(bars, specs_of(spark), s)
    got = {r["spec_id"]: r for r in report.evaluations.collect()}
    assert set(got) == set(range(1, 9))
    assert (got[3]["phase"], got[3]["reason"]) == ("bar", "plateaued_below_bar")
    assert (got[4]["phase"], got[4]["reason"]) == ("p0", "code_error")
    assert (got[5]["phase"], got[5]["reason"]) == ("p1", "no_signal")
    assert (got[6]["phase"], got[6]["reason"]) == ("p2", "negative_expectancy")
    assert got[1]["phase"] == "p3" and got[1]["outcome"] == "passed"
    tests = {(r["spec_id"], r["test_name"]): r for r in report.tests.collect()}
    # a stopped spec has no row of a later phase
    order = ["bar", "p0", "p1", "p2", "p3"]
    for (spec, _), r in tests.items():
        assert order.index(r["phase"]) <= order.index(got[spec]["phase"])
    assert {x for x, _ in tests if (x, "p0_truncation_invariance") in tests} == {1, 2, 5, 6, 7, 8}
    regimes_of = {r["spec_id"] for r in report.regimes.collect()}
    assert regimes_of == {k for k, r in got.items() if r["phase"] == "p3"}
    # every number of p2 and p3 from a backtest of that spec alone
    held, _ = specs.structure(specs_of(spark).filter("spec_id = 1"))
    alone = backtest.run(funnel.compiled.signals_of(bars, held, carry=funnel.BARS), bps=2.0, keys=("spec_id",))
    sums = backtest.portfolio(alone, ("spec_id",)).agg(F.sum("gross"), F.sum("net")).first()
    assert tests[1, "p2_gross_expectancy"]["value"] == pytest.approx(sums[0]) and tests[1, "p2_cost_survival"]["value"] == pytest.approx(sums[1])
    span = bars.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    tests_of = walkforward.slices(bars, walkforward.folds(span, [got[1]["train_years"]], 1, 7)).filter("part = 'test'")
    fold_runs = backtest.run(funnel.compiled.signals_of(tests_of, held, keys=("fold", "instrument"), carry=funnel.BARS), bps=2.0, keys=("spec_id", "fold"))
    net = [r["net"] for r in backtest.portfolio(fold_runs, ("spec_id", "fold")).orderBy("date", "fold").collect()]
    equity = np.cumprod(1 + np.array(net))
    assert got[1]["total"] == pytest.approx(sum(net)) and got[1]["sharpe"] == pytest.approx(np.mean(net) / np.std(net, ddof=1) * math.sqrt(52))
    assert got[1]["max_drawdown"] == pytest.approx(-(equity / np.maximum.accumulate(equity) - 1).min(), abs=1e-9)


def test_the_bar_stops_in_p3(spark, bars):
    s = funnel.Settings(periods=52, train_years=(1,), bps=2.0, least_trades=10, most_drawdown=1e-6)
    got = {r["spec_id"]: r for r in funnel.evaluate(bars, specs_of(spark).filter("spec_id IN (1, 2)"), s).evaluations.collect()}
    assert all((r["phase"], r["outcome"], r["failed_on"], r["reason"]) == ("p3", "failed", "max_drawdown", "monte_carlo_ruin_risk") for r in got.values())
    s = funnel.Settings(periods=52, train_years=(1,), bps=2.0, least_trades=10, most_drawdown=0.9, least_score=50.0)
    got = funnel.evaluate(bars, specs_of(spark).filter("spec_id = 1"), s).evaluations.first()
    assert (got["failed_on"], got["reason"]) == ("min_score", "deflated_sharpe_insufficient")


def test_nothing_survives(spark, bars):
    report = funnel.evaluate(bars, specs_of(spark).filter("spec_id IN (3, 4)"), funnel.Settings(most_nodes=5))
    assert {r["phase"] for r in report.evaluations.collect()} == {"bar", "p0"} and report.regimes.count() == 0


def test_two_runs_in_one_frame_are_two_calls(spark):
    day = datetime.date(2020, 1, 1)
    rng = np.random.default_rng(1)
    rows = {k: [(k, b, day + datetime.timedelta(days=b), float(x)) for b, x in enumerate(rng.normal(0, scale, 60))] for k, scale in (("a", 0.01), ("b", 0.08))}
    both = spark.createDataFrame(rows["a"] + rows["b"], "run string, bar_ix long, date date, net double")
    labels = regimes.label(both.withColumn("market", F.col("net")), 8, keys=("run",))
    keyed = regimes.by_regime(both, labels, 252, ("run",), ("run",))
    weak = regimes.weak(keyed, labels, ("run",), ("run",))
    eras = monitor.eras(both, F.when(F.col("run") == "a", "2020-01-20").otherwise("2020-02-10"), ("run",))
    breach = monitor.first_breach(eras, 0.1, 0.1, ("run",))
    for k, start in (("a", "2020-01-20"), ("b", "2020-02-10")):
        one = both.filter(F.col("run") == k)
        own = regimes.label(one.withColumn("market", F.col("net")), 8)
        plain = lambda df: sorted(map(str, df.drop("run").collect()))
        mine = lambda df, k=k: df.filter(F.col("run") == k)
        assert plain(mine(labels)) == plain(own)
        assert plain(mine(keyed)) == plain(regimes.by_regime(one, own, 252))
        assert plain(mine(weak)) == plain(regimes.weak(regimes.by_regime(one, own, 252), own))
        assert plain(mine(breach)) == plain(monitor.first_breach(monitor.eras(one, start), 0.1, 0.1))


def test_gates_warn_where_nothing_is_declared(spark, bars):
    run = bars.withColumns({"weight": F.lit(0.5), "volume": F.lit(None).cast("double")})
    for frame in (run, run.drop("volume")):
        got = {r["test_name"]: r for r in checks.equities_gate(frame, 1e6, 0.05, True, True).collect()}
        assert got["equities_capacity"]["outcome"] == "warn" and got["equities_capacity"]["value"] is None
    pnl = spark.createDataFrame([("2020-01-01 03:00:00", 1.0, 0.1)], "ts string, pnl double, carry double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [checks.forex_gate(pnl, funded=f).filter("test_name LIKE '%carry%'").first()["outcome"] for f in (True, False)] == ["pass", "warn"]


def test_like_specs_are_evaluated_once(spark, bars, monkeypatch):
    """Specs that differ in names alone are one evaluation, whose results all of them have."""
    from barquet.plans import compiled

    rows = [n(k, "entry", 0, f"m{k}", "momentum", {"period": str(2 + k % 2)}) for k in range(1, 9)] + [n(k, "entry", 0, f"m{k}", "momentum", {"period": "3", "min_return": "9"}) for k in (11, 12)]
    seen, plain = [], compiled.signals_of
    monkeypatch.setattr(compiled, "signals_of", lambda bars, held, *more, **named: seen.append({r[0] for r in held.select("spec_id").collect()}) or plain(bars, held, *more, **named))
    s = funnel.Settings(periods=52, train_years=(1,), bps=2.0, least_trades=10, most_drawdown=0.9, least_breadth=0.1)
    report = funnel.evaluate(bars, spark.createDataFrame(rows, specs.SCHEMA), s)
    assert seen[:3] == [{1, 2, 11}, {1, 2, 11}, {1, 2}] and set.union(*seen) == {1, 2, 11}
    got = {r["spec_id"]: tuple(r)[1:] for r in report.evaluations.collect()}
    assert set(got) == {*range(1, 9), 11, 12} and got[11] == got[12] and got[11][2] == "p1_any_signal"
    assert all(got[k] == got[2 - k % 2] for k in range(1, 9)) and got[1][0] == "p3"
    tests = {}
    for r in report.tests.collect():
        tests.setdefault(r["spec_id"], set()).add((r["test_name"], r["value"]))
    assert all(tests[k] == tests[2 - k % 2] for k in range(1, 9))
    assert {r["spec_id"] for r in report.regimes.collect()} == set(range(1, 9))
