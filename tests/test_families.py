"""Bootstrap and overfitting of many runs and families at once, against plain recomputation."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from barquet.plans import regimes, stats


def frame(spark, families):
    rows = [(f, run, i, x) for f, runs in families.items() for run, xs in runs.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "family string, run string, bar_ix long, net double")


def noise(seed, n, mean=0.0):
    rng = random.Random(seed)
    return [rng.gauss(mean, 0.1) for _ in range(n)]


def draws(spark, n, replications, block, seed):
    """The bars of each path of a series without keys."""
    one = spark.createDataFrame([(i, 0.0) for i in range(n)], "bar_ix long, net double")
    out = {}
    for r in stats.bootstrap(one, replications, block, seed).collect():
        out.setdefault(r["replication"], {})[r["pos"]] = r["source"]
    return [[own[t] for t in range(n)] for _, own in sorted(out.items())]


FAMILIES = {
    "f": {"a": noise(1, 50, 0.02), "b": noise(2, 37), "c": noise(3, 44), "one": [9.0]},
    "g": {"a": noise(4, 37), "z": noise(5, 61, 0.05)},
    "lone": {"one": [1.0]},
}


def test_blocks_are_the_bootstrap(spark):
    lengths = spark.createDataFrame([(70,), (3,)], "n long")
    for r in stats.blocks(lengths, 40, 6, 2, ("n",), ()).collect():
        want = draws(spark, r["n"], 40, 6, 2)
        for path in set(r["replication"]):
            own = [(p, a) for k, p, a in zip(r["replication"], r["pos"], r["at"]) if k == path]
            ends = [p for p, _ in own[1:]] + [r["n"]]
            assert [(a + t) % r["n"] for (p, a), e in zip(own, ends) for t in range(e - p)] == want[path]


def test_reality_check_of_families(spark):
    whole = {r["family"]: r for r in stats.reality_check(frame(spark, FAMILIES), 60, 5, 3, ("family",)).collect()}
    assert set(whole) == set(FAMILIES) and whole["lone"]["p_value"] == 1.0
    for family in "fg":
        runs = [xs for xs in FAMILIES[family].values() if len(xs) > 1]
        n = min(map(len, runs))
        runs = [np.array(xs[-n:]) for xs in runs]
        best = max(np.sqrt(n) * xs.mean() for xs in runs)
        drawn = [max(np.sqrt(n) * (xs[path].mean() - xs.mean()) for xs in runs) for path in draws(spark, n, 60, 5, 3)]
        assert whole[family]["best"] == pytest.approx(best)
        assert whole[family]["p_value"] == pytest.approx((sum(x >= best for x in drawn) + 1) / 61)
        alone = stats.reality_check(frame(spark, {family: FAMILIES[family]}).drop("family"), 60, 5, 3).first()
        assert (alone["p_value"], alone["best"]) == (whole[family]["p_value"], whole[family]["best"])
    assert stats.reality_check(frame(spark, {"f": {}}), 10).first()["p_value"] == 1.0


@pytest.mark.parametrize("shared", [False, True])
def test_monte_carlo_of_many_runs(spark, shared):
    runs = {"a": noise(6, 40), "b": noise(7, 40), "gone": [0.1, -1.0, 0.2, 0.3], "short": [0.5]}
    data = frame(spark, {"f": runs})
    got = {r["run"]: r for r in stats.monte_carlo(data, 70, 4, 9, ("run",), shared).collect()}
    assert set(got) == set(runs)
    own = {}
    if not shared:
        for r in stats.bootstrap(data, 70, 4, 9, ("run",)).collect():
            own.setdefault(r["run"], {}).setdefault(r["replication"], {})[r["pos"]] = r["source"]
    for run, xs in runs.items():
        paths = draws(spark, len(xs), 70, 4, 9) if shared else [[p[t] for t in range(len(xs))] for p in own[run].values()]
        equity = [np.cumprod([1 + xs[i] for i in path]) for path in paths]
        ruin = np.mean([any(x <= 0.5 * peak for x, peak in zip(e, np.maximum.accumulate(e)) if peak > 0) for e in equity])
        want = [*np.percentile([e[-1] - 1 for e in equity], [5, 50, 95]), ruin, 70]
        assert [got[run][k] for k in ("p5", "p50", "p95", "ruin", "n_paths")] == pytest.approx(want)


def test_missing_and_null_bars_leave_equity(spark):
    rows = [("a", 0, 0.1), ("a", 1, None), ("a", 3, -0.7)]
    holes = spark.createDataFrame(rows, "run string, bar_ix long, net double")
    filled = spark.createDataFrame([("a", i, x) for i, x in enumerate([0.1, 0.0, 0.0, -0.7])], "run string, bar_ix long, net double")
    assert stats.monte_carlo(holes, 50, 2, 1, ("run",)).collect() == stats.monte_carlo(filled, 50, 2, 1, ("run",)).collect()


def test_overfitting_of_families(spark):
    families = {
        "f": {k: noise(i, 83) for i, k in enumerate("abcde")},
        "g": {**{k: noise(i + 50, 21) for i, k in enumerate("xyz")}, "flat": [0.0] * 21, "same": noise(50, 21)},
        "tiny": {"a": [0.1, 0.2, 0.3], "b": [0.0, 0.1, 0.0]},
        "alone": {"a": noise(70, 40)},
    }
    got = {r["family"]: r for r in stats.overfitting(frame(spark, families), 8, 50, ("family",)).collect()}
    assert set(got) == set(families) and got["tiny"]["pbo"] == got["alone"]["pbo"] == 0.0

    def score(parts):
        v = np.concatenate(parts)
        return v.mean() / v.std(ddof=1) if v.std() > 1e-12 else 0.0

    for family in "fg":
        cut = {run: np.array_split(np.array(xs), 8) for run, xs in sorted(families[family].items())}
        every = list(itertools.combinations(range(8), 4))
        kept = sorted({int(i * len(every) / 50) for i in range(50)})
        low = 0
        for inside in (every[i] for i in kept):
            seen = [round(score([p[i] for i in inside]), 12) for p in cut.values()]
            unseen = [round(score([p[i] for i in range(8) if i not in inside]), 12) for p in cut.values()]
            won = unseen[int(np.argmax(seen))]
            low += sum(u <= won for u in unseen) / (len(cut) + 1) <= 0.5
        assert got[family]["n_splits"] == 50 and got[family]["pbo"] == pytest.approx(low / 50)
        alone = stats.overfitting(frame(spark, {family: families[family]}).drop("family"), 8, 50).first()
        assert alone["pbo"] == got[family]["pbo"]


def test_medians_so_far():
    rng = random.Random(2)
    vol = [None, None, *[rng.choice([rng.random(), 0.5, None]) for _ in range(200)]]
    got = regimes._medians(pd.DataFrame({"market_key": "all", "bar_ix": range(len(vol)), "vol": vol}))["reference"].tolist()
    for i, x in enumerate(got):
        seen = [v for v in vol[: i + 1] if v is not None]
        assert np.isnan(x) if not seen else x == pytest.approx(np.median(seen))


def test_markets_whose_joined_keys_are_alike(spark):
    """Keys with separators and nulls stay apart."""
    rows = [(a, b, i, x) for k, (a, b) in enumerate([("x|y", "z"), ("x", "y|z"), ("x", None), (None, "x")]) for i, x in enumerate(noise(k, 12))]
    market = spark.createDataFrame(rows, "a string, b string, bar_ix long, market double").selectExpr("*", "date_add(date'2020-01-01', int(bar_ix)) AS date")
    both = {(r["a"], r["b"], r["bar_ix"]): (r["vol"], r["reference"]) for r in regimes.trailing(market, 4, ("a", "b")).collect()}
    assert len(both) == 48
    alone = {(r["a"], r["b"], r["bar_ix"]): (r["vol"], r["reference"]) for r in regimes.trailing(market.filter("a = 'x' AND b = 'y|z'"), 4).collect()}
    assert len(alone) == 12 and all(both[k] == v for k, v in alone.items())
