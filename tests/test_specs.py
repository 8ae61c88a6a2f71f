"""Identity, refusal and evaluation of spec tables."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barquet.operators import library, specs, state
from barquet.plans import compiled

CLOSE = {"series": "price.close"}


def n(spec, role, place, name, operator, params=None, inputs=CLOSE, version=None):
    return (spec, role, place, name, operator, version, params or {}, inputs)


def cross(spec, fast, slow, names=("f", "s", "x"), gap=None, swap=False, order=(0, 1, 2)):
    f, s, x = names
    inputs = {"fast": s, "slow": f} if swap else {"fast": f, "slow": s}
    rows = [n(spec, "entry", 0, f, "rolling_mean", {"window": fast}), n(spec, "entry", 1, s, "rolling_mean", {"window": slow}), n(spec, "entry", 2, x, "crossover", {"min_gap_pct": gap} if gap else {}, inputs)]
    return [rows[i] for i in order]


def hashes(spark, rows, **more):
    return {r["spec_id"]: r["spec_hash"] for r in specs.structural_hashes(spark.createDataFrame(rows, specs.SCHEMA), **more).collect()}


def test_identity(spark):
    both = lambda spec, a, b: [*cross(spec, "3", "9"), n(spec, "entry", 3, "m", "momentum", {"period": "4"}), n(spec, "entry", 4, "j", "and", {}, {"a": a, "b": b})]
    rows = [
        *cross(1, "3", "9"),
        *cross(2, "3", "9", ("p", "q", "r"), order=(2, 1, 0)),  # other names and order
        *cross(3, "03", " 9", gap="0.0"),  # a default written out, other spellings
        *cross(4, "3", "9", swap=True),
        *cross(5, "4", "9"),
        *cross(6, "3", "9", gap="0.20"),
        *cross(7, "3", "9", gap="2e-1"),
        *both(8, "x", "m"),
        *both(9, "m", "x"),
        *[n(10, "entry", 2, "x", "crossover", {}, {"slow": "s", "fast": "f"}), *cross(10, "3", "9")[:2]],
        *[n(11, "filter", *r[2:5], r[6], r[7]) for r in cross(11, "3", "9")],  # another role
        *[(12, *r[1:5], "1.0.0", *r[6:]) for r in cross(12, "3", "9")],  # the version named
    ]
    h = hashes(spark, rows)
    assert h[1] == h[2] == h[3] == h[10] == h[12]
    assert h[6] == h[7] and h[8] == h[9]
    assert len({h[i] for i in (1, 4, 5, 6, 8, 11)}) == 6
    meta = spark.createDataFrame([(1, '{"a":1}', None), (2, None, "{}"), (3, None, '{"x.y":2}')], "spec_id long, universe string, parameters string")
    with_meta = hashes(spark, rows, meta=meta)
    assert with_meta[2] == h[2] and len({with_meta[1], with_meta[2], with_meta[3]}) == 3


def test_refusals(spark):
    rows = [
        n(1, "entry", 0, "a", "ema", {"span": "1"}),
        n(2, "entry", 0, "a", "ema", {"span": "2.5"}),
        n(3, "entry", 0, "a", "ema", {"span": "true"}),
        n(4, "entry", 0, "a", "ema", {"length": "5"}),
        n(5, "entry", 0, "a", "kalman", {"process_var": "nan"}),
        n(6, "entry", 0, "a", "threshold", {"upper": "1", "lower": "2"}),
        n(7, "entry", 0, "a", "nothing"),
        n(8, "entry", 0, "a", "ema", {}, CLOSE, "7"),
        n(9, "entry", 0, "a", "ema", {}, {}),
        n(10, "entry", 0, "a", "ema", {}, {"series": "price.close", "other": "price.close"}),
        n(11, "entry", 0, "a", "ema", {}, {"series": "b"}),
        n(12, "entry", 0, "price.x", "ema"),
        n(13, "entry", 0, "a", "ema", {}, {"series": "b"}),
        n(13, "entry", 1, "b", "ema", {}, {"series": "a"}),
        n(13, "entry", 2, "c", "ema", {}, {"series": "a"}),
        n(14, "entry", 0, "a", "ema"),
        n(14, "filter", 0, "a", "ema", {"span": "3"}),
        n(15, "somewhere", 0, "a", "ema"),
        n(16, "entry", 0, "a", "threshold", {"above_is_long": "1"}),
        n(17, "entry", 0, "a", "ema"),
        n(17, "filter", 0, "a", "ema"),
    ]
    held, problems = specs.structure(spark.createDataFrame(rows, specs.SCHEMA))
    got = {(r["spec_id"], r["node"]): r["problem"] for r in problems.collect()}
    assert got == {
        (1, "a"): "out of range: span",
        (2, "a"): "wrong kind of span",
        (3, "a"): "wrong kind of span",
        (4, "a"): "unknown parameter length",
        (5, "a"): "wrong kind of process_var",
        (6, "a"): "lower is above upper",
        (7, "a"): "unknown operator",
        (8, "a"): "unknown version",
        (9, "a"): "unconnected input series",
        (10, "a"): "unknown input other",
        (11, "a"): "no node b",
        (12, "price.x"): "the name is a source",
        (13, "a"): "in or above a cycle",
        (13, "b"): "in or above a cycle",
        (13, "c"): "in or above a cycle",
        (14, "a"): "one name, two contents",
        (15, "a"): "unknown role",
        (16, "a"): "wrong kind of above_is_long",
    }
    assert {r["spec_id"] for r in held.collect()} == {17}
    bars = spark.createDataFrame([("i", 0, 1.0)], "instrument string, bar_ix long, close double")
    with pytest.raises(ValueError, match="refused"):
        compiled.apply_specs(bars, spark.createDataFrame(rows, specs.SCHEMA), carry=())
    with pytest.raises(ValueError, match="no open"):
        compiled.apply_specs(bars, spark.createDataFrame([n(1, "entry", 0, "a", "ema", {}, {"series": "price.open"})], specs.SCHEMA), carry=())


def test_library_binds():
    assert library.bind("ema", span=7)[1] == {"span": 7}
    for wrong in ({"span": 1}, {"span": 7.0}, {"span": True}, {"spam": 7}):
        with pytest.raises(ValueError):
            library.bind("ema", **wrong)
    with pytest.raises(ValueError, match="another version"):
        library.register(library.LIBRARY["ema", "1.0.0"])
    newer = library.register(library.Operator("ema", ("series",), column=lambda x, p, k: x["series"] * 2, version="1.10.0"))
    older = library.register(library.Operator("ema", ("series",), column=lambda x, p, k: x["series"] * 3, version="1.9.0"))
    try:
        assert library.bind("ema")[0] is newer and library.bind("ema", "1.9.0")[0] is older
    finally:
        del library.LIBRARY["ema", "1.10.0"], library.LIBRARY["ema", "1.9.0"]


# -- evaluation against plain arrays -------------------------------------------


def stepped(step, *columns):
    at, out = None, []
    for row in zip(*columns, strict=True):
        at, v = step(at, tuple(None if x != x else float(x) for x in row))
        out.append(np.nan if v is None else v)
    return np.array(out)


def by_hand(bars, rows):
    """One spec over one instrument's bars, operator by operator."""
    nodes = {r[3]: r for r in rows}
    close = bars["close"]
    prices = {c: bars[c].to_numpy() for c in ("open", "high", "low", "close", "volume")} | {"returns": close.pct_change(fill_method=None).to_numpy()}

    def bound(r):
        given = {p.name: p.default for p in library.LIBRARY[r[4], "1.0.0"].params}
        kinds = {p.name: type(p.default) for p in library.LIBRARY[r[4], "1.0.0"].params}
        return given | {k: (v == "true") if kinds[k] is bool else kinds[k](v) for k, v in r[6].items()}

    def of(ref):
        return prices[ref[6:]] if ref.startswith("price.") else value(nodes[ref])

    def atr(x, p):
        h, lo, c = x["high"], x["low"], np.concatenate([[np.nan], x["close"][:-1]])
        tr = np.where(np.isnan(c) | np.isnan(h) | np.isnan(lo), np.nan, np.maximum(h - lo, np.maximum(np.abs(h - c), np.abs(lo - c))))
        return stepped(state.wilder(p["period"]), tr)

    def value(r, position=None):
        p, x = bound(r), {k: of(v) for k, v in r[7].items()}
        s = pd.Series(x.get("series", x.get("volume", x.get("returns", prices["close"]))))
        name = r[4]
        roll = lambda k: s.rolling(k)
        sign = lambda up, down, *known: np.where(np.any([np.isnan(k) for k in known], axis=0), np.nan, np.where(up, 1.0, np.where(down, -1.0, 0.0)))
        with np.errstate(all="ignore"):
            if name == "rolling_mean":
                return roll(p["window"]).mean().to_numpy()
            if name == "ema":
                return stepped(state.ema(p["span"]), s)
            if name == "kalman":
                return stepped(state.kalman(p["process_var"], p["observation_var"]), s)
            if name == "roc":
                return (s / s.shift(p["period"]) - 1).to_numpy()
            if name == "zscore":
                return ((s - roll(p["window"]).mean()) / roll(p["window"]).std()).to_numpy()
            if name == "atr_normalise":
                return x["series"] / atr(x, p)
            if name == "crossover":
                gap = (x["fast"] - x["slow"]) / x["slow"]
                return sign(gap > p["min_gap_pct"], gap < -p["min_gap_pct"], gap)
            if name == "threshold":
                v = s.to_numpy()
                return sign(v > p["upper"], v < p["lower"], v) * (1 if p["above_is_long"] else -1)
            if name == "momentum":
                v = (s / s.shift(p["period"]) - 1).to_numpy()
                return sign(v > p["min_return"], v < -p["min_return"], v)
            if name == "mean_reversion":
                z = ((s - roll(p["window"]).mean()) / roll(p["window"]).std()).to_numpy()
                return sign(z < -p["entry_z"], z > p["entry_z"], z)
            if name == "volume_confirmation":
                m = roll(p["window"]).mean().to_numpy()
                return sign(s.to_numpy() > p["multiple"] * m, False, s.to_numpy(), m)
            if name == "vol_expansion":
                a = atr(x, p)
                m = pd.Series(a).rolling(p["lookback"]).mean().to_numpy()
                return sign(a > p["multiple"] * m, False, a, m)
            if name == "and":
                return sign((x["a"] > 0) & (x["b"] > 0), (x["a"] < 0) & (x["b"] < 0), x["a"], x["b"])
            if name == "or":
                return np.clip(np.sign(x["a"]) + np.sign(x["b"]), -1, 1)
            if name == "not":
                return sign(x["a"] == 0, False, x["a"])
            if name in ("atr_stop", "trailing_stop"):
                return stepped(getattr(state, name)(p["multiple"]), position, x["close"], atr(x, p))
            if name == "time_stop":
                out, side, held = position.copy(), 0.0, 0
                for i, v in enumerate(position):
                    if v == 0 or v != v:
                        side, held = 0.0, 0
                    elif np.sign(v) != side:
                        side, held = np.sign(v), 1
                    else:
                        held += 1
                        if held > p["max_bars"]:
                            out[i], side, held = 0.0, 0.0, 0
                return out
            if name == "vol_target":
                sd = roll(p["window"]).std().to_numpy()
                return position * np.clip(np.where(sd > 0, p["target_vol"] / sd, np.nan), 0, p["max_leverage"])
            if name == "kelly":
                m, sd = roll(p["window"]).mean().to_numpy(), roll(p["window"]).std().to_numpy()
                return position * np.abs(np.clip(p["fraction"] * np.where(sd > 0, m / sd**2, np.nan), -p["cap"], p["cap"]))
        raise AssertionError(name)

    def role(which):
        mine = [r for r in rows if r[1] == which]
        used = {v for r in mine for v in r[7].values()}
        return [r for r in sorted(mine, key=lambda r: r[2]) if r[3] not in used]

    zero = np.zeros(len(bars))
    entries = [value(r) for r in role("entry")]
    position = zero if not entries else entries[0] if len(entries) == 1 else np.where(np.all([np.nan_to_num(e) > 0 for e in entries], axis=0), 1.0, np.where(np.all([np.nan_to_num(e) < 0 for e in entries], axis=0), -1.0, 0.0))
    exits = [value(r) for r in role("exit")]
    if exits:
        fires = exits[0] != 0 if len(exits) == 1 else np.nansum(np.abs(exits), axis=0) > 0
        position = np.where(fires, 0.0, position)
    filters = [value(r) for r in role("filter")]
    if filters:
        position = np.where(np.all([np.nan_to_num(f) > 0 for f in filters], axis=0), position, 0.0)
    for r in role("risk"):
        position = value(r, position=np.array(position, dtype=float))
    return np.clip(np.nan_to_num(position), -1, 1)


HLC = {x: f"price.{x}" for x in ("high", "low", "close")}


def drawn(spec, rng):
    rows = []

    def add(role, operator, params=None, inputs=CLOSE):
        name = f"n{len(rows)}"
        rows.append(n(spec, role, len(rows), name, operator, params, inputs))
        return name

    def series(role):
        kind = rng.randrange(5)
        if kind == 0:
            return add(role, "rolling_mean", {"window": str(rng.randint(2, 5))})
        if kind == 1:
            return add(role, "ema", {"span": str(rng.randint(2, 5))}, {"series": "price.close"})
        if kind == 2:
            return add(role, "kalman")
        if kind == 3:
            return add(role, "rolling_mean", {"window": "3"}, {"series": add(role, "ema", {"span": "4"})})
        return "price.open"

    def signal(role):
        kind = rng.randrange(8)
        if kind == 0:
            return add(role, "crossover", {"min_gap_pct": rng.choice(["0.01", "0"])}, {"fast": series(role), "slow": series(role)})
        if kind == 1:
            return add(role, "momentum", {"period": str(rng.randint(1, 6)), "min_return": "0.005"})
        if kind == 2:
            return add(role, "threshold", {"upper": "0.5", "lower": "-0.5", "above_is_long": rng.choice(["true", "false"])}, {"series": add(role, "zscore", {"window": str(rng.randint(4, 7))})})
        if kind == 3:
            return add(role, rng.choice(["and", "or"]), {}, {"a": signal(role), "b": signal(role)})
        if kind == 4:
            return add(role, "vol_expansion", {"period": "4", "lookback": "5"}, HLC)
        if kind == 5:
            return add(role, "threshold", {"upper": "8", "lower": "6"}, {"series": add(role, "atr_normalise", {"period": "5"}, {"series": "price.close", **HLC})})
        if kind == 6:
            return add(role, "not", {}, {"a": signal(role)})
        return add(role, "mean_reversion", {"window": "6", "entry_z": "0.7"})

    for role, most in (("entry", 2), ("exit", 2), ("filter", 2)):
        for _ in range(rng.randint(1 if role == "entry" else 0, most)):
            signal(role)
    risks = [("atr_stop", {"period": "4", "multiple": "1"}, HLC), ("trailing_stop", {"period": "4", "multiple": "1.5"}, HLC), ("time_stop", {"max_bars": "3"}, {}), ("vol_target", {"window": "6", "target_vol": "0.02"}, {"returns": "price.returns"}), ("kelly", {"window": "10", "cap": "0.5"}, {"returns": "price.returns"})]
    for operator, params, inputs in rng.sample(risks, rng.randint(0, 3)):
        add("risk", operator, params, inputs)
    return rows


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, i in enumerate("ab"):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 90)))
        if k:
            close[40] = np.nan
        for b in range(90):
            spread = abs(rng.normal(0, 1))
            x = close[b]
            rows.append((i, b, x - spread / 2, x + spread, x - spread, x, float(rng.integers(5, 50))))
    pdf = pd.DataFrame(rows, columns=["instrument", "bar_ix", "open", "high", "low", "close", "volume"])
    frame = spark.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, float) else v for v in r) for r in rows], "instrument string, bar_ix long, open double, high double, low double, close double, volume double")
    return pdf, frame


@pytest.mark.parametrize("batch", [250, 12])
def test_specs_by_hand(spark, some, batch):
    pdf, frame = some
    rng = random.Random(8)
    rows = {k: drawn(k, rng) for k in range(40)}
    nodes = spark.createDataFrame([r for x in rows.values() for r in x], specs.SCHEMA)
    out = compiled.apply_specs(frame, nodes, carry=("close",), batch=batch).toPandas()
    assert len(out) == 40 * len(pdf)
    for spec, own in rows.items():
        for i in "ab":
            bars = pdf[pdf["instrument"] == i]
            got = out[(out["spec_id"] == spec) & (out["instrument"] == i)].sort_values("bar_ix")["signal"].to_numpy()
            np.testing.assert_allclose(got, by_hand(bars.reset_index(drop=True), own), atol=1e-9, err_msg=f"{spec} {own}")


def test_equal_computations_are_planned_once(spark, some):
    _, frame = some
    rows = [r for k in range(60) for r in cross(k, str(2 + k % 3), "9", (f"f{k}", f"s{k}", f"x{k}"))]
    held, problems = specs.structure(spark.createDataFrame(rows, specs.SCHEMA))
    graph, finals, mine = compiled.planned(held, ("spec_id",))
    assert problems.isEmpty() and mine.count() == 60
    assert len(finals) == 3 and len(graph.works) == 4 + 3 + 3 + 3  # means, crossovers, roles, finals


def test_overrides_and_runs(spark, some):
    """Parameters of the grid, runs as keys of one frame, refusal of a value out of range."""
    pdf, frame = some
    rows = [*cross(1, "2", "6"), n(2, "entry", 0, "m", "momentum", {"period": "3"})]
    nodes = spark.createDataFrame(rows, specs.SCHEMA)
    grid = spark.createDataFrame([(1, 0, {"f.window": "3"}), (1, 1, {"f.window": "4", "s.window": "8", "fx.window": "50"}), (2, 0, {}), (2, 1, {"m.period": "5"})], "spec_id long, params_ix int, overrides map<string,string>")
    runs = frame.withColumn("run", F.lit(1)).unionByName(frame.filter("bar_ix < 50").withColumn("run", F.lit(2)))
    out = compiled.apply_specs(runs, specs.override(nodes, grid), ids=("spec_id", "params_ix"), keys=("run", "instrument"), carry=()).toPandas()
    for (spec, ix), own in {(1, 0): cross(1, "3", "6"), (1, 1): cross(1, "4", "8"), (2, 0): rows[3:], (2, 1): [n(2, "entry", 0, "m", "momentum", {"period": "5"})]}.items():
        for run, end in ((1, 90), (2, 50)):
            for i in "ab":
                got = out[(out["spec_id"] == spec) & (out["params_ix"] == ix) & (out["run"] == run) & (out["instrument"] == i)].sort_values("bar_ix")["signal"].to_numpy()
                np.testing.assert_allclose(got, by_hand(pdf[(pdf["instrument"] == i) & (pdf["bar_ix"] < end)].reset_index(drop=True), own))
    bad = spark.createDataFrame([(1, 0, {"f.window": "1"})], grid.schema)
    with pytest.raises(ValueError, match="out of range: window"):
        compiled.apply_specs(frame, specs.override(nodes, bad), ids=("spec_id", "params_ix"), carry=())


def test_warmup_adds_up(spark):
    rows = [*cross(1, "3", "9"), n(2, "entry", 0, "m", "rolling_mean", {"window": "50"}), n(2, "entry", 1, "z", "zscore", {"window": "20"}, {"series": "m"}), n(2, "entry", 2, "t", "threshold", {}, {"series": "z"})]
    assert {r["spec_id"]: r["bars"] for r in compiled.warmup(spark.createDataFrame(rows, specs.SCHEMA)).collect()} == {1: 8, 2: 68}


def test_many_specs_are_not_broadcast(spark, monkeypatch):
    """Beyond the bound the table of specs is shuffled to the signals' bars, in parts, with the same rows."""
    import datetime

    bars = spark.createDataFrame([("a", k, datetime.date(2020, 1, 1) + datetime.timedelta(days=k), 10.0 + k % 3) for k in range(40)], "instrument string, bar_ix long, date date, close double")
    nodes = spark.createDataFrame([(k, "entry", 0, "m", "momentum", None, {"period": str(1 + k % 2)}, {"series": "price.close"}) for k in range(9)], specs.SCHEMA)
    rows = lambda: sorted(map(tuple, compiled.apply_specs(bars, nodes).collect()))
    want = rows()
    monkeypatch.setattr(compiled, "BROADCAST_ROWS", 8)
    made = compiled.apply_specs(bars, nodes)
    assert "SortMergeJoin" in made._jdf.queryExecution().toString() and "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert rows() == want and len(want) == 360
