"""Recursions and other Python steps against plain statements of the same thing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barquet.functions import windows as w
from barquet.operators import signals, state, transforms, weights
from barquet.plans import backtest, barquality, documents, metrics, stats, walkforward
from barquet.streaming import jobs


def bars(spark, n=60, instruments=2, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(instruments):
        price = 100.0
        for t in range(n):
            price *= math.exp(rng.gauss(0, 0.02))
            rows.append((f"i{k}", t, price * 0.999, price * 1.01, price * 0.99, price, 1000.0 + t))
    return spark.createDataFrame(rows, "instrument string, bar_ix int, open double, high double, low double, close double, volume double").withColumn("date", F.date_add(F.lit("2001-01-01").cast("date"), F.col("bar_ix")))


def values(df, name="value"):
    return {(r["instrument"], r["bar_ix"]): r[name] for r in df.collect()}


def series(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["instrument"], r["bar_ix"])):
        out.setdefault(r["instrument"], []).append(r)
    return out


STEPS = {"ema": state.ema(5), "jma": state.jma(6), "kalman": state.kalman(), "wilder": state.wilder(4)}


@pytest.mark.parametrize("name", STEPS)
def test_steps_see_nothing_later(spark, name):
    """Cut off later bars: what was there before stays."""
    frame = bars(spark)
    whole = values(state.run_steps(frame, ["close"], STEPS[name], "value"))
    cut = values(state.run_steps(frame.filter("bar_ix < 30"), ["close"], STEPS[name], "value"))
    assert all(whole[k] == v for k, v in cut.items())


def test_wilder_in_blocks_with_nulls(spark):
    """Nulls hold the value and don't count; the seed may end in any block, or never."""
    rng = random.Random(4)
    series = {"full": [rng.random() for _ in range(40)], "holes": [None if i % 3 else rng.random() for i in range(40)], "late": [None] * 15 + [rng.random() for _ in range(25)], "few": [None] * 20 + [1.0, math.nan, 2.0], "none": [None] * 9, "one": [3.0]}
    rows = [(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)]
    own = spark.createDataFrame(rows, "instrument string, bar_ix long, x double").repartition(3)
    values = lambda df: {(r["instrument"], r["bar_ix"]): r["value"] for r in df.collect()}
    want = values(state.run_steps(own, ["x"], state.wilder(6), "value"))
    for block in (4, 7, 100):
        got = values(state.run_linear(own, ["x"], state.linear_wilder(6), "value", block=block))
        assert set(got) == set(want) and all((a is None) == (want[k] is None) and (a is None or a == pytest.approx(want[k])) for k, a in got.items())


LINEAR = {"ema": (state.ema(5), state.linear_ema(5)), "jma": (state.jma(6), state.linear_jma(6)), "kalman": (state.kalman(), state.linear_kalman())}


@pytest.mark.parametrize("name", LINEAR)
def test_blocks_compose(spark, name):
    """In blocks of 7 bars the values are those of one run over all of them, also with a gap."""
    frame = bars(spark)
    step, linear = LINEAR[name]
    for own in (frame, frame.withColumn("close", F.when(F.col("bar_ix") != 33, F.col("close")))):
        want, got = values(state.run_steps(own, ["close"], step, "value")), values(state.run_linear(own, ["close"], linear, "value", block=7))
        assert want.keys() == got.keys()
        assert all((v is None and got[k] is None) or got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())


WINDOWS = {
    "mean": lambda: w.rolling_mean(F.col("close"), 5),
    "zscore": lambda: transforms.zscore(F.col("close"), 5),
    "rank": lambda: transforms.percent_rank(F.col("close"), 5),
    "frac_diff": lambda: transforms.frac_diff(F.col("close"), 0.4, 1e-2, 8),
    "wavelet": lambda: transforms.wavelet_detail(F.col("close"), 8, 2),
    "breakout": lambda: signals.breakout(F.col("high"), F.col("low"), F.col("close"), 5),
    "momentum": lambda: signals.momentum(F.col("close"), 5),
    "std": lambda: w.rolling_std(F.col("close"), 5),
}


@pytest.mark.parametrize("name", WINDOWS)
def test_windows_see_nothing_later(spark, name):
    frame = bars(spark)
    whole = values(frame.withColumn("value", WINDOWS[name]()))
    cut = values(frame.filter("bar_ix < 30").withColumn("value", WINDOWS[name]()))
    assert all((v is None and whole[k] is None) or abs(whole[k] - v) < 1e-12 for k, v in cut.items())


def test_shift_refuses_the_future():
    with pytest.raises(ValueError):
        w.shift(None, -1)


def test_ema_by_hand(spark):
    got = series(state.run_steps(bars(spark, 12), ["close"], state.ema(4), "value"))
    for rows in got.values():
        mean = sum(r["close"] for r in rows[:4]) / 4
        assert [r["value"] for r in rows[:3]] == [None] * 3 and rows[3]["value"] == pytest.approx(mean)
        for r in rows[4:]:
            mean = 0.4 * r["close"] + 0.6 * mean
            assert r["value"] == pytest.approx(mean)


def test_atr_stop_flattens_one_bar():
    step, st, out = state.atr_stop(1.0), None, []
    for row in [(1.0, 100.0, 2.0), (1.0, 99.0, 2.0), (1.0, 98.0, 2.0), (1.0, 97.0, 2.0), (1.0, 94.0, 2.0), (0.0, 94.0, 2.0), (-1.0, 94.0, 2.0), (-1.0, 97.0, 2.0)]:
        st, v = step(st, row)
        out.append(v)
    assert out == [1.0, 1.0, 0.0, 1.0, 0.0, 0.0, -1.0, 0.0]


def test_trailing_stop_only_tightens():
    step, st, out = state.trailing_stop(1.0), None, []
    for row in [(1.0, 100.0, 2.0), (1.0, 104.0, 2.0), (1.0, 103.0, 5.0), (1.0, 102.0, 5.0), (1.0, 102.0, 2.0)]:
        st, v = step(st, row)
        out.append(v)
    assert out == [1.0, 1.0, 1.0, 0.0, 1.0]


def test_closed_form_sharpe_and_drawdown(spark):
    curve = spark.createDataFrame([(t, 0.02 if t % 2 == 0 else -0.01) for t in range(1000)], "bar_ix int, net double").withColumn("run", F.lit("a"))
    row = metrics.summary(curve, 252, ("run",)).first()
    assert row["sharpe"] == pytest.approx(0.005 / (0.015 * math.sqrt(1000 / 999)) * math.sqrt(252))
    assert row["max_drawdown"] == pytest.approx(0.01)


def test_gross_weight_is_capped(spark):
    frame = bars(spark, 20, 3).withColumn("signal", F.lit(1.0))
    rows = backtest.lag_and_cap(frame).collect()
    assert all(r["weight"] == 0 for r in rows if r["bar_ix"] == 0)
    assert all(r["weight"] == pytest.approx(1 / 3) for r in rows if r["bar_ix"] > 0)


def test_risk_parity_sums_to_one(spark):
    frame = bars(spark, 30, 3).withColumn("ret", w.simple_return(F.col("close")))
    sums = weights.risk_parity(frame, "ret", 10).filter("bar_ix >= 9").groupBy("date").agg(F.sum("weight").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)


def test_folds_and_leap_day(spark):
    span = spark.createDataFrame([("2000-02-29", "2004-06-01")], "first string, last string").selectExpr("cast(first as date) first", "cast(last as date) last")
    rows = walkforward.folds(span, [1], 1, 5).orderBy("fold").collect()
    assert [str(r["train_end"]) for r in rows] == ["2001-02-28", "2002-02-28", "2003-02-28"]
    assert str(rows[0]["test_start"]) == "2001-03-05" and str(rows[-1]["test_end"]) == "2004-03-05"


def test_adjust_by_hand(spark):
    frame = bars(spark, 10, 1)
    acts = spark.createDataFrame([("i0", "split", "1:2", 4), ("i0", "bonus", "1:1", 7)], "instrument string, action_type string, terms string, k int").select("instrument", F.date_add(F.lit("2001-01-01").cast("date"), F.col("k")).alias("ex_date"), barquality.ratio(F.col("action_type"), F.col("terms")).alias("ratio"))
    factors = [r["factor"] for r in barquality.adjust(frame, acts).orderBy("bar_ix").collect()]
    assert factors == [0.25] * 4 + [0.5] * 3 + [1.0] * 3


def test_bootstrap_is_the_seed_s_and_wraps(spark):
    frame = bars(spark, 40, 1).select("bar_ix", F.lit(0.0).alias("net"))
    a, b = ([tuple(r) for r in stats.bootstrap(frame.repartition(n), 5, 4, 3).orderBy("replication", "pos").collect()] for n in (1, 3))
    assert a == b and len(a) == 200 and all(0 <= r[2] < 40 for r in a)
    joined = sum(1 for x, y in zip(a, a[1:]) if y[0] == x[0] and y[2] == (x[2] + 1) % 40)
    assert joined > 100


def chunked(spark, text, longest):
    rows = documents.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), longest=longest).orderBy("chunk").collect()
    assert [r["chunk"] for r in rows] == list(range(len(rows))) and all(r["text"] == text[r["start"] : r["end"]] for r in rows)
    return [(r["chunk"], r["title"], r["start"], r["end"]) for r in rows]


def test_chunks_cover_the_text(spark):
    text = "intro\n\n# One\n\nbody\n\nTwo\n---\n\n" + "\n\n".join("para %d " % i + "x" * 300 for i in range(40)) + "\n\n3. Results\nend"
    out = chunked(spark, text, 1000)
    assert "".join(text[a:z] for _, _, a, z in out) == text
    assert [t for _, t, _, _ in out][:2] == [None, "One"] and out[-1][1] == "Results"
    assert all(z - a <= 1000 for _, t, a, z in out if t == "Two")
    assert chunked(spark, "  ", 1000) == [] and chunked(spark, None, 1000) == []


TEXTS = {
    "no headings at all": [(None, 0, 18)],
    "## Über uns ##\nwir": [("Über uns", 0, 18)],
    "  \n\n# A\nx\n#notone\n####### seven\n# B": [("A", 4, 32), ("B", 32, 35)],
    "Title\n=====\n---\n---\nx": [("Title", 0, 12), ("---", 12, 21)],
    "# A\n---\nx\n\n2.1 Method\ny\n4 lower\n5. Z": [("A", 0, 11), ("Method", 11, 36)],
    "line\n--\n" + "y" * 201 + "\n---\n": [(None, 0, 214)],
}


@pytest.mark.parametrize("text", TEXTS)
def test_headings(spark, text):
    assert [c[1:] for c in chunked(spark, text, 4000)] == TEXTS[text]


def test_sections_of_pages_begin_at_marks(spark):
    """A page whose title tag reads like a numbered heading, as its SQL has it: a number isn't a mark."""
    text = "12.155.210.168 Reeding of thesines\n\nTwo\n---\n\n# One\n\nx"
    of = lambda **how: [tuple(s) for s in spark.createDataFrame([(text,)], "t string").select(documents.sections(F.col("t"), **how).alias("s")).first()["s"]]
    assert of(marked_only=True) == [(None, 0, 45), ("One", 45, 53)]
    assert [s[0] for s in of()] == ["Reeding of thesines", "Two", "One"]


def test_long_sections_are_cut_at_blank_lines(spark):
    text = "aaaa\n\nbbbb\n\n\n\ncccc\n \t\n" + "d" * 30 + "\n\ne"
    assert [c[2:] for c in chunked(spark, text, 12)] == [(0, 12), (12, 22), (22, 54), (54, 55)]


def page_text(spark, html):
    return spark.createDataFrame([(html,)], "html string").select(documents.html_text(F.col("html")).alias("t")).first()["t"]


def test_html_text(spark):
    html = "<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><h2>Head</h2><p>One <b>two</b></p><script>x</script><p>Three &amp; four</p></body></html>"
    assert page_text(spark, html) == "T\n\n## Head\n\nOne two\n\nThree & four"


PAGES = {
    None: "",
    "": "",
    "plain": "plain",
    "<h1>A <i>b</i> c</h1>d": "# Ab c\n\nd",
    "<h3><div>Deep</div></h3><h2></h2><p>x": "### Deep\n\nx",
    "<HEADER>h</HEADER>a<br>b<BR/>c": "a\n\nb\n\nc",
    "<script>'<nav>'</script>seen<!-- <p>no --> too": "seen too",
    "a<footer>gone": "a",
    "&lt;b&gt; &#65;&#x42; &eacute; &nope; &#0; 1 &lt 2": "<b> AB é &nope; &#0; 1 &lt 2",
    "<p>one\n  two\n\n\n three</p>": "one\ntwo\n\nthree",
    "2 < 3 and <a href='x'>link</a>": "2 < 3 and link",
}


@pytest.mark.parametrize("html", PAGES)
def test_pages(spark, html):
    assert page_text(spark, html) == PAGES[html]


def test_feed_items(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><description>d</description><link>l</link><pubDate>p</pubDate></item><item><title>B</title><summary>s</summary></item></channel></rss>")
    rows = documents.feed_items(spark, str(tmp_path / "f.xml")).orderBy("title").collect()
    assert [(r["title"], r["description"], r["published"]) for r in rows] == [("A", "d", "p"), ("B", "s", None)]


def test_kill_switch_stays_dead():
    step, st, out = jobs.kill_switch(0.3), None, []
    for r in (0.1, -0.2, -0.2, 0.5):
        st, v = step(st, (r,))
        out.append(v)
    assert out == [0.0, 0.0, 1.0, 1.0]


def test_class_pairs_of_few_items(spark):
    """Sets over few items, which all share their rarest ones, meet in small groups; small and large sets agree with all pairs."""
    import itertools

    from barquet.plans import ledger

    draw = random.Random(5)
    own = {frozenset(draw.sample([f"i{k:02d}" for k in range(18)], draw.randint(1, 18))) for _ in range(300)} | {frozenset(f"i{k:02d}" for k in range(n)) for n in range(1, 19)}
    sets = list(own)
    rows = [(f, i, 1, sorted(x)) for f in (1, 2) for i, x in enumerate(sets)]
    classes = spark.createDataFrame(rows, "family long, class_id long, n long, items array<string>")
    for least in (0.5, 0.8, 0.9, 1.0):
        got = sorted((r["family"], r["a"], r["b"], round(r["jaccard"], 9)) for r in ledger.class_pairs(classes, least).collect())
        pairs = [(i, j, len(x & y) / len(x | y)) for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2)]
        assert got == sorted((f, i, j, round(v, 9)) for f in (1, 2) for i, j, v in pairs if v >= least)
    # All 1,023 sets of ten items: the keys that they meet by make few rows, where sharing a rare item made most pairs.
    every = [(1, i, 1, [f"i{k}" for k in range(10) if i >> k & 1]) for i in range(1, 1024)]
    classes = spark.createDataFrame(every, "family long, class_id long, n long, items array<string>")
    plan = ledger.class_pairs(classes)
    assert plan.count() == sum(bin(i & j).count("1") >= 0.8 * bin(i | j).count("1") for i, j in itertools.combinations(range(1, 1024), 2))
    keys = classes.select(F.explode(ledger._without_few(F.col("items"))).alias("x")).groupBy("x.key").count()
    assert keys.agg(F.max("count")).first()[0] <= 1 + 10 + 45
