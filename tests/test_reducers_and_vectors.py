"""Functions of windows, and vectors that are stored once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barquet.functions import reducers
from barquet.plans import documents, ledger
from barquet.sources import snapshots


@pytest.mark.parametrize(("n", "block"), [(5, 10), (12, 5), (1, 7), (40, 3), (200, 50)])
def test_any_function_of_windows_in_blocks(spark, n, block):
    """One series cut in at least three blocks gives what it gives whole."""
    rng = np.random.default_rng(2)
    x = {k: rng.normal(size=97) for k in "ab"}
    x["b"][[3, 50]] = np.nan
    rows = [(k, b, None if np.isnan(v) else float(v)) for k in "ab" for b, v in enumerate(x[k])]
    frame = spark.createDataFrame(rows, "instrument string, bar_ix long, x double").repartition(5)
    seen = lambda m: m[:, 0] * 2 + np.sort(m, axis=1)[:, -1] - m.mean(axis=1)
    got = {(r["instrument"], r["bar_ix"]): r["value"] for r in reducers.rolling_apply(frame, "x", n, seen, block=block).collect()}
    assert len(got) == 194
    for k in "ab":
        for b in range(97):
            own = x[k][max(0, b - n + 1) : b + 1]
            want = None if len(own) < n or np.isnan(own).any() else 2 * own[0] + own.max() - own.mean()
            assert got[k, b] is None if want is None else got[k, b] == pytest.approx(want)


def test_reducers_may_see_nulls_and_must_give_a_number_each(spark):
    frame = spark.createDataFrame([("a", b, None if b == 1 else float(b)) for b in range(6)], "instrument string, bar_ix long, x double")
    got = reducers.rolling_apply(frame, "x", 3, lambda m: np.isnan(m).sum(axis=1), skip_nulls=True, block=2).orderBy("bar_ix").collect()
    assert [r["value"] for r in got] == [None, None, 1.0, 1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        reducers.rolling_apply(frame, "x", 0, lambda m: m[:, 0])
    with pytest.raises(Exception, match="the reducer gave"):
        reducers.rolling_apply(frame, "x", 2, lambda m: m).collect()
    assert reducers.rolling_apply(frame.limit(0), "x", 2, lambda m: m[:, 0]).count() == 0


def embedder():
    return lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]


def refusing():
    raise AssertionError("nothing is to be embedded")


def test_only_missing_documents_are_embedded(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "banana"), (3, "a"), (None, "lost")], "doc_id long, text string")
    assert documents.embed_missing(docs.filter("doc_id = 1"), folder, embedder) == 1
    assert documents.embed_missing(docs, folder, embedder, batch_rows=1) == 2
    assert documents.embed_missing(docs, folder, refusing) == 0
    assert sorted((r["doc_id"], list(r["embedding"])) for r in documents.embedded(spark, folder).collect()) == [(1, [3.0, 1.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])]


def test_a_job_that_dies_or_runs_twice_adds_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    docs = spark.createDataFrame([(k, "a" * k) for k in range(20)], "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(snapshots.Files, "move", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            documents.embed_missing(docs, folder, embedder)
    assert documents.embedded(spark, folder).count() == 0
    with monkeypatch.context() as m:  # both jobs looked before either had stored
        none = documents.embedded(spark, folder)
        m.setattr(documents, "embedded", lambda *_: none)
        assert [documents.embed_missing(docs, folder, embedder) for _ in range(2)] == [20, 0]
    assert documents.embedded(spark, folder).count() == 20


def test_keywords_by_counting(spark):
    texts = ["beta alpha beta gamma alpha beta", "", None, "one1 two2 two2 three one1 four five six seven", "the of and"]
    got = documents.keywords(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), 3)
    rows = sorted((r["doc_id"], r["place"], r["term"], r["n"]) for r in got.collect())
    assert rows == [(0, 1, "beta", 3), (0, 2, "alpha", 2), (0, 3, "gamma", 1), (3, 1, "one1", 2), (3, 2, "two2", 2), (3, 3, "three", 1)]


def test_edges_keep_null_parts_and_ids_once(spark):
    rows = [("a", None, "b", True, ["x", "y"], 1, 0.5), ("a", None, "b", False, ["y", "z", "y"], 2, 0.7), ("a", "p", "b", True, [], 3, 0.1)]
    (r,) = ledger.edge_observations(spark.createDataFrame(rows, "subject string, predicate string, object string, supports boolean, backing array<string>, at int, confidence double")).collect()
    assert (r["n_for"], r["n_against"], r["backing"], r["first_at"], r["last_at"], r["confidence"]) == (1, 1, ["x", "y", "z"], 1, 2, 0.7)
