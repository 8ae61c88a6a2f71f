"""Each stage of the pipeline against a brute-force version, on its own input."""

import itertools
import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline as pipeline
from barquet.llm import decontamination, exact_dedup, quality, queries, simhash
from barquet.llm.common import materialise

from .test_operators import check_packing, contaminated_by_hand

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], DATA)))
    return out


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_columns_stay(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_quality(spark, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    compressors = model.compressors()
    score = lambda t: model.calibrated(np.array([model.difference(compressors, (t or "").encode())]))[0]
    assert pairs(stages[1]) == [p for p in pairs(stages[0]) if score(p[1]) >= 0.3]


def test_exact(stages):
    first = {}
    for i, t in pairs(stages[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert pairs(stages[2]) == [p for p in pairs(stages[1]) if p[0] in first.values()]
    assert stages[2].count() < stages[1].count()


def near_by_hand(rows, similarity=0.8):
    """Each id's smallest reachable id over links of texts whose sets of 5-word shingles are similar enough."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if root[a] != root[b] and (5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) if similarity == 0.8 else both >= similarity * len(sets[a] | sets[b])):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_near(stages):
    """At 0.8 in both directions: all that are as similar are one group, and no others."""
    rows = pairs(stages[2])
    root = near_by_hand(rows)
    assert pairs(stages[3]) == [p for p in rows if root[p[0]] == p[0]]


def test_near_on_more_texts(spark):
    """Texts that change word by word, so that similarities lie on both sides of 0.8 and right at it."""
    rng, rows = random.Random(4), []
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    for n in (5, 9, 13, 40, 120):
        for _ in range(6):
            own = rng.choices(words, k=n)
            for k in range(12):
                rows.append((len(rows) * 7 % 1009, " ".join(own)))
                own[rng.randrange(n)] = rng.choice(words)
                if k % 5 == 4:
                    own += rng.choices(words, k=2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(df).collect()}
    want = near_by_hand(rows)
    assert got == want and 30 < len(set(want.values())) < len(rows)


def test_near_in_blocks(spark, monkeypatch):
    """One large group of near copies, dealt in many blocks."""
    monkeypatch.setattr(simhash, "BLOCK_HASHES", 500)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(90)]
    rows = [(i, " ".join([*base[:40], f"x{i}", *base[41:], *(f"y{i}z{k}" for k in range(rng.choice((0, 1, 4, 12))))])) for i in range(150)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_by_hand(rows)


ODD = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None), (8, ""), (None, None), (3, "A b c  d e f"), (11, " ".join(f"w{i}" for i in range(4000)))]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_stage_edges(spark, tmp_path, monkeypatch, broadcast):
    """Null ids, repeated rows, null, empty and long texts, and extra columns with the names that stages use inside."""
    for module in (simhash, decontamination, exact_dedup):
        monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast)
    schema = "doc_id long, text string, th long, kept boolean, fp string, member string, root long, w string"
    frame = spark.createDataFrame([(*r, 1, True, "f", "m", 2, "w") for r in ODD], schema)
    spark.createDataFrame([(1, 1), (7, 1), (9, 0), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    want = {"quality classifier": rows(frame), "exact dedup": [(3, "A b c  d e f"), (7, "a b c d e f"), (8, ""), ODD[7]], "SimHash near-dedup": [(3, "A b c  d e f"), (8, ""), ODD[7]], "benchmark decontamination": [r for r in ODD if r[0] != 11]}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns and rows(out) == sorted(want[name], key=str), name
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0
    packed = pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == {r[0] for r in ODD} and pipeline.STAGES[-1][1](spark, frame.limit(0), str(tmp_path)).count() == 0


def test_near_finds_similar_documents_and_no_others(stages):
    shingles = {}
    for i, t in pairs(stages[3]):
        w = (t or "").lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    close = [1 for a, b in itertools.combinations(shingles.values(), 2) if len(a & b) >= 0.85 * len(a | b)]
    assert not close


def test_decontamination(spark, stages):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {x[0] for x in contaminated_by_hand(pairs(stages[3]), bench) if not x[5]}
    assert pairs(stages[4]) == [p for p in pairs(stages[3]) if p[0] in clean]


def test_packing(spark, stages):
    from tokenizers import Tokenizer

    out = stages[5].collect()
    check_packing(out, pairs(stages[4]), Tokenizer.from_file(queries.tokenizer_path()))
    digest = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in rows)
    assert digest(pipeline.run(spark, DATA).collect()) == digest(out)


def test_the_rest_stands_alone():
    """No module outside the package names it, but the registry."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "barquet")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, n), encoding="utf-8").read())
