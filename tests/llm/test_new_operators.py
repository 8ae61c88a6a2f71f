"""Operators 11 to 13 against brute force, with their edge cases."""

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barquet.llm import fingerprints, packing, pii, prefix_trie, queries, whitening

DATA = "/root/testdata/sf0.001"

# -- 11: whitening -----------------------------------------------------------


def by_numpy(vectors, most=32):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), [int(v) for v in x.astype(object).sum(0)]
    y = np.array([[(n * int(v) - t) / n for v, t in zip(row, s, strict=True)] for row in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    deviation = [sum((n * int(a) - t) ** 2 for a, t in zip(row, s, strict=True)) for row in x]
    return y, e, u, deviation, v


def embeddings(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<float>{extra}")


@pytest.mark.parametrize(("n", "d", "to_driver"), [(400, 64, None), (60, 5, None), (300, 150, 1)])
def test_whitening_is_that_of_the_covariance(spark, monkeypatch, n, d, to_driver):
    if to_driver:
        monkeypatch.setattr(whitening, "TO_DRIVER", to_driver)
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((n, d)) * np.linspace(0.3, 2, d)).astype(np.float32)
    got = {r["vec_id"]: r for r in whitening.whitened(embeddings(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]).repartition(3)).collect()}
    y, e, u, deviation, v = by_numpy(vectors)
    k = min(32, d)
    w = np.array([got[i]["whitened"] for i in range(n)])
    assert len(got) == n and w.shape == (n, k)
    want = y @ u / np.sqrt(e)
    sign = np.sign((w * want).sum(0))
    np.testing.assert_allclose(w * sign, want, atol=1e-8)
    assert [int(got[i]["deviation"]) for i in range(n)] == deviation
    np.testing.assert_allclose(got[0]["explained"], e / np.trace(v), rtol=1e-10)
    assert all(r["n"] == n and 0 <= r["identity_error"] < 1e-10 for r in got.values())
    np.testing.assert_allclose(w.T @ w / n, np.eye(k), atol=1e-10)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, -inf]), (12, [1.0, 2.0, 3.0])]
    good = [(6, [0.0, 0.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [-3.0, 0.5]), (9, [4.0, 0.1])]
    df = embeddings(spark, [(*r, 1, "x") for r in bad + good], ", n int, whitened string")
    rows = whitening.by_component(whitening.whitened(df)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in rows) == sorted((str(i), c) for i, _ in good for c in (1, 2))
    y, e, u, deviation, _ = by_numpy([v for _, v in good])
    assert sorted({(str(r["vec_id"]), r["deviation"], r["n"]) for r in rows}) == sorted({(str(i), d, 5) for (i, _), d in zip(good, deviation, strict=True)})
    # no rows, one vector, equal vectors, empty vectors; a dimension without variance has no component
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])], [(1, None)]):
        assert whitening.whitened(embeddings(spark, few)).count() == 0
    flat = whitening.whitened(embeddings(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [7.0, 5.0])])).collect()
    assert all(len(r["whitened"]) == 1 and abs(r["explained"][0] - 1) < 1e-12 for r in flat)
    assert whitening.by_component(whitening.whitened(embeddings(spark, []))).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_is_exact_for_large_entries(spark):
    vectors = [[1e12, 3.0], [-1e12, 5.0], [2.5e12, 1.0]]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whitened(embeddings(spark, list(enumerate(vectors)))).collect()}
    assert [got[i] for i in range(3)] == by_numpy(np.array(vectors, dtype=np.float32))[3]


def test_jacobi_davidson_on_close_and_equal_eigenvalues():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    e = np.concatenate([[9.0, 9.0, 9.0], 5 + 1e-6 * np.arange(5), np.linspace(4, 0, 292)])
    a = (q * e) @ q.T
    calls = []
    vectors, values, residuals = whitening.jacobi_davidson(lambda u: calls.append(1) or a @ u, 300, 20)
    np.testing.assert_allclose(values, np.sort(e)[::-1][:20], atol=1e-12)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(20), atol=1e-12)
    assert residuals.max() <= 512 * np.finfo(float).eps * 9 and len(calls) < 400


def test_minres_solves_indefinite_and_singular_systems():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    e = np.concatenate([np.linspace(-3, -1, 15), np.zeros(5), np.linspace(1, 4, 20)])
    a = (q * e) @ q.T
    b = a @ rng.standard_normal((40, 3))
    b[:, 2] = 0
    np.testing.assert_allclose(a @ whitening.minres(lambda x: a @ x, b, 60, 1e-12), b, atol=1e-9)


# -- 12: fingerprints --------------------------------------------------------


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def xx(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed).intdigest()
    return signed(seed)


def units(text):
    out, run = [], ""
    for ch in text:
        if ch in " \t\n\x0b\x0c\r":
            out, run = out + ([run] if run else []), ""
        else:
            run += ch
            if len(run) == fingerprints.UNIT:
                out, run = [*out, run], ""
    return out + ([run] if run else [])


def winnowed(text):
    u = units(text)
    if not u:
        return []
    if len(u) < 4:
        grams = [xx(" ".join(u))]
    else:
        one = [xx(x) for x in u]
        two = [xx(a, b) for a, b in zip(one, one[1:], strict=False)]
        grams = [xx(a, b) for a, b in zip(two, two[2:], strict=False)]
    packed = [signed(((g << 28) & (2**64 - 1)) | (2**28 - 1 - i)) for i, g in enumerate(grams)]
    width = min(4, len(packed))
    out = []
    for i in range(len(packed) - width + 1):
        least = min(packed[i : i + width])
        if least not in out:
            out.append(least)
    return out


def jaccard(a, b):
    a, b = ({x >> 28 for x in y} for y in (a, b))
    return 1.0 if not a | b else len(a & b) / len(a | b)


def fingerprinted(docs):
    """docs: (doc_id, text) -> sorted rows of the query."""
    docs = [(i, t or "") for i, t in docs]
    docs.sort(key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    out = []
    for k, (i, t) in enumerate(docs):
        follower = docs[(k + 1) % len(docs)][1]
        quarter = len(t) // 4
        edit = t[: len(t) - quarter] + follower[:quarter]
        a, b = winnowed(t), winnowed(edit)
        text = lambda e: " ".join(f"{x & (2**64 - 1):X}" for x in e)
        out.append((str(i), len(t), hashlib.sha256(edit.encode()).hexdigest(), text(a), text(b), round(jaccard(a, b), 9), round(jaccard(a, winnowed(follower)), 9)))
    return sorted(out)


def queried(spark, monkeypatch, docs):
    monkeypatch.setattr(queries, "read_table", lambda *_: docs)
    return sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in queries.op12_fingerprints(spark, "").collect())


WORDS = "the tree bäume 东京 naïve 𝒳𝒴 x a-very-long-compound-word of to Ünder".split()


def some_docs(seed, n):
    rng = random.Random(seed)
    docs = [(i * 3 % n, "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.choice([0, 1, 3, 7, 30, 120])))) for i in range(n)]
    docs += [(1, "again"), (1, "again"), (1, "again"), (2, docs[5][1]), (None, None), (None, ""), (None, "tail words"), (None, "tail words"), (7, "z" * 3000), (8, " \t "), (9, "東" * 500), (11, "same words same words same words same words " * 20)]
    return docs


@pytest.mark.parametrize(("block", "bound"), [(250_000, 500_000), (700, 500_000), (700, 0)])
def test_fingerprints_by_brute_force(spark, monkeypatch, block, bound):
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", block)
    monkeypatch.setattr(fingerprints, "BROADCAST_ROWS", bound)
    docs = some_docs(3, 80)
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in docs], "doc_id bigint, text string, block int, ghost int, sum int, rows int").repartition(5)
    assert queried(spark, monkeypatch, df) == fingerprinted(docs)


def test_fingerprints_of_few_documents(spark, monkeypatch):
    for docs in ([], [(5, "only one document of these words here")], [(5, None)], [(5, "a b c d e f"), (6, "")]):
        assert queried(spark, monkeypatch, spark.createDataFrame(docs, "doc_id bigint, text string")) == fingerprinted(docs)


def test_equal_passages_share_an_entry(spark):
    """The guarantee: seven consecutive equal units give an equal hash at places that match."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    pairs = []
    for _ in range(60):
        shared = [word() for _ in range(7)]
        a, b = [word() for _ in range(rng.randrange(20))], [word() for _ in range(rng.randrange(20))]
        pairs.append((len(a), len(b), " ".join([*a, *shared, word(), word()]), " ".join([*b, *shared, word()])))
    rows = spark.createDataFrame(pairs, "la int, lb int, a string, b string").select("la", "lb", fingerprints.winnow(F.col("a")).alias("a"), fingerprints.winnow(F.col("b")).alias("b")).collect()
    for r in rows:
        a, b = ({(x >> 28, (2**28 - 1 - (x & (2**28 - 1))) - start) for x in e} for e, start in ((r["a"], r["la"]), (r["b"], r["lb"])))
        assert any(0 <= at <= 3 for _, at in a & b)


# -- 13: prefix trie ---------------------------------------------------------


def trie_by_hand(turns):
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, digest), role, text))
    convs = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own
    ends = lambda node: ",".join(map(str, sorted(c for c in members[node] if len(whole[c]) == len(node))))
    return sorted(
        (min(m), len(node), -1 if not node else min(members[node[:-1]]), len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends(node).encode()).hexdigest())
        for node, m in members.items()
    )


def trie_rows(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def some_turns(seed):
    rng = random.Random(seed)
    turns = []
    for c in [*range(60), 1003, 77777, -4, -5]:
        if c in (20, 35):  # donors that are absent
            continue
        for t in range(rng.choice([1, 2, 3, 9, 14, 25])):
            turns.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bb", "", None, "ünï"])))
    for c in range(200, 260):  # one very common conversation
        turns += [(c, t, "user", f"common {t}") for t in range(12)]
    turns += [(500, t, "user", f"long {t % 3}") for t in range(600)]
    turns += [(501, t, "user", f"long {t % 3}") for t in range(590)] + [(501, 590, "user", "apart")]
    turns += [(3, None, "user", "first"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "user", "tie too"), (None, 1, "user", "lost")]
    rng.shuffle(turns)
    return turns


@pytest.mark.parametrize(("shard_turns", "held", "rows"), [(20_000, 200_000, 200_000), (0, 2, 50), (30, 1, 500), (700, 3, 1000)])
def test_trie_by_hand(spark, monkeypatch, shard_turns, held, rows):
    monkeypatch.setattr(prefix_trie, "RANGE_ROWS", rows)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    turns = some_turns(4)
    df = spark.createDataFrame([(*t, 1, 2, 3) for t in turns], "conv_id bigint, turn bigint, role string, text string, depth int, level int, range int").repartition(3)
    assert trie_rows(prefix_trie.trie(df, shard_turns, held)) == trie_by_hand(turns)


def test_small_tries(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    # crc32("7") % 9 is 6 and its donor 5 is absent: without turns left, it is a member of the root alone
    for turns in ([], [(None, 1, "a", "b")], [(7, 0, "user", "only")], [(1, 0, None, None)], [(10, k, "r", "t" * 5000) for k in range(20)]):
        assert trie_rows(prefix_trie.trie(spark.createDataFrame(turns, schema))) == trie_by_hand(turns)


def test_queue_spills_and_gives_back_in_order():
    rng = random.Random(5)
    items = [(rng.randrange(40), rng.randrange(3), rng.randrange(9), rng.randrange(9)) for _ in range(3000)]
    queue = prefix_trie.Messages(held=7)
    queue.BLOCK = 3
    for item in items:
        queue.push(item)
    assert len(queue.runs) > 10
    for key in sorted({i[:2] for i in items}):
        assert queue.take(key) == (sum(i[2] for i in items if i[:2] == key), sum(i[3] for i in items if i[:2] == key))
    assert not queue.heap


def test_queries_of_whole_tables(spark):
    rows = queries.op11_whitening(spark, DATA)
    assert rows.count() == 32 * spark.read.parquet(f"{DATA}/embeddings.parquet").filter("embedding IS NOT NULL").count()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_fingerprints(spark, DATA).collect()
    want = {r[0]: r for r in fingerprinted(docs)}
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == want[str(r["doc_id"])][1:5]
    turns = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(queries.op13_prefix_trie(spark, DATA)) == trie_by_hand(turns)


# -- 2: rows that nothing tells apart ------------------------------------------


def test_packing_deals_equal_rows_over_groups(spark):
    """A third of all rows has a null id and no text: no group holds them all, and every sequence is still right."""
    docs = spark.createDataFrame([(None, None)] * 3000 + [(i, f"some words of document {i} " * (i % 9)) for i in range(900)], "doc_id long, text string").repartition(4)
    out = packing.pack(docs, queries.tokenizer_path(), 64, group_pieces=200).toPandas()
    empty = out[out["doc_id"].isna()]
    assert len(empty) == 3000 and (empty["sequence_id"] // 2**31).value_counts().max() < 400
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 64


# -- 7: names by gender, hosts one to one ---------------------------------------


@pytest.mark.parametrize("which", ["latin", "cyrillic", "greek"])
def test_ten_thousand_names_keep_their_gender_and_part(which):
    """Beyond the lists every attempt gives a name whose ending tells its part, and enough different ones."""
    ends = {part: tuple(pii.BUILT[which][part].split()) for part in "mfs"}
    key = pii.key_from("names")
    for part in "mfs":
        taken, longest = {}, 0
        for k in range(10_000):
            for attempt in range(1, pii.LAST):
                name = pii.surrogate(key, f"name:{part}:{which}", f"person {k}", attempt)
                assert name.endswith(ends[part]) and not any(name.endswith(ends[other]) for other in "mfs" if other != part)
                assert pii.script(name) == which
                if name not in taken:
                    break
            taken[name], longest = k, max(longest, attempt)
        assert len(taken) == 10_000 and longest < 12


def test_different_hosts_have_different_surrogates():
    key = pii.key_from("hosts")
    letters = "abcdefghijklmnopqrstuvwxyz"
    two = [a + b for a in letters for b in letters]
    assert sorted(pii.permuted(key, x) for x in two) == two
    assert len({pii.permuted(key, f"{a}-{k}") for a in letters for k in range(10)}) == 260
    mails = {pii.surrogate(key, "email", f"info@{x}.example.com", attempt).partition("@")[2] for x in two for attempt in (0, 1, 13)}
    assert len(mails) == len(two)
    assert pii.permuted(key, "-") == "-" and pii.permuted(pii.key_from("other"), "some-long-host-name" * 20) != pii.permuted(key, "some-long-host-name" * 20)

