"""The registered queries of the training-data operators, and SQL for those
that DuckDB can state. Each is the thin digest of its operator's result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, fingerprints, packing, pii, prefix_trie, quality, sharding, simhash, substring_dedup, tokens, url_filters, whitening
from .common import read_table

LENGTH = 2048
SHARDS = 40


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(read_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), LENGTH)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path(), LENGTH)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(read_table(spark, sf_dir, "documents"), radius=4, shingle=4, bits=64, seed=42)


#: (host, path, action)
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(read_table(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(read_table(spark, sf_dir, "documents"), pii.key_from("surrogates of the registered query"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(read_table(spark, sf_dir, "documents"), window=13)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whitened(read_table(spark, sf_dir, "embeddings")))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))
    return prints.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.written_out(F.col("entries")).alias("fingerprint"),
        fingerprints.written_out(F.col("edited_entries")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_packing, op3_token_counts, op4_sharding, op5_simhash, op6_url_filters, op7_pii, op8_substring_dedup, op9_quality, op10_decontamination, op11_whitening, op12_fingerprints, op13_prefix_trie)
}


def _url_sql(threshold: float = 0.75, damping: float = 0.85, rounds: int = 10) -> str:
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = ", ".join(
        f"r{k + 1} AS (SELECT kind, host, sum(v) AS v FROM (SELECT kind, host, v FROM r0 UNION ALL SELECT f.kind, f.dst, r.v * f.w * {damping} FROM r{k} r JOIN flow f ON f.kind = r.kind AND f.host = r.host) GROUP BY kind, host)"
        for k in range(rounds)
    )
    return rf"""
WITH rules(rh, rp, action) AS (VALUES {rules}),
p AS (SELECT page_id, html, {lower("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fit AS (SELECT p.page_id, r.rh || r.rp AS rule, r.action,
               row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rh) + length(r.rp) DESC, length(r.rh) DESC, r.action DESC) AS k
        FROM p JOIN rules r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)),
j AS (SELECT p.page_id, p.html, p.host, p.path, fit.rule, fit.action FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND fit.k = 1),
seeds AS (SELECT host, avg(CASE WHEN action = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN action = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM j GROUP BY host),
links AS (SELECT host AS src, {lower("unnest(regexp_extract_all(html, '" + url_filters.LINK.replace("'", "''") + "', 1))")} AS dst FROM p),
e AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND src <> dst GROUP BY src, dst),
flow AS (SELECT 'trust' AS kind, src AS host, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM e
         UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e),
r0 AS (SELECT 'trust' AS kind, host, trust * {1 - damping} AS v FROM seeds WHERE trust > 0
       UNION ALL SELECT 'distrust', host, distrust * {1 - damping} FROM seeds WHERE distrust > 0),
{steps},
s AS (SELECT host, coalesce(sum(v) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(v) FILTER (kind = 'distrust'), 0) AS d FROM r{rounds} GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.action, CASE WHEN s.d > {threshold} * (s.t + s.d) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN s ON s.host = j.host"""


ORACLE_SQL = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm""",
    "op6_url_filters": _url_sql(),
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, [y FOR y IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF y <> ''] AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 12, 0))) AS s FROM d),
g AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 13], ' ') AS g FROM p),
first AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY g),
hit AS (SELECT DISTINCT g.doc_id, unnest(range(g.s, g.s + 13)) AS i FROM g JOIN first f ON f.g = g.g WHERE f.first_id < g.doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS text, count(*) AS n FROM word LEFT JOIN hit ON hit.doc_id = word.doc_id AND hit.i = word.i WHERE hit.i IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op10_decontamination": r"""
WITH lowered AS (SELECT 'd' AS t, CAST(doc_id AS VARCHAR) AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
                 UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT t, id, [y FOR y IN regexp_split_to_array(x, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF y <> ''] AS w FROM lowered),
b0 AS (SELECT id, w, least(len(w), 10) AS n, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM words WHERE t = 'b' AND len(w) > 0),
b AS (SELECT DISTINCT id AS item, n, array_to_string(w[s + 1 : s + n], ' ') AS g FROM b0),
sizes AS (SELECT DISTINCT n FROM b),
p AS (SELECT id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM words, sizes WHERE t = 'd'),
g AS (SELECT id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS g FROM p),
hit AS (SELECT g.id, g.s, g.n, b.item FROM g JOIN b ON b.n = g.n AND b.g = g.g),
places AS (SELECT id, count(DISTINCT i) AS n_hit FROM (SELECT id, unnest(range(s, s + n)) AS i FROM hit) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id)
SELECT CAST(words.id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN places ON places.id = words.id LEFT JOIN items ON items.id = words.id WHERE t = 'd'""",
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT conv_id, digest, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS k FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS donor, n, xor(list_reduce(list_concat([4294967295], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
          lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h
      FROM (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id)),
b AS (SELECT c.conv_id, r.k AS d, r.digest, r.size FROM c JOIN r ON r.conv_id = c.donor AND r.k <= c.h
      UNION ALL SELECT c.conv_id, least(c.h, coalesce(lender.n, 0)) + r.k - c.h, r.digest, r.size FROM c JOIN r ON r.conv_id = c.conv_id AND r.k > c.h LEFT JOIN c lender ON lender.conv_id = c.donor),
lens AS (SELECT c.conv_id, count(b.d) AS len FROM c LEFT JOIN b ON b.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, d, size, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM b),
path AS (SELECT conv_id, d, size, key, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY d) AS up FROM p UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
n AS (SELECT d, key, any_value(up) AS up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN d = len THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
      FROM path JOIN lens USING (conv_id) GROUP BY d, key),
k AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * size AS saved FROM n LEFT JOIN k ON k.d = n.d AND k.key = n.key),
s AS (SELECT a.d, a.key, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(w.saved) AS saved FROM w JOIN path a ON a.conv_id = w.conv_id AND a.d <= w.d GROUP BY a.d, a.key)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN s ON s.d = w.d AND s.key = w.key LEFT JOIN n parent ON parent.d = w.d - 1 AND parent.key = w.up""",
}
