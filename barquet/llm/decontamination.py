"""Benchmark decontamination (operator 10), in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII without letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The seed table is broadcast if its rows and the item ids in them are at most so many; a row is two runs of at most
#: `window` words, so this bounds its size. Beyond, runs only tell which places may be hits, and their windows are joined with the benchmark's.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _at(words: str, first: Column, n: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, first + i) for i in range(n)])


def benchmark_windows(benchmark: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``n, words, items``: each distinct window, its number of words and the
    items that have it. An item of fewer words, but not none, is one window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(_ascii_lower(F.col(text_col))).alias("w")).filter(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))))
    cut = items.withColumn("start", start).select("item", F.least(F.size("w"), F.lit(window)).alias("n"), F.array_join(F.slice("w", F.col("start") + 1, window), " ").alias("words"))
    return cut.groupBy("n", "words").agg(F.collect_set("item").alias("items"))


def _seeds(windows: DataFrame, n: int) -> tuple[DataFrame, int, int]:
    """A window of n words, wherever it stands, holds exactly one run of
    g = (n + 1) // 2 words that starts at a multiple of n - g + 1. So every run
    in a window is a seed, and documents are probed at these multiples only."""
    g = (n + 1) // 2
    step = n - g + 1
    seeds = windows.filter(F.col("n") == n).withColumn("w", F.split("words", " ")).withColumn("inside", F.explode(F.sequence(F.lit(0), F.lit(n - g))))
    return seeds.select(F.lower(F.array_join(F.slice("w", F.col("inside") + 1, g), " ")).alias("seed"), "inside", F.col("words").alias("window"), "items"), g, step


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", benchmark_text_col: str = "text") -> DataFrame:
    """``doc_id, th, start, n, items``: every occurrence of a benchmark window;
    ``start`` counts words from 0, ``th`` is a hash that tells apart rows that
    share an id.

    Documents are cut into words once; runs at every few words are looked up in
    a broadcast hash table of the benchmark's runs, and each hit is verified
    word for word in place. No document is shuffled.
    """
    windows = materialise(benchmark_windows(benchmark, window, item_col, benchmark_text_col))
    sizes = {r["n"]: r["count"] for r in windows.groupBy("n").agg(F.sum(F.size("items") + 1).alias("count")).collect()}  # at most `window` rows
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), words_of(F.col(text_col)).alias("w"))
    found = None
    for n, count in sorted(sizes.items()):
        seeds, g, step = _seeds(windows, n)
        probes = F.transform(F.sequence(F.lit(0), F.size("w") - g, F.lit(step)), lambda p: F.struct(p.alias("p"), F.lower(_at("w", p, g)).alias("seed")))
        small = count * step <= BROADCAST_ROWS
        # Neither a filter on the words nor explode(), which infers one: it would be pushed below and cut each text again.
        probed = text.select("doc_id", "th", *["w"] * small, F.when(F.size("w") >= n, probes).alias("probes"))
        probed = probed.select("doc_id", "th", *["w"] * small, F.explode_outer("probes").alias("x")).select("doc_id", "th", *["w"] * small, "x.p", "x.seed")
        start = F.col("p") - F.col("inside")
        if small:
            here = probed.join(F.broadcast(seeds), "seed").filter(start >= 0).filter(_ascii_lower(_at("w", start, n)) == F.col("window"))
        else:
            # A run meets one row of the benchmark's runs, and a window one of its windows, however frequent they are.
            known = probed.join(seeds.select("seed").distinct(), "seed", "left_semi")
            places = known.groupBy(F.col("doc_id").alias("d2"), F.col("th").alias("t2")).agg(F.collect_set("p").alias("places"))
            near = text.join(places, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
            starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(F.greatest(F.lit(0), p - (n - g)), F.greatest(F.lit(0), F.least(p, F.size("w") - n))))))
            maybe = near.select("doc_id", "th", "w", F.explode(starts).alias("start")).select("doc_id", "th", "start", _ascii_lower(_at("w", F.col("start"), n)).alias("words"))
            here, start = maybe.join(windows.filter(F.col("n") == n).select("words", "items"), "words"), F.col("start")
        here = here.select("doc_id", "th", start.alias("start"), F.lit(n).alias("n"), "items")
        found = here if found is None else found.union(here)
    if found is None:
        id_type = text.schema["doc_id"].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], f"doc_id {id_type}, th long, start int, n int, items array<string>")
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", benchmark_text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated`` and ``hit_words``, the sorted places of the hit words.

    Null and empty texts have no words. Null item ids count in no item list.
    Null ids are matched as equal; rows that repeat an id are told apart by
    their text, and equal rows get equal results. An empty benchmark hits
    nothing; an empty table gives an empty result; other columns are ignored.
    """
    found = hits(docs, benchmark, window, id_col, text_col, item_col, benchmark_text_col)
    spans = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    spans = spans.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), places.alias("hit_words"), "items")
    every = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    joined = every.join(spans, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(F.col("hit_words").isNull(), 0).otherwise(F.size("hit_words")).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.col("hit_words").isNotNull().alias("contaminated"),
        F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"),
        F.col("th").alias("text_hash"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their
    columns. Null and empty texts hold none and stay; null ids and repeated rows
    are judged by their own text; an empty benchmark or table removes nothing."""
    found = materialise(hits(docs, benchmark, window, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct())
    if found.count() <= BROADCAST_ROWS:  # two numbers each
        found = F.broadcast(found)
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__th")), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with hit words, and what separates them from the word before,
    taken out of the text. Texts without a hit, null and empty ones come back as
    they are; null ids and repeated rows are treated by their own text; other
    columns stay; an empty table stays empty."""
    found = contamination(docs, benchmark, window, id_col, text_col).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th"), F.col("hit_words").alias("__hit")).distinct()
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__th")), "left")
    # Odd parts are separators and even ones words, as both patterns alternate from the start of the text.
    word, gap = F.regexp_extract_all(F.col(text_col), F.lit(SEPARATORS.replace("[", "[^", 1)), F.lit(0)), F.split(F.col(text_col), SEPARATORS.replace("[", "[^", 1), -1)
    kept = F.transform(F.arrays_zip(word.alias("word"), F.slice(gap, 1, F.size(word)).alias("gap")), lambda x, i: F.when(F.array_contains("__hit", i), "").otherwise(F.concat(x["gap"], x["word"])))
    clean = F.concat(F.array_join(kept, ""), F.element_at(gap, -1))
    return joined.withColumn(text_col, F.when(F.col("__hit").isNull(), F.col(text_col)).otherwise(clean)).drop("__id", "__th", "__hit")
