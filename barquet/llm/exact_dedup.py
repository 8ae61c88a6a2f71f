"""Exact dedup (operator 1), in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Hashes that repeat, 32 bytes each, are broadcast up to so many; beyond, texts are shuffled by their hash once.
BROADCAST_ROWS = 1_000_000
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """White space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=F.md5) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    1. A narrow table (id, 128-bit hash, SHA-256) is made in one scan.
    2. It is grouped by hash, with partial sums before the shuffle, so a hot
       text costs one row a task. Hashes that occur once are done.
    3. Only for the others, texts are fetched and compared byte for byte with
       that of the group's smallest id. A row that differs from it (a hash
       collision) is grouped by its text. Each join meets one row a hash on one
       side and stands alone on its keys, so Spark may split a hot hash.

    ``content_hash`` is a parameter so that tests can force collisions. Null
    texts equal the empty text. Null ids are larger than all others: a group of
    null ids alone keeps a null id. Repeated rows with the same id and text all
    count in ``group_size`` and share ``kept``. An empty table gives an empty
    result; other columns are ignored.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    prints = materialise(text.select("doc_id", F.unhex(content_hash("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")))
    groups = materialise(prints.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    many = groups.filter("n > 1")
    if many.count() <= BROADCAST_ROWS:
        many = F.broadcast(many)

    members = materialise(text.withColumn("h", F.unhex(content_hash("norm"))).join(many.drop("n"), "h"))
    first = materialise(members.filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("h").agg(F.min("norm").alias("first_norm")))
    differ = materialise(members.join(first, "h").filter(F.col("norm") != F.col("first_norm")).select("h", "doc_id", "norm"))

    result = prints.join(many, "h", "left").select("doc_id", "h", "sha", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"))
    if not differ.isEmpty():
        odd = differ.groupBy("h", "norm").agg(F.min("doc_id").alias("odd_id"), F.count("*").alias("odd_n"))
        odd = odd.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "odd_id", "odd_n")
        less = differ.groupBy("h").agg(F.count("*").alias("less"))
        result = (
            result.join(less, "h", "left")
            .join(odd, ["h", "sha"], "left")
            .select(
                "doc_id",
                "sha",
                F.when(F.col("odd_n").isNull(), F.col("keep_id")).otherwise(F.col("odd_id")).alias("keep_id"),
                F.coalesce("odd_n", F.col("group_size") - F.coalesce("less", F.lit(0))).alias("group_size"),
            )
        )
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts
    the row with the smallest id; of repeated rows with that id, one.

    Null and empty texts are equal; a null id stays only where its group has no
    other; an empty table stays empty. Rows of a group of one stay unseen; only
    the others are looked up, by id and hash, and no text is shuffled unless so
    many groups repeat that their hashes aren't broadcast, or rows do."""
    every = materialise(classes(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), "kept", F.unhex("text_sha256").alias("__of")))
    gone = materialise(every.filter("NOT kept").select("__id", "__of").distinct())
    twice = every.filter("kept").groupBy("__id", "__of").agg(F.count("*").alias("__rows")).filter("__rows > 1")
    keyed = docs.withColumn("__sha", F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    kept = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__of")), "left_anti")
    if not twice.isEmpty():
        kept = kept.dropDuplicates([id_col, "__sha"])
    return kept.drop("__sha")
