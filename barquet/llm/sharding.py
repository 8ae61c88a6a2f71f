"""Sharding (operator 4): weighted rendezvous hashing of record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions_for

SLOT_ROWS = 200_000


def rendezvous_shard(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard, from 0, whose score for ``key`` is highest; of equal scores
    the smaller shard. A score is ``-weight / ln(u)`` with ``u`` in (0, 1) from
    XXH64 of (key, shard, seed), so a new shard takes rows only into itself and
    a shard's share follows its weight. A null key hashes like a value of its own."""

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard"))

    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")
    return (-F.array_max(F.array(*[score(i, w) for i, w in live]))["shard"]).cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every record's shard and its slot in it.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: the
    shard under ``weights``, and under ``grown`` (null if none). Slots are
    gapless from 0 in the order of (id, checksum). They come from a range
    partitioning by (shard, id, checksum): each range numbers its own rows,
    and the rows before it are added from one count a range and shard, so no
    task holds a whole shard.

    Null texts have size 16 and the checksum of the empty text; null ids
    share one key; repeated rows get slots of their own; an empty table gives
    an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ).withColumns({"law": F.lit("key"), "shard": rendezvous_shard(F.col("doc_id"), weights, seed), "grown_shard": rendezvous_shard(F.col("doc_id"), grown, seed) if grown is not None else F.lit(None).cast("int")})
    keyed = materialise(keyed)
    order = ["shard", "doc_id", "text_crc32"]
    ranged = materialise(keyed.repartitionByRange(partitions_for(keyed.count(), SLOT_ROWS, 8), *order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = counts.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32")) - 1
    return (
        ranged.withColumn("own", slot)
        .join(before, ["shard", "range"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"), "grown_shard")
    )
