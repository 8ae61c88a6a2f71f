"""Packing (operator 2): first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, partitions_for
from .tokens import by_bytes, encoder

GROUP_PIECES = 4096
#: Keys of pieces that fill a quarter of a group are broadcast up to so many, else joined by a shuffle.
HOT_ROWS = 100_000
#: Text that is encoded at once: its ids take some ten times as much.
BATCH_BYTES = 2 << 20


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item. A tournament tree over the bins' free room finds
    the leftmost bin that an item fits in, in as many steps as the tree is high."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i] = node - leaves
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each document's ids and then ``end_id``, cut into pieces of at most
    ``length`` ids: ``doc_id, start, length, ids_crc32, doc_tokens`` and, with
    ``keep_ids``, the ``ids`` themselves. ``tokenizer`` is any vocabulary file
    that the libraries read.

    A null or empty text is the end id alone; null ids and repeated rows are cut
    like any other; an empty table gives an empty result; other columns are ignored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, need_ids=True)
        end = np.array([end_id], "<u4")
        for batch in batches:
            at = 0
            for texts in by_bytes(batch.column(1), BATCH_BYTES):
                ids, ends = enc.ids(texts)
                rows, start, size, crc, total, kept = [], [], [], [], [], []
                first = 0
                for i, to in enumerate(ends.tolist()):
                    doc = np.append(ids[first:to], end)
                    first = to
                    for s in range(0, len(doc), length):
                        piece = doc[s : s + length]
                        rows.append(at + i)
                        start.append(s)
                        size.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(doc))
                        if keep_ids:
                            kept.append(piece)
                at += len(texts)
                long = lambda x: pa.array(x, pa.int64())
                out = [batch.column(0).take(pa.array(rows, pa.int64())), long(start), long(size), long(crc), long(total)]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(np.concatenate(kept).astype(np.int32) if kept else np.array([], np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return narrow.mapInArrow(lean(cut), schema).withColumnRenamed("id", "doc_id")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, seed: int = 0, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` ids.

    The pieces of ``token_pieces`` are dealt by a keyed hash of (id, start,
    checksum) into groups of about ``group_pieces``; each group is packed alone
    by first-fit decreasing. The number of groups follows the number of
    pieces, so no task grows with the input and the result doesn't depend on
    how Spark partitioned the input. Rows that repeat id and text (null ids
    too) are told apart by nothing, so where they are more than a quarter of a
    group they are dealt evenly over several. Adds ``sequence_id`` (group and bin) and
    ``offset``, gapless from 0 in its sequence.

    Null texts give a piece with the end id alone; null ids and repeated rows
    are packed like any other; an empty table gives an empty result; other
    columns are ignored.
    """
    pieces = materialise(token_pieces(docs, tokenizer, length, end_id, id_col, text_col, keep_ids))
    groups = partitions_for(pieces.count(), group_pieces)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins = np.array(first_fit_decreasing(pdf["length"].tolist(), length), dtype=np.int64)
        pdf["sequence_id"] = pdf["group"] * (1 << 31) + bins
        pdf["offset"] = pdf["length"].groupby(bins).cumsum() - pdf["length"]
        return pdf.drop(columns="group")

    key = ["doc_id", "start", "ids_crc32"]
    many = materialise(pieces.groupBy(*key).agg(F.count("*").alias("__n")).filter(F.col("__n") > max(1, group_pieces // 4)))
    salt = F.lit(0).cast("long")
    dealt = pieces
    if hot := many.count():  # rows that repeat id and text: dealt evenly over as many groups as they fill
        renamed = many.select(*[F.col(k).alias(f"__{k}") for k in key], "__n")
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
        dealt = pieces.join(F.broadcast(renamed) if hot <= HOT_ROWS else renamed, on, "left")
        salt = F.when(F.col("__n").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("__n") / max(1, group_pieces // 4)))).otherwise(salt)
    grouped = dealt.withColumn("__salt", salt).withColumn("group", F.pmod(F.when(F.col("__salt") == 0, F.xxhash64(*key, F.lit(seed))).otherwise(F.xxhash64(*key, F.lit(seed), "__salt")), F.lit(groups))).select(*pieces.columns, "group")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema]
    return grouped.groupBy("group").applyInPandas(fit, ", ".join([*fields, "sequence_id long", "offset long"]))
