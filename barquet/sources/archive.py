"""Archives of files and texts, addressed by content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Larger files are hashed by blocks of so many bytes, and lists of so many blocks.
LARGE, BLOCK, LISTED = 256 << 20, 1 << 20, 256
#: Names of files that Spark's reader of lines would decompress.
PACKED = ("bz2", "deflate", "gz", "lz4", "passthrough", "snappy", "zst")


def _of_hashes(hashes: DataFrame, name: str) -> DataFrame:
    """One hash of a set of hashes (column h): first of those that begin alike, then of these, so no list is as long as the set."""
    sorted_hash = lambda h: F.sha2(F.array_join(F.sort_array(F.collect_list(h)), "\n"), 256)
    return hashes.groupBy(F.substring("h", 1, 4).alias("p")).agg(sorted_hash("h").alias("h")).agg(sorted_hash(F.concat("p", "h")).alias(name))


def _sorted_list(place: str) -> Column:
    """One hash of hashes (column h) in the order of their places."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "h"))), lambda x: x["h"]), "\n"), 256).alias("h")


def _blocks(block: int):
    """Hashes of whole blocks of a file, and the bytes of those that a split begins or ends in, of lines in their order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, at, size, held = None, 0, 0, bytearray()

        def taken(last: bool = False) -> Iterator[tuple]:
            nonlocal at
            if last:  # a line's end that the file doesn't have isn't its
                del held[max(0, size - at) :]
            while held and (last or len(held) >= block - at % block):
                some = bytes(held[: block - at % block])
                whole = at % block == 0 and (len(some) == block or at + len(some) == size)
                yield *span[:2], size, at // block, at, len(some), None if whole else some, hashlib.sha256(some).hexdigest() if whole else None
                at += len(some)
                del held[: len(some)]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            names = ["path", "name", "size", "block", "at", "n", "part", "h"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found) if found else [()] * 8, kinds)], names)

        for batch in batches:
            paths, starts = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
            turns = np.flatnonzero((np.diff(paths) != 0) | (np.diff(starts) != 0)) + 1
            found = []
            for i, to in zip([0, *turns.tolist()], [*turns.tolist(), len(batch)] if len(batch) else []):
                path, name, start, long, offset, lead = (batch.column(k)[i].as_py() for k in range(6))
                if (path, name, start) != span:
                    found += taken(last=True)
                    span, at, size = (path, name, start), offset, long
                    held += lead
                held += b"".join(batch.column(6)[i:to].to_pylist())
                found += taken()
            yield rows(found)
        yield rows(list(taken(last=True)))

    return cut


def _large_files(spark: SparkSession, path: str, large: int, block: int) -> DataFrame:
    """``name, h`` of files of more than ``large`` bytes, which many tasks read.

    Spark's reader of lines splits a file; lengths of the lines of all splits give the
    place where each one begins, and then each block of ``block`` bytes is hashed where it was
    read, but for those that lie in two splits. The hashes of ``LISTED`` blocks give
    one of a list, and those of the lists the file's. What doesn't come to the file's size is an error."""
    meta = [F.col("_metadata.file_path").alias("path"), F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("name"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size")]
    packed = F.col("_metadata.file_name").rlike(rf"\.({'|'.join(PACKED)})$")
    lines = spark.read.option("lineSep", "\n").text(path).filter((F.col("_metadata.file_size") > large) & ~packed)
    lines = lines.select(*meta, F.concat(F.col("value").cast("binary"), F.unhex(F.lit("0A"))).alias("line"))
    of_file = Window.partitionBy("path")
    spans = lines.groupBy("path", "start", "size").agg(F.sum(F.octet_length("line").cast("long")).alias("n")).withColumn("total", F.sum("n").over(of_file))
    mark = F.when(F.col("total") < F.col("size"), 3).otherwise(0)  # the reader leaves out a mark of UTF-8 before the first line
    spans = spans.withColumn("first", F.min("start").over(of_file) == F.col("start")).withColumn("offset", F.sum("n").over(of_file.orderBy("start")) - F.col("n") + F.when(F.col("first"), 0).otherwise(mark))
    lead = F.when(F.col("first") & (mark == 3), F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    spans = spans.select("path", "start", "offset", lead.alias("lead"))
    placed = lines.join(F.broadcast(spans), ["path", "start"]).select("path", "name", "start", "size", "offset", "lead", "line")
    pieces = placed.mapInArrow(_blocks(block), "path string, name string, size long, block long, at long, n long, part binary, h string")
    parts = F.array_sort(F.collect_list(F.when(F.col("h").isNull(), F.struct("at", "part"))))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda all, x: F.concat(all, x["part"]))
    each = pieces.groupBy("path", "name", "size", "block").agg(F.sum("n").alias("n"), F.coalesce(F.first("h", ignorenulls=True), F.sha2(joined, 256)).alias("h"))
    lists = each.groupBy("path", "name", "size", F.floor(F.col("block") / LISTED).alias("list")).agg(F.sum("n").alias("n"), _sorted_list("block"))
    files = lists.groupBy("path", "name", "size").agg(F.sum("n").alias("n"), _sorted_list("list"))
    return files.select("name", F.when(F.col("n") == F.col("size"), F.col("h")).otherwise(F.raise_error(F.concat(F.lit("not all bytes were read of "), "name"))).alias("h"))


def content_hash(spark: SparkSession, path: str, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """One hash of a set of files, whatever order they are listed in. A file's own hash is SHA-256 of
    its bytes, and for more than ``large`` bytes that of the hashes of its blocks, as SHA-256 of
    a file is one chain that only one task can follow. Files packed by a codec are read whole at any size."""
    found = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    files = found.filter(F.col("length") <= large).select(name, F.sha2("content", 256).alias("h"))
    if not found.filter(F.col("length") > large).select("path").isEmpty():
        packed = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(PACKED)}}}").load(path)
        files = files.unionByName(packed.filter(F.col("length") > large).select(name, F.sha2("content", 256).alias("h"))).unionByName(_large_files(spark, path, large, block))
    return _of_hashes(files.select(F.sha2(F.concat("name", F.lit(":"), "h"), 256).alias("h")), "content_hash")


def version_of(rows: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """A hash of rows with the fields that order them, whatever order they are read in."""
    line = F.to_json(F.struct(*order, *[f for f in fields if f not in order]))
    return _of_hashes(rows.select(F.sha2(line, 256).alias("h")), "version")


def by_hash(docs: DataFrame) -> DataFrame:
    """Texts once each, named by their hash, with the prefix that they are partitioned by."""
    return docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.first("text").alias("text")).withColumn("prefix", F.substring("hash", 1, 1))


def market_tree(spark: SparkSession, root: str) -> DataFrame:
    """Bars of a tree class/timeframe/TICKER.parquet: the path's parts are columns; a ticker found twice is an error."""
    raw = spark.read.option("recursiveFileLookup", True).parquet(root)
    raw = raw.toDF(*[c.lower() for c in raw.columns]) if raw.columns != [c.lower() for c in raw.columns] else raw
    # A ticker is a file, or a folder of part files.
    path = F.col("_metadata.file_path")
    parts = raw.select("*", *[F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+)\.parquet(?:/[^/]+)?$", i).alias(n) for i, n in enumerate(("asset_class", "timeframe", "instrument"), 1)])
    twice = parts.select("instrument", "asset_class", "timeframe").distinct().groupBy("instrument").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("some tickers have more than one file")
    return parts


def import_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reference rows (actions, membership) with trimmed texts, empty ones null."""
    raw = spark.read.option("header", True).schema(schema).csv(path)
    return raw.select(*[F.nullif(F.trim(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in raw.schema])


def import_summary(rows: DataFrame) -> DataFrame:
    """Counts of imported rows: all, those not verified and distinct instruments, as far as the rows have such columns."""
    out = [F.count("*").alias("n_rows"), F.countDistinct("instrument").alias("n_ever")]
    if "verified_by" in rows.columns:
        out.append(F.count_if(F.col("verified_by").isNull()).alias("n_unverified"))
    return rows.agg(*out)
