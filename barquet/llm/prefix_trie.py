"""Conversation prefix trie (operator 13), its totals by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions_for

#: A subtree with at most so many turns below its top is worked on whole, in one shard.
SHARD_TURNS = 20_000
#: Messages that a queue holds in memory, 32 bytes each on disk beyond.
HELD = 200_000
RANGE_ROWS = 200_000
#: Conversations that one row's list of ids holds at most.
PIECE_IDS = 20_000
NODE = ["depth", "k1", "k2"]


# -- turns and prefixes ----------------------------------------------------


def ranked(conversations: DataFrame) -> DataFrame:
    """``conv_id, rank, digest, size, range``: each conversation's turns from 1,
    by turn (null first) and, of one turn, by the MD5 of role and text. Ranges
    of rows are numbered alone and joined by counts, so a long conversation is
    split. Rows without a conv_id are left out."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    turns = materialise(turns)
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = materialise(turns.repartitionByRange(partitions_for(turns.count(), RANGE_ROWS, 8), "conv_id", *order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    return materialise(ranged.withColumn("own", own).join(before, ["conv_id", "range"]).select("conv_id", (F.col("own") + F.col("before")).alias("rank"), "digest", "size", "range"))


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns ``conv_id, depth, digest, size, range``
    and the conversations ``conv_id, turns``.

    With h = crc32(conv_id) % ``most``, the first h turns of the conversation
    conv_id - conv_id % ``family`` come before the own turns after the first h.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("range").alias("range"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    convs = convs.select("conv_id", "n", "range", h, (F.col("conv_id") - F.col("conv_id") % family).alias("donor"))
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("lent"))
    convs = materialise(convs.join(donors, "donor", "left").withColumn("b", F.least("h", F.coalesce("lent", F.lit(0)))))
    lent = turns.filter(F.col("rank") < most).select(F.col("conv_id").alias("donor"), "rank", "digest", "size")
    borrowed = convs.join(lent, "donor").filter("rank <= h").select("conv_id", F.col("rank").alias("depth"), "digest", "size", "range")
    own = turns.join(convs.select("conv_id", "h", "b"), "conv_id").filter("rank > h").select("conv_id", (F.col("b") + F.col("rank") - F.col("h")).alias("depth"), "digest", "size", "range")
    return borrowed.unionByName(own), convs.select("conv_id", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))


def _key(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(k), depth, *sums).alias(f"k{k}") for k in (1, 2)]


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Each turn with the keys of its node and of its parent's.

    The key of the first d turns hashes running sums of four 32-bit hashes of
    (place, role, text), 128 bits in all; sums of ranges make them run over a
    conversation of any length.
    """
    sums = ["s1", "s2", "s3", "s4"]
    a, b = F.xxhash64(F.lit(1), "depth", "digest"), F.xxhash64(F.lit(2), "depth", "digest")
    rows = rows.withColumns(dict(zip(sums, [F.shiftrightunsigned(a, 32), a.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(b, 32), b.bitwiseAND(0xFFFFFFFF)], strict=True)))
    totals = rows.groupBy("conv_id", "range").agg(*[F.sum(s).alias(s) for s in sums])
    over = Window.partitionBy("conv_id").orderBy("range")
    before = totals.select("conv_id", "range", *[(F.sum(s).over(over) - F.col(s)).alias(f"before_{s}") for s in sums])
    own = Window.partitionBy("conv_id", "range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({f"run_{s}": F.sum(s).over(own) for s in sums}).join(before, ["conv_id", "range"])
    through = [F.col(f"run_{s}") + F.col(f"before_{s}") for s in sums]
    parent = [x - F.col(s) for x, s in zip(through, sums, strict=True)]
    up = [k.alias(f"up{i + 1}") for i, k in enumerate(_key(F.col("depth") - 1, parent))]
    return run.join(convs, "conv_id").select("conv_id", "depth", "size", "turns", *_key(F.col("depth"), through), *up)


# -- time-forward processing -----------------------------------------------


class Messages:
    """A priority queue of rows of four longs, smallest first. Beyond ``held``
    rows in memory they go to a nameless temporary file as a sorted run, which
    is read back in blocks; it ends with the task."""

    BLOCK = 4096

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs = held, [], []

    def push(self, item: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, (item, -1))
        if len(self.heap) > self.held + len(self.runs):
            self._spill()

    def _spill(self) -> None:
        items = sorted(x for x, run in self.heap if run < 0)
        file = tempfile.TemporaryFile()
        np.array(items, dtype=np.int64).tofile(file)
        file.seek(0)
        self.heap = [x for x in self.heap if x[1] >= 0]
        self.runs.append(self._read(file))
        heapq.heapify(self.heap)
        self._next(len(self.runs) - 1)

    def _read(self, file) -> Iterator[tuple[int, int, int, int]]:
        with file:
            while data := file.read(32 * self.BLOCK):
                yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, 4).tolist())

    def _next(self, run: int) -> None:
        if (item := next(self.runs[run], None)) is not None:
            heapq.heappush(self.heap, (item, run))

    def take(self, key: tuple[int, int]) -> tuple[int, int]:
        """Sums of the messages for ``key``, which is the smallest that any message has."""
        leaves = saved = 0
        while self.heap and self.heap[0][0][:2] == key:
            item, run = heapq.heappop(self.heap)
            leaves, saved = leaves + item[2], saved + item[3]
            if run >= 0:
                self._next(run)
        return leaves, saved


def time_forward(held: int = HELD):
    """A function for ``mapInArrow`` over ``shard1, shard2, level, name, up_level,
    up_name, leaves, saved`` sorted by shard, level (falling) and name: each
    row's totals are its own numbers and those of the rows below it in its
    shard, which have sent theirs to ``up_level, up_name`` before. One pass;
    memory holds the messages under way, and beyond ``held`` the disk does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, Messages(held)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out_leaves, out_saved = [], []
            for s1, s2, level, name, up_level, up_name, leaves, saved in zip(*columns, strict=True):
                if (s1, s2) != shard:
                    shard, queue = (s1, s2), Messages(held)
                more_leaves, more_saved = queue.take((-level, name))
                leaves, saved = leaves + more_leaves, saved + more_saved
                out_leaves.append(leaves)
                out_saved.append(saved)
                if up_level is not None and (level, name) != shard:
                    queue.push((-up_level, up_name, leaves, saved))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out_leaves, pa.int64()), pa.array(out_saved, pa.int64())], names=TOTALS)

    return run


TOTALS = ["shard1", "shard2", "level", "name", "up_level", "up_name", "leaves", "saved"]
TOTALS_SCHEMA = ", ".join(f"{c} bigint" for c in TOTALS)


def _totals(rows: DataFrame, partitions: int, held: int) -> DataFrame:
    """``rows`` has the columns TOTALS; a shard is named by its top's (level, name), or by nulls if the whole tree is one."""
    dealt = rows.select(*[F.col(c).cast("long") for c in TOTALS]).repartition(partitions, "shard1", "shard2")
    return dealt.sortWithinPartitions("shard1", "shard2", F.col("level").desc(), "name").mapInArrow(time_forward(held), TOTALS_SCHEMA)


def _along_paths(heavy: DataFrame, each: int = 50_000) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` from each node to the end of its path of
    nodes with one ``name``, in blocks of levels."""
    heavy = heavy.withColumn("block", F.expr(f"level div {each}"))
    sums = heavy.groupBy("name", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    below = Window.partitionBy("name").orderBy(F.col("block").desc())
    sums = sums.select("name", "block", (F.sum("l").over(below) - F.col("l")).alias("below_l"), (F.sum("s").over(below) - F.col("s")).alias("below_s"))
    own = Window.partitionBy("name", "block").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = heavy.select("level", "name", "block", F.sum("leaves").over(own).alias("leaves"), F.sum("saved").over(own).alias("saved")).join(sums, ["name", "block"])
    return run.select("level", "name", (F.col("leaves") + F.col("below_l")).alias("leaves"), (F.col("saved") + F.col("below_s")).alias("saved"))


def subtree_totals(nodes: DataFrame, members: DataFrame, shard_turns: int = SHARD_TURNS, held: int = HELD) -> DataFrame:
    """``level, name, leaves, saved`` of every node's subtree.

    ``nodes`` has ``level, k1, k2, name, up_level, up_name, leaves, saved`` (own
    numbers), ``below`` (turns of its members beyond it, a bound on what hangs
    below) and ``up_below``; ``name`` is the smallest member, so nodes with one
    name are a path downwards. ``members`` gives the keys of every named
    conversation's nodes (``member, level, k1, k2``).

    1. A node is light with at most ``shard_turns`` turns below. The top light
       nodes are the shards' roots; each shard is one sorted pass with a
       spilling queue, many to a task.
    2. Shard roots send their totals to the heavy nodes above, summed before
       they are shuffled. A path of heavy nodes is one row; paths go through
       the same pass as one shard, the lowest tops first.
    3. Heavy nodes add what the paths that hang on them brought, and sum along
       their path in blocks, so a long path or a wide node needs no long task.
    """
    light = F.col("below") <= shard_turns
    roots = nodes.filter(light & (F.col("up_below").isNull() | (F.col("up_below") > shard_turns))).select("level", "k1", "k2", "name")
    shards = members.join(roots, ["level", "k1", "k2"]).select(F.col("member").alias("name"), F.col("level").alias("shard1"), F.col("name").alias("shard2"))
    placed = nodes.filter(light).join(shards, "name")
    done = materialise(_totals(placed, partitions_for(placed.count(), 50_000, 8), held))
    heavy = nodes.filter(~light)
    out = done.select("level", "name", "leaves", "saved")
    if heavy.isEmpty():
        return out
    sent = done.filter("level = shard1 AND name = shard2").groupBy(F.col("up_level").alias("level"), F.col("up_name").alias("name")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    add = lambda rows: (F.col("leaves") + F.coalesce("l", F.lit(0)), F.col("saved") + F.coalesce("s", F.lit(0)))
    met = heavy.join(sent, ["level", "name"], "left")
    met = materialise(met.withColumns(dict(zip(("leaves", "saved"), add(met), strict=True))).select("level", "name", "up_level", "up_name", "leaves", "saved"))
    paths = met.groupBy("name").agg(F.min("level").alias("level"), F.min_by("up_name", "level").alias("hangs_on"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    tops = paths.select("name", F.col("level").alias("top"))
    # A path's message goes to the path that it hangs on, under the level of that path's top.
    hung = paths.join(tops.withColumnRenamed("name", "hangs_on").withColumnRenamed("top", "up_level"), "hangs_on", "left").withColumn("up_name", F.when(F.col("up_level").isNotNull(), F.col("hangs_on")))
    whole = _totals(hung.withColumns({"shard1": F.lit(None), "shard2": F.lit(None)}), 1, held)
    brought = whole.filter("up_name IS NOT NULL").groupBy((F.col("level") - 1).alias("level"), F.col("up_name").alias("name")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    met = met.join(materialise(brought), ["level", "name"], "left")
    met = met.withColumns(dict(zip(("leaves", "saved"), add(met), strict=True)))
    return out.unionByName(_along_paths(met))


# -- digests of the conversations that end at a node ------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one node become rows with their ids as text."""
    key, first, ids = None, 0, []
    out: list[tuple] = []
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    held = 0
    for batch in batches:
        for depth, k1, k2, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (depth, k1, k2) != key or len(ids) >= PIECE_IDS:
                if ids:
                    out.append((*key, first, ",".join(ids)))
                    held += len(ids)
                key, first, ids = (depth, k1, k2), conv, []
                if held >= PIECE_IDS:
                    held = 0
                    yield flush()
            ids.append(str(conv))
    if ids:
        out.append((*key, first, ",".join(ids)))
    yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a node, fed piece by piece in the order of ids."""
    key, sha = None, None
    names = [*NODE, "sha"]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=names)

    for batch in batches:
        out = []
        for depth, k1, k2, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (depth, k1, k2) != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (depth, k1, k2), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield flush(out)
    yield flush([(*key, sha.hexdigest())] if key is not None else [])


def end_digests(ends: DataFrame, n: int) -> DataFrame:
    """``depth, k1, k2, sha`` from (depth, k1, k2, conv_id): SHA-256 of the ids, ascending, comma-joined.

    Ids are put in order by ranges, so those of a node where many end are
    joined in many tasks; one task then hashes the pieces as they come.
    """
    order = [*NODE, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(partitions_for(n, RANGE_ROWS, 8), *order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(_pieces, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    return pieces.repartition(partitions_for(n, RANGE_ROWS, 8), *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "depth bigint, k1 bigint, k2 bigint, sha string")


# -- the trie ---------------------------------------------------------------


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, held: int = HELD) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    Null roles and texts count as empty; a null turn comes first; rows that
    repeat a turn are turns of their own, in the order of their MD5; rows
    without a conv_id belong to no conversation. A conversation without turns
    left is a member of the root. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    turns = ranked(conversations)
    rows, convs = rebuilt(turns)
    convs = materialise(convs)
    rows = materialise(prefixes(rows, convs))
    size = F.col("turns") - F.col("depth")
    found = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("size").alias("size"), F.first("up1").alias("up1"), F.first("up2").alias("up2"), F.sum(size).alias("below"))
    zero = _key(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 4)
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("turns").alias("below")).filter("n_convs > 0")
    none = lambda name: F.lit(None).cast("long").alias(name)
    top = top.select(F.lit(0).cast("long").alias("depth"), *zero, "conv_id", "n_convs", F.lit(0).cast("long").alias("size"), none("up1"), none("up2"), "below")
    found = materialise(found.withColumn("depth", F.col("depth").cast("long")).unionByName(top))

    root = F.broadcast(found.filter("depth = 0").select(F.col("conv_id").alias("root_id"), F.col("below").alias("root_below")))
    above = found.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"), F.col("below").alias("up_below"))
    first = found.filter("depth = 1").crossJoin(root).withColumnRenamed("root_id", "parent_conv_id").withColumnRenamed("root_below", "up_below")
    rest = found.filter("depth > 1").join(above, ["depth", "up1", "up2"])
    nodes = materialise(found.filter("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "up_below": F.lit(None).cast("long")}).unionByName(first).unionByName(rest).drop("up1", "up2"))

    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, ["depth", "conv_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    named = nodes.select("conv_id").distinct()
    members = rows.join(named, "conv_id").select(F.col("conv_id").alias("member"), F.col("depth").cast("long").alias("level"), "k1", "k2")
    members = members.unionByName(named.select(F.col("conv_id").alias("member"), F.lit(0).cast("long").alias("level"), *zero))
    totals = subtree_totals(
        nodes.select(
            F.col("depth").alias("level"),
            "k1",
            "k2",
            F.col("conv_id").alias("name"),
            F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up_level"),
            F.col("parent_conv_id").alias("up_name"),
            F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
            "below",
            "up_below",
        ),
        members,
        shard_turns,
        held,
    )
    ends = rows.filter("depth = turns").select(F.col("depth").cast("long").alias("depth"), "k1", "k2", "conv_id").unionByName(convs.filter("turns = 0").select(F.lit(0).cast("long").alias("depth"), *zero, "conv_id"))
    digests = end_digests(ends, convs.count())
    out = nodes.join(totals.select(F.col("level").alias("depth"), F.col("name").alias("conv_id"), "leaves", "saved"), ["depth", "conv_id"]).join(digests, NODE, "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
