"""SimHash near-dedup (operator 5): tiled exact comparison of fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import TOKEN, candidate_links
from .common import lean, materialise, partitions_for
from .components import connected_components, forest

#: A tile holds about this many times the square root of the number of fingerprints: work is then dealt
#: into enough pairs of tiles, and the fingerprints sent to pairs grow as the power 1.5.
TILE_ROOTS = 32
#: Fingerprint pairs that one task compares, about.
TASK_PAIRS = 1 << 28
SLICE = 1 << 16
#: Shingles in a block of a component that is compared whole, about.
BLOCK_HASHES = 1 << 20
#: Rows of ids that are broadcast at most, 100 bytes each; beyond, Spark shuffles them.
BROADCAST_ROWS = 500_000


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits that stand for a hash; the first are the hash itself."""
    if k == 0:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _shingle_slices(text: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text's words, repeats included, ``SLICE`` at a time."""
    tokens = text.lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(tokens) > shingle:
        starts, ends = starts[: len(tokens) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SLICE):
        yield np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist())], np.uint64)


def _majority(slices: Iterable[np.ndarray], words: int) -> np.ndarray:
    """Bit by bit: 1 if set in over half of the hashes."""
    ones, n = np.zeros((words, 64), np.int64), 0
    for h in slices:
        n += len(h)
        for k in range(words):
            ones[k] += np.unpackbits(_mixed(h, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<u8").reshape(words)


def fingerprint(text: bytes, shingle: int, words: int, seed: int = 42) -> np.ndarray:
    """``words`` 64-bit integers. Bit by bit: 1 if set in over half of the
    shingles' hashes; all zero for a text without words. Counted in slices, so
    that memory doesn't follow the text's length."""
    return _majority(_shingle_slices(text, shingle, seed), words)


def shingle_set(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; none for a text without words."""
    slices = list(_shingle_slices(text, shingle, seed))
    return np.unique(np.concatenate(slices)) if slices else np.array([], np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, bits: int = 64, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as big-endian bytes, one row per document."""
    words = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, words, seed).astype(">u8").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(lean(run), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp binary")


def _counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps).sum(axis=1, dtype=np.int64)


def linked(a: np.ndarray, b: np.ndarray, radius: int, same: bool, rows: int = 64, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, counted on through a and then b (``same``: a alone),
    of fingerprints that differ in at most ``radius`` bits, as a spanning
    forest of all such pairs: neighbours found so far are merged as the blocks
    go by, so nothing quadratic is kept. Blocks whose population counts differ
    beyond the radius are skipped; both sides must be sorted by population
    count. If the whole distance is within the radius, at least one 64-bit word
    is within its share, which is looked at first."""
    words = a.shape[1]
    share = radius // words
    ca, cb = _counts(a), _counts(b)
    shift = 0 if same else len(a)
    us, vs, kept = [np.array([], np.int64)], [np.array([], np.int64)], 0
    for i in range(0, len(a), rows):
        x, low, high = a[i : i + rows], ca[i], ca[min(i + rows, len(a)) - 1]
        first = max(np.searchsorted(cb, low - radius, "left"), i if same else 0)
        last = np.searchsorted(cb, high + radius, "right")
        for j in range(first, last, columns):
            y = b[j : min(j + columns, last)]
            near = np.bitwise_count(x[:, :1] ^ y[None, :, 0]) <= share
            for k in range(1, words):
                near |= np.bitwise_count(x[:, k : k + 1] ^ y[None, :, k]) <= share
            r, c = np.nonzero(near)
            if len(r) and words > 1:
                close = _counts(x[r] ^ y[c]) <= radius
                r, c = r[close], c[close]
            if same:
                r, c = r[i + r < j + c], c[i + r < j + c]
            if len(r):
                us.append(i + r)
                vs.append(j + c + shift)
                kept += len(r)
                if kept > 1 << 20:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, kept = [u], [v], 0
    return forest(np.concatenate(us), np.concatenate(vs))


def link_forest(distinct: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """``a, b``: fingerprints in such pairs that their components are those of
    all pairs within the radius. ``distinct``: one column fp, no repeats.

    Sorted by population count, the fingerprints are cut into tiles; a tile is
    one row. Each pair of tiles whose population counts come within the radius
    is compared in one task, and returns fewer links than it has fingerprints.
    """
    words = bits // 64
    n = distinct.count()
    tiles_wanted = max(1, math.isqrt(max(n, 1)) // TILE_ROOTS)
    ones = sum(F.bit_count(F.conv(F.substring(F.hex("fp"), 16 * k + 1 + 8 * half, 8), 16, 10).cast("long")) for k in range(words) for half in (0, 1))
    ordered = distinct.select(ones.cast("int").alias("ones"), "fp").repartitionByRange(tiles_wanted, "ones", "fp")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = b"".join(x.as_py() for batch in batches for x in batch.column(1))
        if raw:
            fps = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, words)
            counts = _counts(fps)
            order = np.argsort(counts, kind="stable")
            from pyspark import TaskContext

            ids = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([int(counts.min())], pa.int32()), pa.array([int(counts.max())], pa.int32()), pa.array([fps[order].tobytes()], pa.binary())], ["tile", "low", "high", "fps"])

    tiles = materialise(ordered.mapInArrow(tile, "tile long, low int, high int, fps binary"))
    last = tiles.agg(F.max("tile").alias("last")).first()["last"]
    if last is None:
        return distinct.sparkSession.createDataFrame([], "a binary, b binary")
    left = tiles.select("tile", "low", "high").withColumn("other", F.explode(F.sequence("tile", F.lit(last))))
    right = tiles.select(F.col("tile").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = left.join(right, "other").filter((F.col("low2") <= F.col("high") + radius) & (F.col("low") <= F.col("high2") + radius)).select("tile", "other")
    work = pairs.join(tiles.select("tile", "fps"), "tile").join(tiles.select(F.col("tile").alias("other"), F.col("fps").alias("fps2")), "other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py() == batch.column(1)[row].as_py()
                a, b = (np.frombuffer(batch.column(k)[row].as_buffer(), np.uint64).reshape(-1, words) for k in (2, 3))
                u, v = linked(a, b, radius, same)
                fps = (a if same else np.concatenate([a, b])).astype(">u8")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in fps[at]], pa.binary()) for at in (u, v)], ["a", "b"])

    # A number of its own, so that few bytes but long work aren't put together in few tasks.
    # Never more than there are pairs of tiles, and a pair of tiles grows only in proportion to the fingerprints.
    tasks = min(1 + n * n // 2 // TASK_PAIRS, (last + 1) * (last + 2) // 2)
    balanced = work.select("tile", "other", "fps", "fps2").repartition(tasks, "tile", "other")
    return balanced.mapInArrow(lean(compare), "a binary, b binary")


def near_classes(docs: DataFrame, radius: int = 4, shingle: int = 4, bits: int = 64, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per document.

    Fingerprints link where at most ``radius`` bits differ; ``component_id`` is
    the smallest id reachable over links. Every pair of distinct fingerprints
    is compared but those that population counts rule out; equal fingerprints
    count once.

    Null and empty texts and texts without words have fingerprint zero and
    link to each other like any other. Fewer words than a shingle: the whole
    sequence is the one shingle. Null ids never are a component's id unless it
    has no other; repeated rows are members like any other; an empty table
    gives an empty result; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, shingle, bits, seed, id_col, text_col))
    first = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = materialise(link_forest(first.select("fp"), radius, bits))
    roots = connected_components(links)
    # Linked fingerprints only: the smallest id of each component, then of each fingerprint.
    rooted = roots.join(first, roots["node"] == first["fp"]).select("root", "fp", "first_id")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked_ids = rooted.join(smallest, "root").select("fp", "component_id")
    classes = materialise(first.join(linked_ids, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def near_deduplicate(docs: DataFrame, radius: int, shingle: int, bits: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is their
    component's id: one document of each group stays (and rows repeating it).
    Links are those of the fingerprints; edges as in ``near_classes``."""
    stay = near_classes(docs, radius, shingle, bits, seed, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    return docs.join(stay, F.col(id_col).eqNullSafe(F.col("__stay")), "left_semi")


def similar_links(sets: list[np.ndarray], second: np.ndarray | None, similarity: float) -> tuple[list[int], list[int]]:
    """A spanning forest of all pairs of sets (sorted distinct integers) with a
    Jaccard similarity of at least ``similarity``, as places. ``second`` marks
    the sets of a second block; only pairs across the blocks are then compared.
    Pairs that links found so far connect are left out, as they change nothing."""
    us, vs = [], []
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    live = np.flatnonzero(size)
    if len(live) < 2:
        return us, vs
    values, place = np.unique(np.concatenate([sets[i] for i in live]), return_inverse=True)
    size, ends = size[live], np.cumsum(size[live])
    starts = ends - size
    side = second[live] if second is not None else None
    label, own = np.arange(len(live)), np.zeros(len(values), bool)
    for p in range(len(live)):
        q = np.arange(p + 1, len(live)) if side is None else np.flatnonzero(side) if not side[p] else np.array([], np.int64)
        q = q[(label[q] != label[p]) & (np.minimum(size[q], size[p]) >= similarity * np.maximum(size[q], size[p]) - 1e-9)]
        if not len(q):
            continue
        own[place[starts[p] : ends[p]]] = True
        if 4 * len(q) < len(live):
            common = np.fromiter((np.count_nonzero(own[place[starts[i] : ends[i]]]) for i in q.tolist()), np.int64, len(q))
        else:
            common = np.add.reduceat(own[place], starts, dtype=np.int64)[q]
        own[place[starts[p] : ends[p]]] = False
        hit = q[common >= similarity * (size[q] + size[p] - common) - 1e-9]
        if len(hit):
            joined, first = np.unique(label[hit], return_index=True)
            us += [int(live[p])] * len(joined)
            vs += live[hit[first]].tolist()
            label[np.isin(label, joined)] = label[p]
    return us, vs


def similar_classes(docs: DataFrame, similarity: float = 0.8, radius: int = 63, shingle: int = 5, bits: int = 256, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, component_id``, one row per document: documents link where
    the Jaccard similarity of their sets of shingles is ``similarity`` or more;
    ``component_id`` is the smallest id reachable. ``th`` is XXH64 of the text.

    Fingerprints of the sets find candidates within a ``radius`` so wide that a
    link is hardly ever missed: at 0.8, 39 of 256 bits differ on average with a
    deviation of 6, so 63 lies four deviations beyond. What fingerprints connect
    is then compared shingle by shingle, so no pair under the similarity links.

    1. One scan gives each document's fingerprint, the hash of its set and its
       shingles in 32 bits. Equal sets are one member from here on, however
       many copies there are.
    2. Only sets that share one of their rarest shingles can be so similar:
       those meet (``candidates``), and a forest of fingerprints within the
       radius is left.
    3. Only members of its components that aren't alone have their texts read
       again and cut into shingles. A component is dealt in blocks of about
       ``BLOCK_HASHES`` shingles; each pair of its blocks is compared in one
       step, which returns fewer links than it has members, so no task holds a
       large component and no group's pairs leave a task.

    Null and empty texts and those without words are equal sets. Fewer words
    than a shingle: the whole sequence is the one shingle. Null ids never are a
    component's id unless it has no other; repeated rows are members like any
    other; an empty table gives an empty result; other columns are ignored.
    """
    words = bits // 64
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, fps, names, sizes, tokens, held = 0, [], [], [], [], 0
            for k, t in enumerate(batch.column(2), 1):
                own = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, seed)
                fps.append(_majority([own[i : i + SLICE] for i in range(0, len(own), SLICE)], words).astype(">u8").tobytes())
                names.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                tokens.append((own >> np.uint64(32)).astype(TOKEN).tobytes())
                held += len(own)
                if held > BLOCK_HASHES or k == batch.num_rows:
                    columns = [pa.array(fps, pa.binary()), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, k - at), batch.column(1).slice(at, k - at), *columns], ["doc_id", "th", "fp", "member", "size", "tokens"])
                    at, fps, names, sizes, tokens, held = k, [], [], [], [], 0

    prints = materialise(narrow.mapInArrow(lean(outline), f"doc_id {id_type}, th long, fp binary, member binary, size long, tokens binary"))
    members = materialise(prints.groupBy("member").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("row")))
    roots = connected_components(candidate_links(prints, similarity, radius, bits))
    placed = materialise(members.join(roots, members["fp"] == roots["node"], "left").select("member", "size", "row", F.coalesce("root", "fp").alias("root")))
    together = placed.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("hashes")).filter("n > 1")
    together = materialise(together.select("root", F.greatest(F.lit(1), F.ceil(F.col("hashes") / BLOCK_HASHES).cast("int")).alias("blocks")))
    # One row a component, so that a large component's members needn't meet in one task.
    candidates = materialise(placed.join(F.broadcast(together) if together.count() <= BROADCAST_ROWS else together, "root").select("root", "blocks", F.col("row.doc_id").alias("c_id"), F.col("row.th").alias("c_th"), "size"))
    found = candidates.agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("blocks")).alias("hashes")).first()
    few = candidates.drop("size")
    texts = narrow.join(F.broadcast(few) if found["n"] <= BROADCAST_ROWS else few, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th")))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, own, held = 0, [], [], 0
            for k, some in enumerate(batch.column(2), 1):
                hashes = shingle_set(some.as_buffer().to_pybytes() if some.is_valid else b"", shingle, seed).astype("<u8").tobytes()
                names.append(xxhash.xxh3_128_digest(hashes))
                own.append(hashes)
                held += len(hashes)
                if held > 8 * BLOCK_HASHES or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, k - at), batch.column(1).slice(at, k - at), pa.array(names, pa.binary()), pa.array(own, pa.binary())], ["root", "blocks", "member", "own"])
                    at, names, own, held = k, [], [], 0

    sets = texts.select("root", "blocks", "text").mapInArrow(lean(shingles), "root binary, blocks int, member binary, own binary")
    block = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    dealt = sets.select("root", "member", "own", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block"), "member", "own")
    tasks = partitions_for(int(found["hashes"] or 0), 4 * BLOCK_HASHES, 8)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(rows: list[dict]) -> None:
            rows = list({r["member"]: r for r in rows}.values())
            second = np.array([r["block"] != r["i"] for r in rows]) if rows[0]["i"] != rows[0]["j"] else None
            for out, at in zip((a, b), similar_links([np.frombuffer(r["own"], "<u8") for r in rows], second, similarity)):
                out.extend(rows[k]["member"] for k in at)

        a, b, held, key = [], [], [], None
        for batch in batches:
            for r in batch.to_pylist():
                if (now := (r["root"], r["i"], r["j"])) != key and held:
                    compared(held)
                    held = []
                key = now
                held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            a, b = [], []
        if held:
            compared(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    in_order = dealt.repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    linked_sets = connected_components(materialise(in_order.mapInArrow(lean(verify), "a binary, b binary")))
    rooted = linked_sets.join(members, linked_sets["node"] == members["member"]).select("root", "member", "first_id")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = materialise(rooted.join(smallest, "root").select("member", "component_id"))
    classes = members.select("member", "first_id").join(moved, "member", "left").select("member", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.select("doc_id", "th", "member").join(classes, "member").select("doc_id", "th", "component_id")


def deduplicate_similar(docs: DataFrame, similarity: float = 0.8, radius: int = 63, shingle: int = 5, bits: int = 256, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, but those that another
    document of their ``similar_classes`` component stands for: of each group
    the document with the smallest id stays, with rows that repeat it. Its
    edges hold here: texts without words are one group, a null id goes where
    its group has another id, and an empty table stays empty."""
    gone = similar_classes(docs, similarity, radius, shingle, bits, seed, id_col, text_col).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = materialise(gone.select(F.col("doc_id").alias("__gone"), F.col("th").alias("__gone_th")).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gone")) & (F.xxhash64(F.col(text_col)) == F.col("__gone_th")), "left_anti")
