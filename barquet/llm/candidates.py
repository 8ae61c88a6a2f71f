"""Candidates for near copies: sets that share one of their rare elements and whose fingerprints are near.

Two sets with a Jaccard similarity of t have at least t of either in common, so
if all elements are put in one order, the first (1 - t) of each set (and one
more) share an element: the prefix filter. No pair of sets is lost by it,
whichever the order; with the rarest first, few others meet. Work and rows
follow the text, not the square of the number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, partitions_for
from .components import forest

#: Elements stand as the upper 32 bits of their hashes, in ascending order; two that share them only make more sets meet.
TOKEN = np.dtype("<u4")
#: Elements are counted by their first 18 bits. Only the order of elements follows from the counts.
COUNT_BITS, COUNT_CHUNKS = 18, 16
#: Entries (an element of a set) of one part, about; 44 bytes each at most.
PART_ENTRIES = 1 << 20
#: Sets that share an element are compared all at once up to so many, else one after another.
FEW = 32
#: Of sets this small a single element moves many bits (at 4 of 5 alike 48 of 256 on average), so they get a wider radius.
TINY, WIDER = 8, 16


def prefix(tokens: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The elements of one set of which it shares one with every set that is as similar: the rarest by ``counts``."""
    n = len(tokens)
    k = n - math.ceil(similarity * n - 1e-9) + 1
    if k >= n:
        return tokens
    key = counts[tokens >> TOKEN.type(32 - COUNT_BITS)].astype(np.uint64) << np.uint64(32) | tokens
    return np.partition(key, k - 1)[:k].astype(TOKEN)


def _near(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Which fingerprints x and y of sets of m and n elements are within the radius; sets of too different sizes aren't."""
    most = np.maximum(m, n)
    return (np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= radius + WIDER * (most <= TINY)) & (np.minimum(m, n) >= similarity * most - 1e-9)


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    while True:
        up = parent[nodes]
        if (up == nodes).all():
            return nodes
        nodes = up


def bucket_links(tokens: np.ndarray, places: np.ndarray, fps: np.ndarray, sizes: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``fps`` as a forest whose components are those of all pairs that
    share a token and are near. ``places``: whose token it is. Each component is
    linked to its smallest fingerprint."""
    none = np.array([], np.int64)
    key = np.unique(tokens.astype(np.uint64) << np.uint64(32) | places.astype(np.uint64))
    token = key >> np.uint64(32)
    again = token[1:] == token[:-1]
    shared = np.append(False, again) | np.append(again, False) if len(key) else np.array([], bool)
    key, token = key[shared], token[shared]
    if not len(key):
        return none, none
    nodes, at = np.unique((key & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True)
    x, n = fps[nodes], sizes[nodes].astype(np.int64)
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    length = np.diff(np.append(starts, len(token)))
    us, vs = [none], [none]

    some = np.repeat(length <= FEW, length)
    own, of = at[some], token[some]
    for d in range(1, FEW):
        first = np.flatnonzero(of[d:] == of[:-d]) if d < len(of) else none
        if not len(first):
            break
        for k in range(0, len(first), 1 << 17):
            u, v = own[first[k : k + (1 << 17)]], own[first[k : k + (1 << 17)] + d]
            near = _near(x[u], x[v], n[u], n[v], radius, similarity)
            us.append(u[near])
            vs.append(v[near])

    # A large bucket is searched from one member to the next; members that are found aren't compared
    # again, here or in the buckets that follow, so a group of near copies costs little more than its size.
    parent = np.arange(len(nodes))
    for s, m in zip(starts[length > FEW].tolist(), length[length > FEW].tolist()):
        members = at[s : s + m]
        root = _roots(parent, members)
        rest = np.arange(m)
        while len(rest):
            open_, rest, found = [int(rest[0])], rest[1:], []
            while open_:
                p = open_.pop()
                found.append(p)
                if not len(rest):
                    continue
                known = root[rest] == root[p]
                near = known.copy()
                new = np.flatnonzero(~known)
                if len(new):
                    i = members[rest[new]]
                    close = _near(x[i], x[members[p]][None, :], n[i], n[members[p]], radius, similarity)
                    near[new[close]] = True
                    us.append(np.full(np.count_nonzero(close), members[p]))
                    vs.append(i[close])
                if near.any():
                    open_ += rest[near].tolist()
                    rest = rest[~near]
            parent[root[found]] = root[found].min()
    u, v = np.concatenate(us), np.concatenate(vs)
    linked = np.unique(np.concatenate([u, v]))
    ordered = linked[np.lexsort(x[linked].T)]  # the same in every part, so that equal links of many parts become one
    place = np.empty(len(nodes), np.int64)
    place[ordered] = np.arange(len(ordered))
    u, v = forest(place[u], place[v])
    return nodes[ordered[u]], nodes[ordered[v]]


def token_counts(sets: DataFrame) -> np.ndarray:
    """How many elements (column ``tokens``) begin with each of the ``COUNT_BITS`` bits."""
    size = (1 << COUNT_BITS) // COUNT_CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            flat = np.concatenate([np.frombuffer(x.as_buffer(), TOKEN) for x in batch.column(0)] or [np.array([], TOKEN)])
            for k in range(0, len(flat), 1 << 20):
                own += np.bincount(flat[k : k + (1 << 20)] >> TOKEN.type(32 - COUNT_BITS), minlength=len(own))
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_CHUNKS), pa.int32()), pa.array([own[k * size : (k + 1) * size].tobytes() for k in range(COUNT_CHUNKS)], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(x.as_buffer(), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    kind, out = "chunk int, counts binary", np.zeros(1 << COUNT_BITS, np.int64)
    for r in sets.select("tokens").mapInArrow(lean(count), kind).repartition(COUNT_CHUNKS, "chunk").mapInArrow(lean(add), kind).collect():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out, 0xFFFFFFFF).astype(np.uint32)


def candidate_links(sets: DataFrame, similarity: float, radius: int, bits: int) -> DataFrame:
    """``a, b``: fingerprints in such pairs that their components are those of
    all pairs of sets that share an element of their ``prefix`` and are within
    the radius. ``sets``: fp, size, tokens; a written table.

    Every set sends its prefix to parts by element, with its fingerprint once a
    part; a part is one task. A part's links are a forest, and those that many
    parts find are one row."""
    words = bits // 64
    counts = sets.sparkSession.sparkContext.broadcast(token_counts(sets))
    about = sets.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    parts = partitions_for(math.ceil((1 - similarity) * (about["size"] or 0)) + about["n"], PART_ENTRIES, 8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt() -> Iterator[pa.RecordBatch]:
            tokens, places = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
            fp, size = np.frombuffer(b"".join(fps), np.uint64).reshape(-1, words), np.array(sizes, TOKEN)
            part = tokens % TOKEN.type(parts)
            order = np.argsort(part, kind="stable")
            part, tokens, places = part[order], tokens[order], places[order]
            ends = np.searchsorted(part, np.arange(parts), "right")
            rows: list[tuple] = []
            for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                if b > a:
                    mine, at = np.unique(places[a:b], return_inverse=True)
                    rows.append((k, fp[mine].tobytes(), size[mine].tobytes(), tokens[a:b].tobytes(), at.astype(TOKEN).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4])], ["part", "fps", "sizes", "tokens", "places"])

        own, fps, sizes, held = [], [], [], 0
        for batch in batches:
            for fp, size, tokens in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                if size:
                    own.append(prefix(np.frombuffer(tokens.as_buffer(), TOKEN), counts.value, similarity))
                    fps.append(fp.as_py())
                    sizes.append(min(size, 0xFFFFFFFF))
                    held += len(own[-1])
                if held >= PART_ENTRIES // 2:
                    yield from dealt()
                    own, fps, sizes, held = [], [], [], 0
        if own:
            yield from dealt()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        n = 0
        for batch in batches:
            for row in range(batch.num_rows):
                fp, size, tokens, places = (np.frombuffer(batch.column(k)[row].as_buffer(), t) for k, t in ((1, np.uint64), (2, TOKEN), (3, TOKEN), (4, TOKEN)))
                for x, y in zip(columns, (fp.reshape(-1, words), size, tokens, places + TOKEN.type(n))):
                    x.append(y)
                n += len(size)
        if n:
            fps, sizes, tokens, places = (np.concatenate(x) for x in columns)
            del columns
            u, v = bucket_links(tokens, places, fps, sizes, radius, similarity)
            for k in range(0, len(u), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in fps[at[k : k + (1 << 14)]]], pa.binary()) for at in (u, v)], ["a", "b"])

    entries = sets.select("fp", "size", "tokens").mapInArrow(lean(deal), "part int, fps binary, sizes binary, tokens binary, places binary")
    links = entries.repartitionById(parts, F.col("part")).mapInArrow(lean(meet), "a binary, b binary")
    return materialise(links.filter("a <> b").distinct())
