"""Connected components in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions_for

#: Links that one task thins at once, about; 32 bytes an end.
THIN_LINKS = 1 << 19


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, by hooking and
    pointer jumping on whole arrays."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links than nodes, with the components that (u, v) have."""
    nodes, places = np.unique(np.concatenate([u, v]).astype(np.int64), return_inverse=True)
    root = labels(len(nodes), places[: len(u)], places[len(u) :])
    away = root != np.arange(len(nodes))
    return nodes[root[away]], nodes[away]


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) with the components of ``links``: of about ``THIN_LINKS`` that
    lie together a spanning forest stays, fewer links than they have nodes, so a
    large group whose links come from many tasks doesn't go through the joins with all of them."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spanning(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ends = pa.concat_arrays([c for k in (0, 1) for c in table.column(k).chunks]).dictionary_encode()
            at = ends.indices.to_numpy()
            u, v = forest(at[: table.num_rows], at[table.num_rows :])
            return pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(x)) for x in (u, v)], ["a", "b"])

        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * THIN_LINKS:
                held = [spanning(held)]
                if held[0].num_rows >= THIN_LINKS:
                    yield held.pop()
        if held:
            yield spanning(held)

    kind = links.schema["a"].dataType.simpleString()
    return links.coalesce(partitions_for(links.count(), THIN_LINKS)).mapInArrow(thin, f"a {kind}, b {kind}")


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links`` (a, b): the root is the
    component's smallest node.

    Large-star and small-star steps by turns: each node's neighbours move to
    its smallest one, until nothing changes; rounds grow with the logarithm of
    the size. A step is one partial minimum and one join with one row a node
    on one side, so a hot node may be split. Each round is a written table, and
    the first is of ``thinned`` links, so its rows follow the nodes, not the links.
    """
    edges = materialise(thinned(links.filter("a <> b").select("a", "b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # Large star: larger neighbours of u go to its smallest one. (u, v) has u > v, so v's larger neighbour is u.
        large = edges.join(low.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct())
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.filter("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
