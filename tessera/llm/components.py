"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

#: Edges that are contracted at once, and edges that one task contracts to the end: rounds are for more.
BLOCK, FEW = 200_000, 50_000


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node each is connected with) of edges a - b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        p, q = parent[x], parent[y]
        if (p == q).all():
            return nodes, nodes[parent]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def contracted(edges: DataFrame) -> DataFrame:
    """The same components from stars: of each block of edges, a link from every node to its
    smallest. Paths inside a block take no round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0

        def stars() -> pa.RecordBatch:
            node, low = smallest(np.concatenate(a), np.concatenate(b))
            far = node != low
            return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(low[far])], ["a", "b"])

        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
            held += batch.num_rows
            if held >= BLOCK:
                yield stars()
                a, b, held = [], [], 0
        if held:
            yield stars()

    return edges.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of links (a, b).

    Large-star links every greater neighbour to the smallest one around a node,
    small-star every smaller one; both keep components whole and take O(log^2) rounds, fewer as
    each task first contracts its blocks of edges to stars. Each round is two aggregations
    with map-side minima, so a node with very many links is one row after its partition;
    nothing is collected but one sum for the end test. FEW edges at most (1 MB) are one block, and take no round."""
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges = staged(contracted(edges).distinct())
    mark = _mark(edges)
    if mark[0] <= FEW:
        few = staged(contracted(edges.coalesce(1)))
        unstage(edges)
        return _rooted(few)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        new = staged(contracted(small.filter("a <> b")).distinct())
        unstage(edges)
        edges, before, mark = new, mark, _mark(new)
        if mark == before:
            return _rooted(edges)


def _rooted(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
