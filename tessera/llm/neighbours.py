"""Approximate nearest neighbours: inverted lists scanned by adaptive dimensions.

Equal vectors form one class, so a vector that a third of all rows share is indexed once,
with its smallest ids. Centroids are fitted on a sample of classes (lowest hash first): 16 a
list, SAMPLE at least and MOST at most, so lists are as many as the root of the rows up to
MOST / 16, and beyond that they grow; every class is put into the list of its nearest centroid, and a query probes as
many lists as gave `RECALL` of the true neighbours on the sample (which a larger table
only eases: its neighbours are nearer).

Within a list, vectors are rotated by a random orthogonal matrix and kept in blocks of
`COLUMNS` dimensions. A candidate's partial distance after d of D dimensions,
scaled by D / d, is tested against the best so far: above (1 + EPSILON / sqrt(d)) times, it is
given up. The survivors' distances are computed in double precision on the original vectors.

Lists are split into blocks of about `BLOCK` classes; a task holds one block and streams
the queries that probe it.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component, and
rows without an id, take no part; each dimension is a space of its own; fewer than k
others give fewer rows; equal distances go to the smaller id; a vec_id with several vectors
is a candidate, and a query, with each of them, but never its own neighbour; an empty
table gives none; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import scope, staged

SAMPLE, MOST, RECALL, BLOCK = 8192, 65_536, 0.97, 4096
COLUMNS, EPSILON = 16, 2.1


class Index:
    """Centroids and the rotation of one dimension."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        self.rotation = q * np.sign(np.diag(r))
        n = max(1, min(round(math.sqrt(rows)), len(sample) // 16))
        c = sample[rng.choice(len(sample), n, replace=False)].copy()
        for _ in range(10):
            own = self._near(sample, c)
            count = np.bincount(own, minlength=n)
            total = np.zeros_like(c)
            np.add.at(total, own, sample)
            c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        self.centroids = c
        self.probes = self._calibrate(sample, rng, k)

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)

    def _calibrate(self, x: np.ndarray, rng: np.random.Generator, k: int) -> int:
        own = self._near(x, self.centroids)
        q = rng.choice(len(x), min(256, len(x)), replace=False)
        d = (x * x).sum(1)[None, :] - 2 * x[q] @ x.T
        d[np.arange(len(q)), q] = np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return len(self.centroids)
        true = np.argpartition(d, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(self.order(x[q]), axis=1), axis=1)
        depth = np.take_along_axis(place, own[true], axis=1)
        return int(np.quantile(depth, RECALL, method="higher")) + 1

    def order(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, less the query's own norm."""
        return (self.centroids * self.centroids).sum(1)[None, :] - 2 * x @ self.centroids.T


def scan(q: np.ndarray, own: np.ndarray, blocks: list[np.ndarray], vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a block to one query: (places, distances).

    q: the rotated query, own: the original; blocks: rotated columns of the candidates."""
    n, dim = vectors.shape
    first = np.arange(min(n, 4 * k))
    d = np.sqrt(((vectors[first] - own) ** 2).sum(1))
    bar = np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf
    alive = np.arange(len(first), n)
    part, seen = np.zeros(len(alive)), 0
    for b in blocks:
        w = b.shape[1]
        part += ((b[alive] - q[seen : seen + w]) ** 2).sum(1)
        seen += w
        if seen < dim:
            stay = part * (dim / seen) <= (bar * (1 + EPSILON / math.sqrt(seen))) ** 2
            alive, part = alive[stay], part[stay]
    e = np.sqrt(((vectors[alive] - own) ** 2).sum(1))
    at, d = np.concatenate([first, alive]), np.concatenate([d, e])
    if len(d) > k:
        # ties at the bar stay, for the ids to settle
        keep = d <= np.partition(d, k - 1)[k - 1]
        at, d = at[keep], d[keep]
    return at, d


def _matrix(array: pa.Array, dim: int) -> np.ndarray:
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(-1, dim)


def usable(vector: str) -> Column:
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & whole & F.exists(v, lambda x: x != 0)


def nearest(table: DataFrame, query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row with query true."""
    with scope() as keep:
        return keep(staged(_nearest(table, query, k, vec_id, vector)))


def _nearest(table: DataFrame, query: Column, k: int, vec_id: str, vector: str) -> DataFrame:
    spark = table.sparkSession
    more = k + 1  # a query's own row is among the candidates of its class
    e = F.col(vector).cast("array<double>")
    rows = table.filter(F.col(vec_id).isNotNull()).withColumn("_e", e).filter(usable("_e"))
    rows = staged(rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("asks"), "_e", F.md5(F.col("_e").cast("string").cast("binary")).alias("key")))
    low = W.partitionBy("key").orderBy("vec_id")
    ids = rows.withColumn("rn", F.row_number().over(low)).filter(F.col("rn") <= more)
    classes = staged(ids.groupBy("key").agg(F.any_value("_e").alias("e"), F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("e")))
    asking = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "key")

    rows_of = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    take = max([SAMPLE, *(min(MOST, 16 * math.isqrt(n)) for n in rows_of.values())])
    by_dim = W.partitionBy("dim").orderBy("key")
    sample = classes.select("dim", "e", "key").withColumn("rn", F.row_number().over(by_dim)).filter(F.col("rn") <= take).select("dim", "e").collect()
    indexes = {d: Index(np.array([r.e for r in sample if r.dim == d]), n, k) for d, n in rows_of.items()}
    shared = spark.sparkContext.broadcast(indexes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                own = b.take(pa.array(np.flatnonzero(dims == d)))
                x = _matrix(own.column("e"), d)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(shared.value[d]._near(x, shared.value[d].centroids), pa.int32())], [*own.schema.names, "list"])

    indexed = staged(classes.mapInArrow(assign, "key string, e array<double>, ids array<long>, dim int, list int"))
    parts = F.broadcast(indexed.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")))  # at most MOST / 16 rows a dimension
    held = indexed.join(parts, ["dim", "list"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                own, index = b.take(pa.array(np.flatnonzero(dims == d))), shared.value[d]
                near = np.argsort(index.order(_matrix(own.column("e"), d)), axis=1, kind="stable")[:, : index.probes]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], [*own.schema.names, "lists"])

    probes = classes.join(asking.select("key").distinct(), "key", "left_semi").select("key", "e", "dim").mapInArrow(probe, "key string, e array<double>, dim int, lists array<int>")
    probes = probes.select("key", "e", "dim", F.explode("lists").alias("list")).join(parts, ["dim", "list"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cols = ["dim", "list", "part", "role", "key", "e", "ids"]
    both = held.withColumn("role", F.lit(0)).select(cols).unionByName(probes.withColumn("role", F.lit(1)).withColumn("ids", F.lit(None).cast("array<long>")).select(cols))
    dealt = both.repartition(F.col("dim"), F.col("list"), F.col("part")).sortWithinPartitions("dim", "list", "part", "role", "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], None
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                s = b.slice(lo, 2048)
                place = np.stack([s.column(c).to_numpy() for c in ("dim", "list", "part", "role")], axis=1)
                edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), s.num_rows]
                out: list[list] = [[], [], []]
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    here, dim = tuple(place[a, :3].tolist()), int(place[a, 0])
                    x = _matrix(s.column("e").slice(a, z - a), dim)
                    if here != key:
                        key, held, ready = here, [], None
                    if place[a, 3] == 0:
                        held.append((x, s.column("ids").slice(a, z - a).to_pylist()))
                        continue
                    if not held:
                        continue
                    turn = shared.value[dim].rotation
                    if ready is None:
                        vectors = np.concatenate([h[0] for h in held])
                        turned = vectors @ turn
                        ready = vectors, [np.ascontiguousarray(turned[:, i : i + COLUMNS]) for i in range(0, dim, COLUMNS)], [i for h in held for i in h[1]]
                    for name, own, q in zip(s.column("key").slice(a, z - a).to_pylist(), x, x @ turn, strict=True):
                        at, d = scan(q, own, ready[1], ready[0], more)
                        out[0] += [name] * len(at)
                        out[1] += d.tolist()
                        out[2] += [ready[2][i] for i in at]
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.int64()))], ["key", "score", "ids"])

    found = dealt.mapInArrow(search, "key string, score double, ids array<long>").select("key", "score", F.explode("ids").alias("vec_id"))
    best = W.partitionBy("key").orderBy("score", "vec_id")
    found = staged(found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= more).drop("rn"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    out = asking.join(found, "key").filter("vec_id <> query_id").withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
