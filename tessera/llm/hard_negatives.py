"""Hard negatives by one-dimensional distance keys.

A row's score is its inner product with the anchor. With M the greatest norm of all rows, a row x
is stored as (x, sqrt(M^2 - |x|^2)) and an anchor q asks as (q, 0): all stored rows have
norm M, so that the squared distance is |q|^2 + M^2 - 2 score, and near is high. A stored row's
key is (pivot, distance to it), the pivot being the nearest of a few; the store is cut by
key into cells (a pivot, an interval of distances), and a cell's rows lie sorted by distance.
By the triangle inequality, a row whose distance to the pivot differs by t from the anchor's is at
least t away from the anchor: a cell's interval bounds the scores in it.

A search takes two steps. The first scans the cells that promise most and gives the scores that
the rest must reach; the second widens the interval of keys to every cell, and in it every
stored row, whose bound reaches those. What remains is further away than what was found: the
result is exact. Positives are searched without an upper end; the negatives of a
positive start at the share `high` of its score, so the annulus they lie in has two radii.

Equal rows (vector and label) are one class with its smallest ids, as many as a result can
hold, and equal anchors ask once. A cell of more than `BLOCK` classes is several blocks; a task
holds one block and streams the anchors that reach it.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no part;
components are scaled, rounded down, and held within 26 bits; a repeated row counts once; a row
with the anchor's own id is none of its positives; each dimension is a space of its own (an
empty vector scores 0); negative scores of a positive leave no interval, so no negatives;
fewer rows than asked give fewer; an empty table gives none; extra columns are ignored.
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

#: Classes that pivots and intervals are fitted on, cells of a dimension at most, classes of a block.
SAMPLE, CELLS, BLOCK = 8192, 4096, 2048
#: Cells that the first step scans.
FIRST = 2
#: Products of whole numbers are exact in doubles below this.
EXACT = 2**53
#: Scaled components are held within this, so that products of 2,048 fit a long.
TOP = 2**26


class Keys:
    """Pivots of one dimension and the intervals of distances around each."""

    def __init__(self, sample: np.ndarray, norm2: float, classes: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.norm2, self.dim = norm2, sample.shape[1]
        x = self.stored(sample)
        cells = max(1, min(CELLS, len(sample) // 8, classes // BLOCK))
        n = max(1, math.isqrt(cells))
        p = x[rng.choice(len(x), n, replace=False)]
        for _ in range(5):
            own = self._distances(x, p).argmin(1)
            count = np.bincount(own, minlength=n)
            total = np.zeros_like(p)
            np.add.at(total, own, x)
            p = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], p)
        self.pivots, self.rings = p, max(1, cells // n)
        d = self._distances(x, p)
        own = d.argmin(1)
        steps = np.arange(1, self.rings) / self.rings
        self.edges = [np.quantile(d[own == i, i], steps) if (own == i).any() else np.zeros(self.rings - 1) for i in range(n)]

    def stored(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))])

    def asking(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))])

    @staticmethod
    def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of each row."""
        d = self._distances(self.stored(x), self.pivots)
        own = d.argmin(1)
        d = d[np.arange(len(x)), own]
        ring = np.zeros(len(x), np.int64)
        for i in np.unique(own):
            ring[own == i] = np.searchsorted(self.edges[i], d[own == i])
        return own * self.rings + ring, d

    def bounds(self, q: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score that rows of each cell, with distances from low to high, can have
        with each anchor; widened by what rounding can do."""
        d = self._distances(self.asking(q), self.pivots)[:, cell // self.rings]
        near, far = np.maximum(np.maximum(d - high, low - d), 0), d + high
        whole = (q * q).sum(1)[:, None] + self.norm2
        slack = 1e-7 * whole + 1e-6
        return (whole - far * far) / 2 - slack, (whole - near * near) / 2 + slack


def _matrix(array: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(array.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(array), dim)


def _rows(vectors: list, dim: int) -> np.ndarray:
    return np.array(vectors, np.float64).reshape(len(vectors), dim)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with q (whole numbers)."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1]) < EXACT:
        return (x @ q).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * component) of each, within TOP."""
    top = F.lit(float(TOP))
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), top), -top)).cast("int"))


class Store:
    """Classes by key, and searches over them."""

    def __init__(self, classes: DataFrame, ids: int) -> None:
        spark = classes.sparkSession
        self.ids = ids
        norm = F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        stats = {r["dim"]: (r["n"], r["m"]) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).collect()}
        by_dim = W.partitionBy("dim").orderBy("key")
        sample = classes.select("dim", "e", "key").withColumn("rn", F.row_number().over(by_dim)).filter(F.col("rn") <= SAMPLE).select("dim", "e").collect()
        keys = {d: Keys(_rows([r.e for r in sample if r.dim == d], d), m, n) for d, (n, m) in stats.items()}
        self.keys = spark.sparkContext.broadcast(keys)
        shared = self.keys

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column("dim").to_numpy()
                for d in np.unique(dims):
                    own = b.take(pa.array(np.flatnonzero(dims == d)))
                    cell, far = shared.value[d].place(_matrix(own.column("e"), d))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell, pa.int32()), pa.array(far)], [*own.schema.names, "cell", "far"])

        self.rows = staged(classes.mapInArrow(place, "key string, label int, dim int, e array<int>, ids array<long>, cell int, far double"))
        # at most CELLS rows a dimension
        cells = self.rows.groupBy("dim", "cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n")).collect()
        self.cells = spark.sparkContext.broadcast({d: np.array(sorted((r.cell, r.low, r.high, -(-r.n // BLOCK)) for r in cells if r.dim == d), np.float64).reshape(-1, 4) for d in stats})
        parts = spark.createDataFrame([(r.dim, r.cell, -(-r.n // BLOCK)) for r in cells], "dim int, cell int, parts int")
        self.blocks = self.rows.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")

    def _routed(self, asks: DataFrame, first: bool) -> DataFrame:
        """asks with the blocks that each is to scan in this step: the cells of the first one, or all
        others whose bounds meet what is wanted."""
        shared, cells = self.keys, self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column("dim").to_numpy()
                for d in np.unique(dims):
                    own = b.take(pa.array(np.flatnonzero(dims == d)))
                    table = cells.value[d]
                    cell, low, high, parts = table[:, 0].astype(np.int64), table[:, 1], table[:, 2], table[:, 3].astype(np.int64)
                    least, most = shared.value[d].bounds(_matrix(own.column("e"), d), cell, low, high)
                    out: list[list] = [[], [], []]
                    for i, (tops, reach) in enumerate(zip(own.column("top").to_pylist(), own.column("bar").to_pylist(), strict=True)):
                        end = max((t for t in tops if t is not None), default=math.inf) if None not in tops else math.inf
                        # where a cell's rows would be if the anchor's direction said nothing of them
                        gap = np.maximum(least[i] - end, 0) * 4 if end < math.inf else 0
                        order = np.argsort(gap - np.minimum(most[i], end), kind="stable")
                        mine = order[:FIRST] if first else order[FIRST:]
                        floor = min(reach)
                        for c in mine[(most[i][mine] >= floor) & (least[i][mine] <= end)]:
                            out[0] += [i] * parts[c]
                            out[1] += [cell[c]] * parts[c]
                            out[2] += range(parts[c])
                    yield pa.RecordBatch.from_arrays([*own.take(pa.array(out[0], pa.int64())).columns, pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], [*own.schema.names, "cell", "part"])

        return asks.mapInArrow(run, "key string, label int, dim int, e array<int>, same boolean, top array<long>, bar array<long>, cell int, part int")

    def _scanned(self, asks: DataFrame, first: bool, best: int) -> DataFrame:
        """key, want (place in top), score, ids: the best classes of each block for each wanted end."""
        shared = self.keys
        cols = ["dim", "cell", "part", "role", "far", "key", "label", "e", "ids", "same", "top", "bar"]
        held = self.blocks.withColumns({"role": F.lit(0), "same": F.lit(None).cast("boolean"), "top": F.lit(None).cast("array<long>"), "bar": F.lit(None).cast("array<long>")}).select(cols)
        asked = self._routed(asks, first).withColumns({"role": F.lit(1), "far": F.lit(0.0), "ids": F.lit(None).cast("array<long>")}).select(cols)
        dealt = held.unionByName(asked).repartition(F.col("dim"), F.col("cell"), F.col("part")).sortWithinPartitions("dim", "cell", "part", "role", "far")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, ready = None, [], None
            for whole in batches:
                for lo in range(0, whole.num_rows, 2048):
                    b = whole.slice(lo, 2048)
                    place = np.stack([b.column(c).to_numpy() for c in ("dim", "cell", "part", "role")], axis=1)
                    edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
                    out: list[list] = [[], [], [], []]
                    for a, z in zip(edges[:-1], edges[1:], strict=True):
                        here, dim, s = tuple(place[a, :3].tolist()), int(place[a, 0]), b.slice(a, z - a)
                        if here != at:
                            at, held, ready = here, [], None
                        x, label = _matrix(s.column("e"), dim), s.column("label").to_numpy()
                        if place[a, 3] == 0:
                            held.append((x, label, s.column("far").to_numpy(), s.column("ids").to_pylist()))
                            continue
                        if not held:
                            continue
                        if ready is None:
                            ready = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), [i for h in held for i in h[3]]
                        keys = shared.value[dim]
                        pivot = keys.pivots[here[1] // keys.rings]
                        away = keys._distances(keys.asking(x), pivot[None, :])[:, 0]
                        asked = zip(s.column("key").to_pylist(), x, label, away, s.column("same").to_pylist(), s.column("top").to_pylist(), s.column("bar").to_pylist(), strict=True)
                        for key, q, own, d, same, tops, bars in asked:
                            for want, score, which in scan(ready, q, own, d, keys.norm2, same, tops, bars, best):
                                out[0].append(key)
                                out[1].append(want)
                                out[2].append(score)
                                out[3].append(ready[3][which])
                    if out[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))], ["key", "want", "score", "ids"])

        return dealt.mapInArrow(run, "key string, want int, score long, ids array<long>")

    def search(self, asks: DataFrame, best: int) -> DataFrame:
        """key, want, score, vec_id: for each end in top, the `best` rows of the same (or another)
        label with the highest scores up to it and from bar on; ties to smaller ids.

        asks: key, label, dim, e, same, top (null: no end), bar."""
        asks = staged(asks)
        early = staged(self._scanned(asks, True, best))
        order = W.partitionBy("key", "want").orderBy(F.desc("score"), "vec_id")

        def top(found: DataFrame) -> DataFrame:
            rows = found.select("key", "want", "score", F.explode("ids").alias("vec_id"))
            return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= best)

        # a full list raises what the rest must reach; equal scores may still win by their ids
        reached = top(early).filter(F.col("rn") == best).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("want", "score"))).alias("reached"))
        raised = F.transform("bar", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("reached", i.cast("int")), x)))
        late = asks.join(reached, "key", "left").withColumn("bar", raised).drop("reached").select(asks.columns)
        return staged(top(early.unionByName(self._scanned(late, False, best))).drop("rn"))


def scan(block: tuple, q: np.ndarray, label: int, away: float, norm2: float, same: bool, tops: list, bars: list, best: int) -> Iterator[tuple[int, int, int]]:
    """(want, score, place) of the best classes of a block (vectors, labels, distances in order, ids)."""
    vectors, labels, far, ids = block
    whole = float(q @ q) + norm2
    # scores from the least bar on are within this distance, so keys beyond it need no look
    near = math.sqrt(max(whole - 2 * min(bars), 0.0) + 1e-7 * whole + 1e-6) if min(bars) > -(2**62) else math.inf
    lo, hi = np.searchsorted(far, [away - near - 1e-6, away + near + 1e-6])
    score = products(vectors[lo:hi], q)
    fits = (labels[lo:hi] == label) == same
    for want, (top, bar) in enumerate(zip(tops, bars, strict=True)):
        good = fits & (score >= bar)
        if top is not None:
            good &= score <= top
        at = np.flatnonzero(good)
        if len(at) > best:
            s = score[at]
            at = at[s >= np.partition(s, len(s) - best)[len(s) - best]]
        for i in sorted(at.tolist(), key=lambda i: (-score[i], ids[lo + i][0]))[:best]:
            yield want, int(score[i]), lo + i


def hard_negatives(
    table: DataFrame,
    anchor: Column,
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every row with
    anchor true and each of its first `positives` rows of the same label, the first
    `negatives` rows of other labels with scores from low to high percent of the positive's."""
    with scope() as keep:
        return keep(staged(_mined(table, anchor, label, positives, negatives, low, high, scale, vec_id, vector)))


def _mined(table: DataFrame, anchor: Column, label: Column | str, positives: int, negatives: int, low: int, high: int, scale: int, vec_id: str, vector: str) -> DataFrame:
    label = F.col(label) if isinstance(label, str) else label
    named = table.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    rows = named.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v")).withColumn("e", scaled("v", scale)).drop("v")
    rows = staged(rows.withColumn("key", F.md5(F.concat_ws(":", "label", F.col("e").cast("string")).cast("binary"))))
    most = max(positives + 1, negatives)
    ids = rows.select("key", "vec_id").distinct().withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy("vec_id"))).filter(F.col("rn") <= most)
    ids = ids.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = rows.groupBy("key").agg(F.any_value("label").alias("label"), F.any_value("e").alias("e"))
    classes = staged(vectors.join(ids, "key").select("key", "label", F.size("e").alias("dim"), "e", "ids"))
    anchors = staged(rows.filter("asks").select(F.col("vec_id").alias("anchor_id"), "key").distinct())
    store = Store(classes, most)

    asking = staged(classes.join(anchors.select("key").distinct(), "key", "left_semi").drop("ids"))
    lowest = F.lit(-(2**63)).cast("long")
    near = store.search(asking.withColumns({"same": F.lit(True), "top": F.array(F.lit(None).cast("long")), "bar": F.array(lowest)}), positives + 1)
    first = F.row_number().over(W.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id"))
    pairs = anchors.join(near, "key").filter("vec_id <> anchor_id").withColumn("rn", first).filter(F.col("rn") <= positives)
    pairs = staged(pairs.select("key", "anchor_id", "rn", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # the whole numbers s with low * p <= 100 * s <= high * p; none if p is negative
    p = F.col("positive_score")
    ends = near.filter("score >= 0").select("key", F.col("score").alias("positive_score")).distinct()
    ends = ends.withColumn("top", F.expr(f"positive_score * {high} div 100")).withColumn("bar", F.expr(f"(positive_score * {low} + 99) div 100"))
    lists = ends.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("positive_score", "top", "bar"))).alias("w"))
    asks = asking.join(lists, "key").withColumns({"same": F.lit(False), "top": F.col("w.top"), "bar": F.col("w.bar")})
    found = store.search(asks.select("key", "label", "dim", "e", "same", "top", "bar"), negatives)
    scores = lists.select("key", F.posexplode("w.positive_score").alias("want", "positive_score"))
    found = found.join(scores, ["key", "want"]).select("key", "positive_score", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    rank = F.row_number().over(W.partitionBy("anchor_id", "key", "rn").orderBy(F.desc("negative_score"), "negative_id"))
    out = pairs.join(found, ["key", "positive_score"]).withColumn("rank", rank)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", p, "negative_score")
