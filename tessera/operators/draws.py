"""Bootstraps, matched permutations and random-set nulls as relations.

A draw picks rows by their place in a group, and the place is a checksum of (seed, draw, slot), so
results do not depend on how rows are dealt out, and SQL can list the same picks. What stays of a draw is a few
sums. Picks are not rows. Where slots are the rows of a group themselves (bootstraps of pairs), a task makes the picks of a range
of draws anew beside the group's values, up to HELD at a time, and none travels: what is shuffled are the values, once
a range. Elsewhere a task writes the picks of its slots as two bytes each, in one message for every block of PLACES
places, and a block's values meet the messages for it once. So a group may exceed a task."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.local import cut, sized_broadcast, to_local
from ..functions.nulls import safe_corr
from ..functions.ranks import numbered
from . import regression
from .stats import pearson_p_udf

BOOT, BOOT_DIFF, BOOT_LINES, MATCHED, NULL_DRAWS = 500, 2000, 2000, 2000, 1000
#: Numbers of 32 bits in a checksum.
NUMBERS = 4
#: Places of a block (under 2^16), picks that are dealt at once, and bytes of picks in a shuffled partition.
PLACES, PICKS, PART_BYTES = 1 << 14, 1 << 20, 64 << 20
#: Pairs of a group that a task holds (16 bytes each), pairs of a shuffled row, picks that are summed at once, and tasks of
#: pairs' draws for each core.
HELD, SEGMENT, SUMMED, TASKS = 1 << 24, 1 << 12, 1 << 18, 4


def checksums(draws: int, seed: int, slot: Column) -> Column:
    """The MD5 of seed:pack:slot of all packs of NUMBERS draws, one after another, as bytes: numbers of 32 bits, one a draw."""
    packs = F.sequence(F.lit(0), F.lit(-(-draws // NUMBERS) - 1))
    return F.unhex(F.array_join(F.transform(packs, lambda p: F.md5(F.concat(F.lit(f"{seed}:"), p.cast("string"), F.lit(":"), slot).cast("binary"))), ""))


_MESSAGE = "key string, block long, role int, at int, layer string, s array<double>, e array<double>, counts binary, picks binary"


def _dealt(draws: int):
    """Slots (key, size, sums) to messages: the picks of one block, by draw, with the number of each draw's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = min(max(1, PICKS // draws), PLACES)
        for whole in batches:
            for lo in range(0, whole.num_rows, most):
                b = whole.slice(lo, most)
                coded = b.column("key").dictionary_encode()
                names, at = coded.dictionary, coded.indices.to_numpy()
                size = b.column("size").to_numpy()
                u = np.frombuffer(b"".join(b.column("sums").to_pylist()), ">u4").reshape(b.num_rows, -1)[:, :draws]
                pick = u.astype(np.uint64) % size[:, None].astype(np.uint64)
                held = np.ones(len(names), np.int64)
                held[at] = (size + PLACES - 1) // PLACES
                first = np.cumsum(held) - held
                code = first[at][:, None].astype(np.uint64) + pick // np.uint64(PLACES)
                flat = (code * np.uint64(draws) + np.arange(draws, dtype=np.uint64)) * np.uint64(PLACES) + pick % np.uint64(PLACES)
                flat = flat.ravel()
                flat.sort()
                of = np.bincount((flat // np.uint64(PLACES)).astype(np.int64), minlength=int(held.sum()) * draws).reshape(-1, draws)
                ends = np.cumsum(of.sum(axis=1))
                places = (flat % np.uint64(PLACES)).astype("<u2")
                met = np.flatnonzero(of.any(axis=1))
                owner = np.searchsorted(first, met, side="right") - 1
                none = pa.nulls(len(met))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(owner)), pa.array(met - first[owner]), pa.array(np.ones(len(met), np.int32)), none.cast(pa.int32()), none.cast(pa.string()), none.cast(pa.list_(pa.float64())), none.cast(pa.list_(pa.float64())),
                     pa.array([of[i].astype("<u2").tobytes() for i in met.tolist()], pa.binary()), pa.array([places[ends[i] - of[i].sum() : ends[i]].tobytes() for i in met.tolist()], pa.binary())],
                    ["key", "block", "role", "at", "layer", "s", "e", "counts", "picks"],
                )

    return run


class _Block:
    """The values of a block's places by layer, and the sums and least values of its draws."""

    def __init__(self, draws: int, m: int, k: int) -> None:
        self.draws, self.m, self.k, self.rows, self.layers = draws, m, k, [], None

    def hold(self, b: pa.RecordBatch) -> None:
        numbers = lambda c, n: b.column(c).flatten().to_numpy().reshape(b.num_rows, n)
        self.rows.append((b.column("at").to_numpy(), b.column("layer").to_numpy(zero_copy_only=False), numbers("s", self.m), numbers("e", self.k)))

    def _spread(self) -> None:
        self.layers = {}
        at, layer, s, e = (np.concatenate(x) for x in zip(*self.rows))
        self.rows = []
        for name in dict.fromkeys(layer.tolist()):
            own = layer == name
            v, w = np.zeros((self.m, PLACES)), np.full((self.k, PLACES), np.inf)
            v[:, at[own]], w[:, at[own]] = s[own].T, e[own].T
            self.layers[name] = (v, w, np.zeros((self.draws, self.m)), np.full((self.draws, self.k), np.inf))

    def add(self, counts: bytes, picks: bytes) -> None:
        if self.layers is None:
            self._spread()
        n = np.frombuffer(counts, "<u2").astype(np.int64)
        met = np.flatnonzero(n)
        start, i = (np.cumsum(n) - n)[met], np.frombuffer(picks, "<u2").astype(np.int64)
        for v, w, total, least in self.layers.values():
            for j in range(self.m):
                total[met, j] += np.add.reduceat(v[j][i], start)
            for j in range(self.k):
                least[met, j] = np.minimum(least[met, j], np.minimum.reduceat(w[j][i], start))

    def result(self, key: str) -> Iterator[pa.RecordBatch]:
        for name, (_, _, total, least) in (self.layers or {}).items():
            wide = lambda x, n: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, n), pa.int32()) if n else pa.array(np.zeros(len(x) + 1), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([key] * self.draws), pa.array([name] * self.draws, pa.string()), pa.array(np.arange(self.draws)), wide(total, self.m), wide(least, self.k)], ["key", "layer", "_draw", "s", "e"])


def _added(draws: int, m: int, k: int):
    """Rows sorted by (key, block, role): the values of a block's places, then the messages for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for b in batches:
            if not b.num_rows:
                continue
            key, at, role = b.column("key").dictionary_encode().indices.to_numpy(), b.column("block").to_numpy(), b.column("role").to_numpy()
            edges = np.flatnonzero((key[1:] != key[:-1]) | (at[1:] != at[:-1]) | (role[1:] != role[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
                here = (b.column("key")[lo].as_py(), int(at[lo]))
                if here != now:
                    if block is not None:
                        yield from block.result(now[0])
                    now, block = here, _Block(draws, m, k)
                if role[lo] == 0:
                    block.hold(b.slice(lo, hi - lo))
                elif block.rows or block.layers:
                    for i in range(lo, hi):
                        block.add(b.column("counts")[i].as_py(), b.column("picks")[i].as_py())
        if block is not None:
            yield from block.result(now[0])

    return run


def drawn_sums(slots: DataFrame, places: DataFrame, draws: int, seed: int, sums: int, least: int) -> DataFrame:
    """key, layer, _draw, s0 .. (sums), e0 .. (least values) over a draw's picks: one place under size for every slot, of
    equal chances (to 2^-32), with replacement.

    slots: key, slot (string), size (the places of the key); places: key, place, layer, s (array of `sums`
    numbers), e (array of `least` numbers), one row a place and layer at most."""
    n = slots.count()
    spark = slots.sparkSession
    sent = slots.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * draws * 4 // PART_BYTES))).select("key", "size", checksums(draws, seed, F.col("slot")).alias("sums")).mapInArrow(_dealt(draws), _MESSAGE)
    none = F.lit(None).cast("binary")
    held = places.select("key", F.floor(F.col("place") / PLACES).alias("block"), F.lit(0).alias("role"), (F.col("place") % PLACES).cast("int").alias("at"), F.coalesce(F.col("layer").cast("string"), F.lit("")).alias("layer"), "s", "e", none.alias("counts"), none.alias("picks"))
    parts = -(-n * draws * 2 // PART_BYTES)
    both = sent.unionByName(held)
    both = both.repartition(parts, "key", "block") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else both.repartition("key", "block")
    added = both.sortWithinPartitions("key", "block", "role").mapInArrow(_added(draws, sums, least), "key string, layer string, _draw long, s array<double>, e array<double>")
    return added.groupBy("key", "layer", "_draw").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(sums)], *[F.min(F.col("e")[i]).alias(f"e{i}") for i in range(least)])


def _key(*groups: str) -> Column:
    return F.to_json(F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)])) if groups else F.lit("{}")


def _pairs(x: Column, y: Column) -> tuple[Column, Column]:
    """(sums, least values) of a pair, from which _r has the correlation."""
    return F.array(F.lit(1.0), x, y, x * x, y * y, x * y), F.array(x, -x, y, -y)


def _r() -> Column:
    """r of a draw of _pairs: NULL under three rows, or if a side has one value only."""
    n, x, y, xx, yy, xy = (F.col(f"s{i}") for i in range(6))
    scale = F.sqrt((xx - x * x / n) * (yy - y * y / n))
    moves = (F.col("e0") < -F.col("e1")) & (F.col("e2") < -F.col("e3"))
    return F.when((n >= 3) & moves, F.try_divide(xy - x * y / n, F.nullif(scale, F.lit(0.0))))


def interval(value: str) -> list[Column]:
    ends = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return [ends[0].alias("lo"), ends[1].alias("hi")]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (key, lead, size, place, x, y) to segments of a key and block: places in the block and values, as bytes."""
    for whole in batches:
        for lo in range(0, whole.num_rows, SEGMENT):
            b = whole.slice(lo, SEGMENT)
            key, place = b.column("key").dictionary_encode().indices.to_numpy(), b.column("place").to_numpy()
            block = place // HELD
            first = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1])
            ends = [*first[1:].tolist(), b.num_rows]
            cut_up = lambda v, kind: pa.array([v[i:j].astype(kind).tobytes() for i, j in zip(first.tolist(), ends)], pa.binary())
            own = [b.column(c).take(pa.array(first)) for c in ("key", "lead", "size")]
            values = [cut_up(place % HELD, "<u4"), *(cut_up(b.column(c).to_numpy(zero_copy_only=False), "<f8") for c in ("x", "y"))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(block[first]), *values], ["key", "lead", "size", "block", "at", "x", "y"])


def _sums_of(x: np.ndarray, y: np.ndarray, low: int, size: int, lead: str, draws: Sequence[int], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(draws x 6 sums, draws x 4 least values) of _pairs, over the picks of all slots that fall on the places from low."""
    packs = [f"{seed}:{p}:{lead}".encode() for p in range(draws[0] // NUMBERS, draws[-1] // NUMBERS + 1)]
    s, e = np.zeros((len(packs) * NUMBERS, 6)), np.full((len(packs) * NUMBERS, 4), np.inf)
    step = max(1, SUMMED // len(s))
    for lo in range(0, size, step):
        slots = [str(i).encode() for i in range(lo, min(lo + step, size))]
        u = np.frombuffer(b"".join([hashlib.md5(p + i, usedforsecurity=False).digest() for p in packs for i in slots]), ">u4").reshape(len(packs), len(slots), NUMBERS)
        pick = u.transpose(0, 2, 1).reshape(len(s), len(slots)).astype(np.uint32).astype(np.int64) % size - low
        here = None if low == 0 and len(x) == size else (pick >= 0) & (pick < len(x))
        if here is not None:
            pick = np.where(here, pick, 0)
        a, b = x[pick], y[pick]
        for j, v in enumerate((a, b)):
            for k, w in enumerate((v, -v)):
                np.minimum(e[:, 2 * j + k], (w if here is None else np.where(here, w, np.inf)).min(axis=1), out=e[:, 2 * j + k])
        if here is not None:
            a, b = np.where(here, a, 0.0), np.where(here, b, 0.0)
        s[:, 0] += len(slots) if here is None else here.sum(axis=1)
        s[:, 1] += a.sum(axis=1)
        s[:, 2] += b.sum(axis=1)
        for j, (v, w) in enumerate(((a, a), (b, b), (a, b)), 3):
            s[:, j] += np.einsum("ij,ij->i", v, w)
    return s[: len(draws)], e[: len(draws)]


def _summed(draws: int, packs: int, seed: int):
    """Segments sorted by (key, block, part) to the sums of the part's draws (those of `packs` packs) over the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, y = None, None, None

        def result() -> pa.RecordBatch:
            key, block, part, lead, size = now
            of = range(part * packs * NUMBERS, min(draws, (part + 1) * packs * NUMBERS))
            sums = _sums_of(x, y, block * HELD, size, lead, of, seed)
            columns = [c for v in sums for c in v.T]
            return pa.RecordBatch.from_arrays([pa.array([key] * len(of)), pa.array(np.arange(of.start, of.stop)), *map(pa.array, columns)], ["key", "_draw", *_PAIR_SUMS])

        for b in batches:
            for i in range(b.num_rows):
                here = tuple(b.column(c)[i].as_py() for c in ("key", "block", "part", "lead", "size"))
                if here != now:
                    if now is not None:
                        yield result()
                    now, held = here, min(HELD, here[4] - here[1] * HELD)
                    x, y = np.empty(held), np.empty(held)
                at = np.frombuffer(b.column("at")[i].as_buffer(), "<u4")
                x[at], y[at] = (np.frombuffer(b.column(c)[i].as_buffer(), "<f8") for c in ("x", "y"))
        if now is not None:
            yield result()

    return run


_PAIR_SUMS = [*(f"s{i}" for i in range(6)), *(f"e{i}" for i in range(4))]


def _drawn(rows: DataFrame, x: str, y: str, draws: int, seed: int, lead: Column) -> DataFrame:
    """key, _draw, r of each draw of numbered rows (_of: their key; _i, _n); slot i of a key is named lead, i.

    A task has a range of draws of a key and up to HELD of its places, whatever the key's size; of a key of more places, each
    block of them makes the key's picks anew."""
    spark = rows.sparkSession
    means = cut(rows.groupBy(F.col("_of").alias("_key")).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.count(F.lit(1)).alias("_rows")))
    blocks, n = means.agg(F.sum(F.ceil(F.col("_rows") / HELD)), F.sum("_rows")).first()
    every = -(-draws // NUMBERS)
    packs = max(1, every // max(1, math.ceil(TASKS * spark.sparkContext.defaultParallelism / (blocks or 1))))
    parts = -(-every // packs)
    # less the means, so that squares lose nothing
    pairs = rows.join(sized_broadcast(means, 64), F.col("_of") == F.col("_key")).select(F.col("_of").alias("key"), lead.alias("lead"), F.col("_n").alias("size"), F.col("_i").alias("place"), (F.col(x) - F.col("_x")).alias("x"), (F.col(y) - F.col("_y")).alias("y"))
    segments = pairs.mapInArrow(_packed, "key string, lead string, size long, block long, at binary, x binary, y binary")
    segments = segments.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # shares are few and large: most of these have one or none
    tasks = min((blocks or 1) * parts * 8, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n or 0) * parts * 20 // PART_BYTES)))
    dealt = segments.repartition(tasks, "key", "block", "part").sortWithinPartitions("key", "block", "part")
    drawn = dealt.mapInArrow(_summed(draws, packs, seed), "key string, _draw long, " + ", ".join(f"{c} double" for c in _PAIR_SUMS))
    drawn = drawn.groupBy("key", "_draw").agg(*[(F.sum if c[0] == "s" else F.min)(c).alias(c) for c in _PAIR_SUMS])
    return drawn.select("key", "_draw", _r().alias("r"))


def bootstrap_r(df: DataFrame, x: str, y: str, order: str, groups: Sequence[str] = (), draws: int = BOOT, seed: int = 0) -> DataFrame:
    """groups, n, r, p, lo, hi: Pearson r with the 2.5 and 97.5 percentiles of its draws.

    `order` names the rows of a group (no two the same). Draws without an r do not count."""
    full = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, order, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    rows = numbered(full, [order], *groups).withColumn("_of", _key(*groups))
    real = rows.groupBy(*groups, "_of").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, safe_corr(x, y)).alias("r"))
    ends = _drawn(rows, x, y, draws, seed, F.lit("")).groupBy("key").agg(*interval("r"))
    return real.join(ends, F.col("_of") == F.col("key"), "left").select(*groups, "n", "r", pearson_p_udf(F.col("r"), F.col("n").cast("double")).alias("p"), "lo", "hi")


def bootstrap_difference(df: DataFrame, x: str, y: str, order: str, side: str, first: object, second: object, draws: int = BOOT_DIFF, seed: int = 0) -> DataFrame:
    """difference, lo, hi of r on the rows of side `first` less r on those of `second`, each drawn on its own."""
    full = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(side).isin(first, second)).select(side, order, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    rows = numbered(full, [order], side).withColumn("_of", F.when(F.col(side) == F.lit(first), "first").otherwise("second"))
    part = lambda s: F.max(F.when(F.col("key") == s, F.col("r")))
    real = rows.groupBy(F.col("_of").alias("key")).agg(F.when(F.count(F.lit(1)) >= 3, safe_corr(x, y)).alias("r")).agg((part("first") - part("second")).alias("difference"))
    # slots of the sides are told apart, so that their picks are independent
    drawn = _drawn(rows, x, y, draws, seed, F.concat(F.col(side).cast("string"), F.lit(":")))
    gaps = drawn.groupBy("_draw").agg((part("first") - part("second")).alias("_d"))
    return real.crossJoin(F.broadcast(gaps.agg(*interval("_d"))))  # one row each


def bootstrap_lines(df: DataFrame, line: str, repeat: str, truth: str, pred: str, draws: int = BOOT_LINES, seed: int = 0) -> DataFrame:
    """r_mean, lo, hi of the mean r over repeats, lines drawn once for all repeats."""
    full = cut(df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(line, F.col(repeat).cast("string").alias("layer"), F.col(truth).cast("double").alias("_t"), F.col(pred).cast("double").alias("_p")))
    lines = numbered(full.select(line).distinct(), [line])
    means = full.agg(F.avg("_t").alias("_mt"), F.avg("_p").alias("_mp"))
    s, e = _pairs(F.col("_t") - F.col("_mt"), F.col("_p") - F.col("_mp"))
    each = full.crossJoin(F.broadcast(means)).select(line, "layer", s.alias("s"), e.alias("e"))  # one row of means
    per = each.groupBy(line, "layer").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(6)]).alias("s"), F.array(*[F.min(F.col("e")[i]) for i in range(4)]).alias("e"))
    places = per.join(lines.select(line, F.col("_i").alias("place")), line).select(F.lit("{}").alias("key"), "place", "layer", "s", "e")
    slots = lines.select(F.lit("{}").alias("key"), F.col("_i").cast("string").alias("slot"), F.col("_n").alias("size"))
    drawn = drawn_sums(slots, places, draws, seed, 6, 4).withColumn("r", _r()).groupBy("_draw").agg(F.avg("r").alias("_m"))
    real = full.groupBy("layer").agg(F.when(F.count(F.lit(1)) >= 3, safe_corr("_t", "_p")).alias("r")).agg(F.avg("r").alias("r_mean"))
    return real.crossJoin(F.broadcast(drawn.agg(*interval("_m"))))


def matched_permutation(values: DataFrame, sets: DataFrame, gene: str, value: str, stratum: str, draws: int = MATCHED, seed: int = 0, least: int = 5) -> DataFrame:
    """set, n, n_missing, obs, null_mean, null_sd, z, p: the mean of a set's genes against means of genes drawn, with
    replacement, each from its own stratum of the genes outside the set (from all of them if that has none);
    one-sided, (# + 1) / (draws + 1), means that are equal up to rounding counted. Sets of fewer than `least` genes with a value, or that leave none outside, are left out.

    values: one row a gene; sets: set, gene. The pool of a set is numbered by stratum, in order of genes."""
    members = sets.select("set", gene).distinct()
    known = values.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(gene, F.col(value).cast("double").alias("_v"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_s"))
    own = members.join(known, gene).select("set", gene, "_v", "_s")
    size = members.join(values.select(gene).distinct(), gene, "left_semi").groupBy("set").agg(F.count(F.lit(1)).alias("_all"))
    obs = own.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("obs")).filter(F.col("n") >= least)
    # every set with every gene outside it: sets are a bounded list, and this is the pools themselves
    names = obs.select("set")
    pool = known.select(F.explode(F.array(*[F.lit(r["set"]) for r in names.collect()])).alias("set"), gene, "_v", "_s") if names.limit(1).count() else known.select(F.lit("").alias("set"), gene, "_v", "_s").limit(0)
    pool = cut(pool.join(members, ["set", gene], "left_anti"))
    strata = numbered(pool, [gene], "set", "_s").select("set", "_s", F.col("_i").alias("_pick"), F.col("_n").alias("_size"), "_v")
    whole = numbered(pool, [gene], "set").select("set", F.lit(None).cast("string").alias("_s"), F.col("_i").alias("_pick"), F.col("_n").alias("_size"), "_v")
    both = cut(strata.unionByName(whole))
    sizes = both.groupBy("set", "_s").agg(F.max("_size").alias("_size"))
    here = sizes.filter("_s IS NOT NULL")
    all_ = sizes.filter("_s IS NULL").select("set", F.col("_size").alias("_whole"))
    slots = own.join(obs.select("set"), "set", "left_semi").join(here, ["set", "_s"], "left").join(all_, "set")
    key = lambda s: F.to_json(F.struct("set", s.alias("s")))
    slots = slots.select(key(F.when(F.col("_size").isNotNull(), F.col("_s"))).alias("key"), F.col(gene).cast("string").alias("slot"), F.coalesce("_size", "_whole").alias("size"))
    places = both.select(key(F.col("_s")).alias("key"), F.col("_pick").alias("place"), F.lit("").alias("layer"), F.array(F.lit(1.0), "_v").alias("s"), F.array().cast("array<double>").alias("e"))
    drawn = drawn_sums(cut(slots), places, draws, seed, 2, 0)
    of = both.select("set", "_s").distinct().withColumn("key", key(F.col("_s"))).drop("_s")
    means = drawn.join(sized_broadcast(of, 64), "key").groupBy("set", "_draw").agg((F.sum("s1") / F.sum("s0")).alias("_m"))
    null = means.join(obs.select("set", "obs"), "set").groupBy("set").agg(F.avg("_m").alias("null_mean"), F.stddev_pop("_m").alias("null_sd"), F.sum((F.col("_m") >= F.col("obs") - 1e-9 * F.abs("obs")).cast("long")).alias("_hits"), F.count(F.lit(1)).alias("_draws"))
    out = obs.join(size, "set").join(null, "set")
    z = F.try_divide(F.col("obs") - F.col("null_mean"), F.nullif("null_sd", F.lit(0.0)))
    return out.select("set", "n", (F.col("_all") - F.col("n")).alias("n_missing"), "obs", "null_mean", "null_sd", z.alias("z"), ((F.col("_hits") + 1) / (F.col("_draws") + 1)).alias("p"))


def random_sets(genes: DataFrame, gene: str, sizes: Sequence[int], draws: int, seed: int) -> DataFrame:
    """draw (from 1), side (0, 1, ...), gene: disjoint random sets of the sizes, the genes of the least checksums of a draw."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col(gene).cast("string")).cast("binary"))
    every = genes.select(gene).distinct().select(gene, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    ranked = every.withColumn("_r", F.row_number().over(W.partitionBy("draw").orderBy(key, gene))).filter(F.col("_r") <= sum(sizes))
    side = F.lit(len(sizes) - 1)
    for i in reversed(range(len(sizes) - 1)):
        side = F.when(F.col("_r") <= sum(sizes[: i + 1]), i).otherwise(side)
    return ranked.select("draw", side.alias("side"), gene)


class _SetScores:
    """Scores of all draws' sets, up less down, of the samples in a block: products of ranks and memberships, a block of sets at a time."""

    def __init__(self, picks: pd.DataFrame, width: int, count: int, sides: int) -> None:
        order = np.argsort(picks["set"].to_numpy(), kind="stable")
        self.set, self.place = picks["set"].to_numpy(np.int32)[order], picks["place"].to_numpy(np.int32)[order]
        self.width, self.count, self.sides = width, count, sides

    def __call__(self, pdf: pd.DataFrame) -> np.ndarray:
        """samples x draws; NaN where a set has no score. pdf: places (of named genes) and their ranks, and n, mean, variance of all ranks."""
        rows, sets = len(pdf), self.count * self.sides
        cell = np.repeat(np.arange(rows) * self.width, [len(v) for v in pdf["places"]]) + np.concatenate([*pdf["places"], np.empty(0, np.int64)]).astype(np.int64)
        v = np.concatenate([*pdf["ranks"], np.empty(0)]).astype(float)
        known, shape = np.isfinite(v), (rows, self.width)
        add = lambda w: np.bincount(cell, w, rows * self.width).reshape(shape)
        x, has = add(np.where(known, v, 0.0)), add(np.ones(len(v)))
        seen = has if known.all() else add(known.astype(float))
        n, mean, var = (pdf[c].to_numpy(float)[:, None] for c in ("n", "mean", "var"))
        out, step = np.empty((rows, sets)), max(1, regression.BLOCK // self.width)
        for lo in range(0, sets, step):
            hi = min(lo + step, sets)
            a, z = np.searchsorted(self.set, [lo, hi])
            member = np.zeros((self.width, hi - lo))
            member[self.place[a:z], self.set[a:z] - lo] = 1
            k = member.sum(axis=0)[None, :] if (has == 1).all() else has @ member
            some = k if seen is has else seen @ member
            with np.errstate(all="ignore"):
                out[:, lo:hi] = (x @ member / some - mean) / np.sqrt(var / k * ((n - k) / (n - 1)))
        out[~np.isfinite(out)] = np.nan
        out = out.reshape(rows, self.count, self.sides)
        return out[:, :, 0] - out[:, :, 1] if self.sides == 2 else out[:, :, 0]


def random_set_null(ranks: DataFrame, lines: DataFrame, y: str, sets: Sequence[Sequence], controls: Sequence[str] = (), categories: Sequence[str] = (), sample: str = "sample", gene: str = "feature", rank: str = "p", draws: int = NULL_DRAWS, seed: int = 0) -> DataFrame:
    """z, p_random, n_valid: the Wald z of a set's score in a logistic model, or of [up, down] sets' scores, up
    less down, and its two-sided p against random sets of the same sizes, (1 + #) / (1 + fits).

    ranks: sample, gene, rank. A sample is one row, of the ranks of the genes that any set names; the scores of all draws
    are products of these and the sets' memberships (a bounded list, counted), made anew in each pass, so that
    no row of a sample and a draw exists. All models are fitted together; draws whose model has no estimate do not count."""
    if len(sets) not in (1, 2):
        raise ValueError("one set, or [up, down]")
    spark = ranks.sparkSession
    kind = ranks.schema[gene].dataType.simpleString()
    observed = spark.createDataFrame([(0, i, g) for i, s in enumerate(sets) for g in s], f"draw int, side int, `{gene}` {kind}")
    of = random_sets(ranks, gene, [len(set(s)) for s in sets], draws, seed)
    named = cut(observed.unionByName(of).distinct())
    genes = cut(numbered(named.select(gene).distinct(), [gene]).select(F.col(gene).alias("_gene"), F.col("_i").cast("int").alias("_place")))
    width, sides = genes.count(), len(sets)
    places = sized_broadcast(genes, 64)
    own = named.join(places, F.col(gene) == F.col("_gene")).select((F.col("draw") * sides + F.col("side")).alias("set"), F.col("_place").alias("place"))
    derive = _SetScores(to_local(own, "genes of random sets"), max(width, 1), draws + 1, sides)
    hit = F.when(F.col("_place").isNotNull(), F.struct("_place", F.coalesce(F.col(rank).cast("double"), F.lit(float("nan"))).alias("v")))
    held = ranks.select(sample, gene, rank).join(places, F.col(gene) == F.col("_gene"), "left")
    held = held.groupBy(sample).agg(F.collect_list(hit).alias("_hits"), F.count(F.lit(1)).alias("n"), F.avg(rank).alias("mean"), F.var_samp(rank).alias("var"))
    held = held.select(sample, F.col("_hits._place").alias("places"), F.col("_hits.v").alias("ranks"), "n", "mean", "var")
    fits = regression.logistic_derived(held, derive, draws + 1, lines, y, controls, categories, sample, "_draw")
    real = fits.filter("_draw = 0").select(F.col("z").alias("_real"))
    hits = F.sum((F.abs("z") >= F.abs("_real")).cast("long"))
    n = F.count("z")
    return fits.filter("_draw > 0 AND z IS NOT NULL").crossJoin(F.broadcast(real)).groupBy(F.col("_real").alias("z")).agg(((hits + 1) / (n + 1)).alias("p_random"), n.alias("n_valid"))
