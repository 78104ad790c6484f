"""Positions, intervals and probe arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.local import cut, sized_broadcast
from ..functions.nulls import is_true


def nearest_point(peaks: DataFrame, points: DataFrame, chrom: str, pos: str, name: str, keys: list[str]) -> DataFrame:
    """keys, chrom, pos of the peaks with `name` and `distance` of the nearest point on the
    chromosome; equally near: the lower position; several names at a position: the
    first; no point on the chromosome: NULL.

    Both tables are merged and dealt in stretches of about as many rows each; the last point before
    and the first after each peak come from two running windows, up and down (a window that looks ahead
    to the end reads the rest of the stretch anew for every row), so no pair is ever
    formed, and the last and first points of the stretches beside (one row each) are carried
    over their borders."""
    p = points.filter(F.col(pos).isNotNull()).groupBy(chrom, pos).agg(F.min(name).alias("_name"))
    p = p.select(F.col(chrom).alias("_c"), F.col(pos).cast("long").alias("_x"), F.struct(F.col(pos).cast("long").alias("x"), F.col("_name").alias("name")).alias("_pt"), *[F.lit(None).cast(peaks.schema[k].dataType).alias(k) for k in keys])
    q = peaks.select(F.col(chrom).alias("_c"), F.col(pos).cast("long").alias("_x"), F.lit(None).cast(p.schema["_pt"].dataType).alias("_pt"), *keys)
    both = q.withColumn("_q", F.lit(True)).unionByName(p.withColumn("_q", F.lit(False)))
    both = cut(both.repartitionByRange("_c", "_x").withColumn("_b", F.spark_partition_id()))
    ends = both.groupBy(F.col("_c").alias("_ec"), F.col("_b").alias("_eb")).agg(F.max("_pt").alias("_last"), F.min("_pt").alias("_first"))
    beside = W.partitionBy("_ec").orderBy("_eb")
    ends = ends.select("_ec", "_eb", F.last("_last", True).over(beside.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(beside.rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    w = W.partitionBy("_c", "_b")
    upto = lambda order: F.last("_pt", True).over(w.orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow))
    both = both.withColumn("_lo", upto(F.asc("_x"))).withColumn("_hi", upto(F.desc("_x")))
    both = both.filter("_q").join(ends, F.col("_c").eqNullSafe(F.col("_ec")) & F.col("_b").eqNullSafe(F.col("_eb")))
    both = both.withColumn("_lo", F.coalesce("_lo", "_before")).withColumn("_hi", F.coalesce("_hi", "_after"))
    lo, hi = F.col("_x") - F.col("_lo.x"), F.col("_hi.x") - F.col("_x")
    up = F.col("_lo").isNull() | is_true(hi < lo)
    best = F.when(up, F.col("_hi")).otherwise(F.col("_lo"))
    return both.select(*keys, F.col("_c").alias(chrom), F.col("_x").alias(pos), best["name"].alias(name), F.when(up, hi).otherwise(lo).alias("distance"))


#: Widths of bins for intervals: each is STEP times the one before.
STEP, LEVELS = 8, 8
#: Pairs that a bin forms at most for each of its rows (others are swept), and rows of a side in a sweep.
PAIRS, SWEPT = 64, 200_000


def _dominating(px: np.ndarray, py: np.ndarray, value: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """The greatest value (0, 1, ...) of the points with px <= qx and py >= qy, for each query; -1 if there is none.

    The points before qx are runs of 1, 2, 4, ... points, one for each binary digit of their number; each run is
    ordered by py, with its greatest value from there on."""
    n, by = len(px), np.argsort(px, kind="stable")
    upto, best = np.searchsorted(px[by], qx, side="right"), np.full(len(qx), -1)
    levels = np.unique(np.concatenate([py, qy]))
    y, q, v, wide = np.searchsorted(levels, py[by]), np.searchsorted(levels, qy), value[by], len(levels) + 1
    for digit in range(n.bit_length()):
        ask = np.flatnonzero((upto >> digit) & 1)
        if not len(ask):
            continue
        run = np.arange(n) >> digit
        key = run * wide + y
        order = np.argsort(key, kind="stable")
        # from the last down, each run's values above those of the runs after it
        most = np.maximum.accumulate((v[order] + (run[-1] - run) * n)[::-1])[::-1]
        own = (upto[ask] >> digit) - 1
        at = np.searchsorted(key[order], own * wide + q[ask])
        here = np.minimum(at, n - 1)
        found = (at < n) & (run[here] == own)
        best[ask[found]] = np.maximum(best[ask[found]], most[here[found]] - (run[-1] - own[found]) * n)
    return best


def _swept(table: pa.Table) -> pa.Table:
    """Rows of one bin (right ones have _right) to key, name, overlap: the best of each left interval here. The best overlap
    is one of those that hold it, lie in it, or reach over its start or its end."""
    right = table.column("_right").combine_chunks()
    a, b = table.filter(pc.invert(right)), table.filter(right)
    s, e, r, f = (t.column(c).to_numpy() for t in (a, b) for c in ("_s", "_e"))
    name = b.column("_name").combine_chunks()
    first = pc.rank(name, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    which, most, rank = np.full(len(s), -1), np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    zero = np.zeros(len(r), np.int64)
    for px, qx, py, qy, measure in ((r, s, f, e, zero), (-r, -s, -f, -e, f - r), (r, s, -f, -e, f), (-r, -s, f, e, -r)):
        order = np.lexsort((-first, measure))
        value = np.empty(len(r), np.int64)
        value[order] = np.arange(len(r))
        got = _dominating(px, py, value, qx, qy)
        i = order[np.maximum(got, 0)]
        n = np.minimum(e, f[i]) - np.maximum(s, r[i])
        better = (got >= 0) & (n > 0) & ((n > most) | ((n == most) & (first[i] < rank)))
        which[better], most[better], rank[better] = i[better], n[better], first[i][better]
    has = which >= 0
    return pa.table({"key": a.column("_key").filter(pa.array(has)), "name": name.take(pa.array(which[has])), "overlap": most[has]})


def best_overlap(left: DataFrame, right: DataFrame, key: str, name: str, chrom: str = "chrom", start: str = "start", end: str = "end", width: int = 16_384) -> DataFrame:
    """key, name, overlap: of the right intervals that overlap a left one ([start, end), empty
    ones none), the one with the longest overlap, then by name.

    Bins have several widths, `width` and STEP times the one before. An interval stands in the bins of its own
    width, the least it fits in, and of those greater widths that intervals of the other side have for their own: two
    bins each at most, whatever its length. A pair meets at the greater of its two widths, in the first bin both touch.

    Bins are counted. Where many intervals lie over each other, no pairs are formed: the bin (in parts of SWEPT rows of a side, if
    it has more) is one group, swept in n log^2 n steps."""
    widths = [width * STEP**i for i in range(LEVELS)]

    def levelled(df: DataFrame, what: str) -> DataFrame:
        full = df.filter(F.col(end) > F.col(start)).select(F.col(what), F.col(chrom).alias("_c"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
        level = F.lit(LEVELS - 1)
        for i in reversed(range(LEVELS - 1)):
            level = F.when(F.col("_e") - F.col("_s") <= widths[i], i).otherwise(level)
        return full.withColumn("_own", level)

    def binned(df: DataFrame, others: set[int]) -> DataFrame:
        place = [F.when((F.col("_own") == i) | ((F.col("_own") < i) & F.lit(i in others)), F.struct(F.lit(i).alias("l"), F.sequence(F.floor(F.col("_s") / w), F.floor((F.col("_e") - 1) / w)).alias("b"))) for i, w in enumerate(widths)]
        rows = df.withColumn("_p", F.explode(F.array_compact(F.array(*place))))
        return rows.select(*[c for c in df.columns], F.col("_p.l").alias("_l"), F.explode("_p.b").alias("_b"))

    sides = levelled(left, key), levelled(right, name)
    of = [{r["_own"] for r in side.select("_own").distinct().collect()} for side in sides]  # LEVELS numbers at most
    a, b = cut(binned(sides[0], of[1]).filter("_c IS NOT NULL")), cut(binned(sides[1], of[0]).filter("_c IS NOT NULL"))
    at = ["_c", "_l", "_b"]
    count = a.select(*at, F.lit(1).alias("_m"), F.lit(0).alias("_n")).unionByName(b.select(*at, F.lit(0).alias("_m"), F.lit(1).alias("_n"))).groupBy(*at).agg(F.sum("_m").alias("_m"), F.sum("_n").alias("_n"))
    full = count.filter(F.col("_m") * F.col("_n") > PAIRS * (F.col("_m") + F.col("_n")))
    full = sized_broadcast(cut(full.select(*at, F.ceil(F.col("_m") / SWEPT).cast("int").alias("_m"), F.ceil(F.col("_n") / SWEPT).cast("int").alias("_n"))), 48)
    types = [df.schema[c].dataType.simpleString() for df, c in ((a, key), (b, name))]

    def parts(df: DataFrame, own: str, other: str, col: str, k: Column, v: Column) -> DataFrame:
        every = F.sequence(F.lit(0), F.col(other) - 1)
        rows = df.join(full, at).withColumn(own, F.pmod(F.xxhash64(F.col(col), "_s", "_e"), F.col(own)).cast("int")).withColumn(other, F.explode(every))
        return rows.select(*at, "_m", "_n", "_s", "_e", k.alias("_key"), v.alias("_name"), F.lit(own == "_n").alias("_right"))

    swept = parts(a, "_m", "_n", key, F.col(key), F.lit(None).cast(types[1])).unionByName(parts(b, "_n", "_m", name, F.lit(None).cast(types[0]), F.col(name)))
    swept = swept.groupBy(*at, "_m", "_n").applyInArrow(_swept, f"key {types[0]}, name {types[1]}, overlap long").select(F.col("key").alias(key), F.col("name").alias(name), "overlap")
    a, b = a.join(full, at, "left_anti").alias("a"), b.join(full, at, "left_anti").alias("b")
    met = a.join(b, (F.col("a._c") == F.col("b._c")) & (F.col("a._l") == F.col("b._l")) & (F.col("a._b") == F.col("b._b")) & (F.col("a._s") < F.col("b._e")) & (F.col("b._s") < F.col("a._e")))
    first = F.floor(F.greatest("a._s", "b._s") / F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("a._l") + 1))
    met = met.filter((F.col("a._l") == F.greatest("a._own", "b._own")) & (F.col("a._b") == first))
    n = F.least("a._e", "b._e") - F.greatest("a._s", "b._s")
    met = met.select(F.col(f"a.{key}").alias(key), F.col(f"b.{name}").alias(name), n.alias("overlap"))
    return met.unionByName(swept).groupBy(key).agg(F.min_by(F.struct(name, "overlap"), F.struct((-F.col("overlap")).alias("o"), F.col(name).alias("n"))).alias("_b")).select(key, f"_b.{name}", "_b.overlap")


def explode_lists(df: DataFrame, keys: list[str], first: str, second: str, sep: str = ";", distinct: bool = False) -> DataFrame:
    """keys, first, second: two parallel lists in text, zipped and exploded; pairs without a
    first go. Lists of different lengths raise."""
    a, b = F.split(first, sep), F.split(second, sep)
    same = F.assert_true(F.coalesce(F.size(a) == F.size(b), F.lit(True)), F.lit(f"{first} and {second} differ in length"))
    rows = df.withColumn("_ok", same).filter(F.col("_ok").isNull()).select(*keys, F.explode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("_z"))
    out = rows.select(*keys, F.col("_z.a").alias(first), F.col("_z.b").alias(second)).filter(F.col(first) != "")
    return out.distinct() if distinct else out


def mask_detection(beta: str, p: str, above: float = 0.01) -> Column:
    """The beta value, NULL where its detection p is at or above the limit (an unknown p is not)."""
    return F.when(is_true(F.col(p) >= above), F.lit(None)).otherwise(F.col(beta))


def m_value(beta: str, low: float = 1e-4) -> Column:
    b = F.greatest(F.least(F.col(beta).cast("double"), F.lit(1 - low)), F.lit(low))
    return F.when(F.col(beta).isNotNull(), F.log2(b / (1 - b)))


def keep_probes(probes: DataFrame, probe: str, cross_reactive: DataFrame, snp: DataFrame, chrom: str) -> tuple[DataFrame, DataFrame]:
    """(probes less cross-reactive ones, ones with a SNP and those on X or Y; filter, n of each)."""
    marked = probes
    for name, bad in (("cross_reactive", cross_reactive), ("snp", snp)):
        marked = marked.join(bad.select(F.col(probe).alias(f"_{name}")).distinct(), F.col(probe) == F.col(f"_{name}"), "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")
    marked = marked.withColumn("sex", is_true(F.col(chrom).isin("chrX", "chrY", "X", "Y")))
    bad = F.col("cross_reactive") | F.col("snp") | F.col("sex")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    n = marked.agg(F.count(F.lit(1)).alias("all"), *[count(F.col(c)).alias(c) for c in ("cross_reactive", "snp", "sex")], count(~bad).alias("kept"))
    names = ["all", "cross_reactive", "snp", "sex", "kept"]
    return marked.filter(~bad).drop("cross_reactive", "snp", "sex"), n.select(F.inline(F.array(*[F.struct(F.lit(x).alias("filter"), F.col(f"`{x}`").alias("n")) for x in names])))


def gene_means(long: DataFrame, pairs: DataFrame, probe: str, gene: str, sample: str, value: str, propagate: bool = False) -> DataFrame:
    """gene, sample, mean over the gene's probes; missing values are skipped, or (propagate) make
    the mean missing. A probe listed twice for a gene counts once."""
    hit = long.join(pairs.select(probe, gene).distinct(), probe)
    mean = F.avg(value)
    if propagate:
        mean = F.when(F.count(value) == F.count(F.lit(1)), mean)
    return hit.groupBy(gene, sample).agg(mean.alias(value))


def midpoint(start: str, end: str) -> Column:
    return F.floor((F.col(start) + F.col(end)) / 2)


def linked_gene(links: DataFrame, peak: str, gene: str, ordinal: str) -> DataFrame:
    """peak, gene: of a repeated peak, the last listed."""
    return links.groupBy(peak).agg(F.max_by(gene, ordinal).alias(gene))


def coverage(sets: DataFrame, pairs: DataFrame, gene: str, region: str, enhancer: str, regions: list[str]) -> DataFrame:
    """set, n_genes, genes with any probe and with an enhancer probe (n, %), pairs by region."""
    genes = sets.select("set", gene).distinct()
    per = pairs.groupBy(gene).agg(F.count(F.lit(1)).alias("_p"), F.sum(F.when(F.col(enhancer), 1).otherwise(0)).alias("_e"), *[F.sum(F.when(F.col(region) == r, 1).otherwise(0)).alias(f"_r{i}") for i, r in enumerate(regions)])
    g = genes.join(per, gene, "left").groupBy("set").agg(
        F.count(F.lit(1)).alias("n_genes"), F.count("_p").alias("n_genes_any_probe"), F.coalesce(F.sum("_p"), F.lit(0)).alias("n_probe_gene_pairs"),
        F.coalesce(F.sum("_e"), F.lit(0)).alias("n_enhancer_probe_gene_pairs"), F.sum(F.when(F.col("_e") > 0, 1).otherwise(0)).alias("n_genes_with_enhancer_probe"),
        *[F.coalesce(F.sum(f"_r{i}"), F.lit(0)).alias(f"region_{r}") for i, r in enumerate(regions)],
    )
    pct = lambda c: (100 * F.col(c) / F.col("n_genes")).alias(f"pct_{c[2:]}")
    return g.select("*", pct("n_genes_any_probe"), pct("n_genes_with_enhancer_probe"))
