"""Ranks and bins over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .local import cut, sized_broadcast
from .nulls import col, safe_corr


def average_rank(value: str, *groups: str) -> Column:
    """1-based rank within the groups, ties at their mean; NULL stays NULL."""
    w = W.partitionBy(*groups, F.col(value).isNull())
    ties = W.partitionBy(*groups, F.col(value).isNull(), F.col(value))
    r = F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return F.when(F.col(value).isNotNull(), r)


def in_ranges(counts: DataFrame, value: str, n: str, below: str, ranges: int = 64) -> DataFrame:
    """counts (one row a value, with its weight n) with `below`: the weight of all smaller values.

    Values are ordered within ranges, each a task of its own; what comes to the driver are the
    borders of the ranges and their sums."""
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    borders = sorted(set(counts.agg(F.percentile_approx(value, steps, F.lit(1000)).alias("e")).first().e or []))
    cuts = F.array(*[F.lit(float(b)) for b in borders]) if borders else F.array().cast("array<double>")
    ranged = counts.withColumn("_range", F.size(F.filter(cuts, lambda e: e < F.col(value).cast("double"))))
    sums = {r["_range"]: r["s"] for r in ranged.groupBy("_range").agg(F.sum(n).alias("s")).collect()}
    starts, total = [], 0
    for i in range(len(borders) + 1):
        starts.append(total)
        total += sums.get(i, 0)
    before = F.sum(n).over(W.partitionBy("_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    return ranged.withColumn(below, F.element_at(F.array(*[F.lit(int(s)).cast("long") for s in starts]), F.col("_range") + 1) + F.coalesce(before, F.lit(0))).drop("_range")


def weights_below(counts: DataFrame, value: str, n: str, *groups: str) -> DataFrame:
    """counts (one row a group and value, with its weight n) with _task (rises with value in a group), _below: the weight of the
    group's smaller values, and _total: that of all.

    Values are dealt in ranges, so a group of any number of them is spread over tasks; what a group holds in each task is a row."""
    rows = cut(counts.repartitionByRange(*groups, value).withColumn("_task", F.spark_partition_id()))
    w = W.partitionBy(*groups)
    held = rows.groupBy(*groups, "_task").agg(F.sum(n).alias("_held"))
    earlier = F.coalesce(F.sum("_held").over(w.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_task").alias("_t"), earlier.alias("_earlier"), F.sum("_held").over(w).alias("_total"))
    before = F.sum(n).over(W.partitionBy(*groups, "_task").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    same = F.col("_task") == F.col("_t")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = rows.withColumn("_before", F.coalesce(before, F.lit(0))).join(sized_broadcast(held, 64), same)
    return out.withColumn("_below", F.col("_before") + F.col("_earlier")).drop("_before", "_earlier", "_t", *[f"_g{i}" for i in range(len(groups))])


def by_value(df: DataFrame, found: DataFrame, value: str, *groups: str) -> DataFrame:
    """df, left-joined with what was found for its groups and values (groups, value, more)."""
    named = found.select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(groups)], F.col(value).alias("_value"), *[c for c in found.columns if c not in (*groups, value)])
    same = F.col(value) == F.col("_value")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_h{i}"))
    return df.join(sized_broadcast(named, 48), same, "left").drop("_value", *[f"_h{i}" for i in range(len(groups))])


def with_group_rank(df: DataFrame, value: str, name: str, *groups: str) -> DataFrame:
    """df with average_rank(value, *groups), for groups of any size: equal values are counted first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = weights_below(counts, value, "_n", *groups).select(*groups, value, (F.col("_below") + (F.col("_n") + 1) / F.lit(2.0)).alias(name))
    return by_value(df, cut(ranked), value, *groups)


def with_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the 1-based rank of value in the whole table, ties at their mean; NULL stays NULL.

    Equal values are counted first, so no task orders more than a range of distinct ones."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = in_ranges(counts, "_value", "_n", "_below").select("_value", (F.col("_below") + (F.col("_n") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranked, F.col(value) == F.col("_value"), "left").drop("_value")


def percentile_rank(value: str, *groups: str) -> Column:
    """Average rank over the number of values in the group: in (0, 1]."""
    return average_rank(value, *groups) / F.count(F.col(value)).over(W.partitionBy(*groups))


def ordinal_bin(order: list[Column], bins: int, *groups: str) -> Column:
    """Quantile bin (0-based) of the row number in the given order, with right-closed
    edges at equal steps of (n - 1); this is not ntile."""
    w = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    rn = F.row_number().over(w.orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(w)
    b = F.ceil(F.try_divide(rn * F.lit(float(bins)), (n - 1).cast("double"))) - 1
    return F.greatest(F.coalesce(b, F.lit(0)), F.lit(0)).cast("int")


def bin_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Exact quantile edges of the values, equal ones merged."""
    steps = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = df.agg(F.percentile(F.col(value).cast("double"), steps).alias("e")).first().e
    return sorted(set(edges or []))


def value_bin(value: str | Column, edges: list[float]) -> Column:
    """Bin (0-based) by edges, right-closed, the lowest edge included; NULL outside."""
    v = col(value)
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        low = v >= edges[0] if i == 0 else v > edges[i]
        out = F.when(low & (v <= edges[i + 1]), i).otherwise(out)
    return out


def spearman(df: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """groups, n, rho over rows with both values."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if groups:
        ranked = both.select(*groups, average_rank(x, *groups).alias("_rx"), average_rank(y, *groups).alias("_ry"))
    else:
        ranked = with_rank(with_rank(both.select(x, y), x, "_rx"), y, "_ry")
    return ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), safe_corr("_rx", "_ry").alias("rho"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def numbered(df: DataFrame, order: list[Column | str], *groups: str, name: str = "_i", total: str = "_n") -> DataFrame:
    """df with the 0-based place of each row in its group, in the given order, and the group's rows.

    Rows are range-sorted, and numbered from what the tasks before hold of the group: a group of any
    size is spread over tasks. The order must tell rows apart for the same places each time."""
    keys = [*[F.col(g) for g in groups], *[F.col(c) if isinstance(c, str) else c for c in order]]
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_task", F.shiftrightunsigned("_at", 33))
    w = W.partitionBy(*groups)
    held = rows.groupBy(*groups, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))  # a row a group and task
    before = F.coalesce(F.sum("_c").over(w.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_task").alias("_t"), (before - F.col("_first")).alias("_shift"), F.sum("_c").over(w).alias(total))
    same = F.col("_task") == F.col("_t")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(sized_broadcast(held, 64), same).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_task", "_t", "_shift", *[f"_g{i}" for i in range(len(groups))])
