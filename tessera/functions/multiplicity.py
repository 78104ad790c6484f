"""Benjamini-Hochberg q-values: as a window of small families, or of families of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .local import cut, sized_broadcast
from .ranks import by_value, weights_below


def bh_q(p: str, *family: str) -> Column:
    """Step-up q of each p within its family; a missing p has none and does not count."""
    keys = [*family, F.col(p).isNull()]
    w = W.partitionBy(*keys)
    m = F.count(F.col(p)).over(w)
    # rank with ties at their last place: equal p get one q
    place = F.count(F.lit(1)).over(w.orderBy(p).rangeBetween(W.unboundedPreceding, W.currentRow))
    raw = F.col(p) * m / place
    q = F.min(raw).over(w.orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, W.currentRow))
    return F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), q))


def with_bh_q(df: DataFrame, p: str, name: str, *family: str) -> DataFrame:
    """df with bh_q(p, *family), for families of any size: equal p are counted first, and the rest is done in ranges of p."""
    counts = df.filter(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count(F.lit(1)).alias("_n"))
    raw = cut(weights_below(counts, p, "_n", *family).withColumn("_raw", F.col(p) * F.col("_total") / (F.col("_below") + F.col("_n"))))
    later = raw.groupBy(*family, "_task").agg(F.min("_raw").alias("_least"))  # a row a family and task
    least = F.min("_least").over(W.partitionBy(*family).orderBy(F.desc("_task")).rowsBetween(W.unboundedPreceding, -1))
    later = later.select(*[F.col(f).alias(f"_f{i}") for i, f in enumerate(family)], F.col("_task").alias("_t"), least.alias("_later"))
    same = F.col("_task") == F.col("_t")
    for i, f in enumerate(family):
        same = same & F.col(f).eqNullSafe(F.col(f"_f{i}"))
    own = F.min("_raw").over(W.partitionBy(*family, "_task").orderBy(F.desc(p)))
    q = raw.withColumn("_own", own).join(sized_broadcast(later, 48), same).select(*family, p, F.least(F.lit(1.0), "_own", "_later").alias(name))
    return by_value(df, cut(q), p, *family)
