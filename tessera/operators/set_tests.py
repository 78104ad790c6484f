"""Tests of feature sets: signs and ranks of their values, and the shift of their correlations with a response.

The shift's null permutes the response within groups. A permuted response has the mean and the norm
of the real one, so the mean correlation of a set is linear in it: the standardised features of a set are added
up once, sample by sample, and every permutation is a product with that profile. No
feature meets a permutation, and no vector is whole anywhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.local import cut, sized_broadcast, to_local
from ..functions.ranks import with_rank
from ..functions.special import binomial_two_sided, normal_two_sided, rank_sum_p
from ..functions.sums import block_sums

PERMUTATIONS = 1000


@F.pandas_udf(T.DoubleType())
def _sign_p(positive: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided(int(k), int(m)) for k, m in zip(positive, n, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _rank_p(u: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_p(float(a), int(b), int(c), float(t)) if b and c else None for a, b, c, t in zip(u, n, m, ties, strict=True)], dtype="float64")


def signed_set_test(values: DataFrame, sets: DataFrame, feature: str, value: str) -> DataFrame:
    """set, n, n_positive, p_sign (share of positive values against 1/2, zeros among the others), mean_value, u,
    p_rank (Mann-Whitney against all features outside, two-sided, ties corrected; exact without ties if a side
    has at most 8 values). Missing values do not count; a set without any has n 0 and NULLs.

    Values are ranked once for all sets; the ties of the whole table are counted by value."""
    known = values.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(feature, F.col(value).cast("double").alias("_v"))
    ranked = with_rank(known, "_v", "_r")
    t = F.col("_t").cast("double")
    counts = known.groupBy("_v").agg(F.count(F.lit(1)).alias("_t")).agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("_all"), F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("_ties"))  # one row
    members = sets.select("set", feature).distinct()
    per = members.join(ranked, feature).groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_v") > 0).cast("long")).alias("n_positive"), F.avg("_v").alias("mean_value"), F.sum("_r").alias("_sum"))
    out = sets.select("set").distinct().join(per, "set", "left").crossJoin(F.broadcast(counts)).fillna(0, ["n", "n_positive"])
    n, rest = F.col("n"), F.col("_all") - F.col("n")
    u = F.when((n > 0) & (rest > 0), F.col("_sum") - n * (n + 1) / 2)
    return out.select("set", "n", "n_positive", F.when(n > 0, _sign_p("n_positive", n)).alias("p_sign"), "mean_value", u.alias("u"), F.when(u.isNotNull(), _rank_p(F.coalesce(u, F.lit(0.0)), n, rest, "_ties")).alias("p_rank"))


def permuted(lines: DataFrame, sample: str, y: str, group: str, draws: int, seed: int) -> DataFrame:
    """sample, draw (0: as it is), y: the response moved within groups, by seeded orders of their samples.

    The k-th sample of a group gets the response of the k-th in the draw's order; a null group is one."""
    rows = lines.select(sample, F.col(y).cast("double").alias("_y"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g"))
    base = rows.select(sample, "_g", F.row_number().over(W.partitionBy("_g").orderBy(sample)).alias("_k"))
    each = rows.select(F.col(sample).alias("_from"), "_y", "_g", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("_from").cast("string")).cast("binary"))
    given = each.withColumn("_k", F.row_number().over(W.partitionBy("draw", "_g").orderBy(key, "_from"))).select("draw", "_g", "_k", "_y")
    return base.join(given, ["_g", "_k"]).select(sample, "draw", F.col("_y").alias("y")).unionByName(rows.select(sample, F.lit(0).alias("draw"), F.col("_y").alias("y")))


def set_shift(long: DataFrame, lines: DataFrame, sets: DataFrame, strata: DataFrame, sample: str, feature: str, value: str, y: str, group: str, draws: int = PERMUTATIONS, seed: int = 0) -> DataFrame:
    """set, n, mean_r, background_r, shift, p: the mean correlation of a set's features with y, less the mean over
    all features (the set's among them) of their strata, weighted by the set's share in each; p by permuting y
    within groups, two-sided, (1 + #) / (1 + draws).

    long: a value for each sample of lines and feature; sets: set, feature; strata: feature, stratum. A constant
    feature has no correlation and counts in no mean; sets without a feature that has one are left out."""
    full = lines.filter(F.col(y).isNotNull())
    cells = long.join(full.select(sample), sample, "left_semi").select(sample, feature, F.col(value).cast("double").alias("_x"))
    per = cells.groupBy(feature).agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"), F.count("_x").alias("_n"))
    per = cut(per.withColumn("_ok", F.col("_s") > 1e-12 * F.greatest(F.abs("_m"), F.lit(1e-300))))
    kinds = sets.select(F.lit(0).alias("_kind"), F.col("set").cast("string").alias("_name"), feature).distinct().unionByName(strata.filter("stratum IS NOT NULL").select(F.lit(1).alias("_kind"), F.col("stratum").cast("string").alias("_name"), feature).distinct())
    kinds = kinds.join(per.select(feature, "_ok"), feature)
    names = to_local(kinds.groupBy("_kind", "_name").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("_ok").cast("long")).alias("used")), "sets and strata").sort_values(["_kind", "_name"]).reset_index(drop=True)
    spark, out = long.sparkSession, "`set` string, n long, mean_r double, background_r double, shift double, p double"
    if not len(names):
        return spark.createDataFrame([], out)
    k, at = len(names), {(int(a), b): i for i, (a, b) in enumerate(zip(names["_kind"], names["_name"], strict=True))}
    both = kinds.filter("_kind = 0").select(feature, F.col("_name").alias("_set")).join(kinds.filter("_kind = 1").select(feature, F.col("_name").alias("_stratum")), feature)
    inside = to_local(both.groupBy("_set", "_stratum").agg(F.count(F.lit(1)).alias("n")), "sets by stratum")
    weight = np.zeros((k, k))
    for a, b, n in zip(inside["_set"], inside["_stratum"], inside["n"], strict=True):
        weight[at[0, a], at[1, b]] = n / names["size"][at[0, a]]

    index = spark.createDataFrame([(a, b, i) for (a, b), i in at.items()], "_kind int, _name string, _at int")
    member = kinds.filter("_ok").join(sized_broadcast(index, 48), ["_kind", "_name"]).groupBy(feature).agg(F.collect_list("_at").alias("_ats"))
    unit = (F.col("_x") - F.col("_m")) / (F.col("_s") * F.sqrt("_n"))
    scaled = cells.join(sized_broadcast(per.filter("_ok").join(member, feature), 96), feature).select(sample, unit.alias("_u"), F.explode("_ats").alias("_at"))
    profile = scaled.groupBy(sample, "_at").agg(F.sum("_u").alias("_u")).groupBy(sample).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_u"))).alias("_p"))
    profile = profile.select(sample, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("_p", i), F.lit(0.0))).alias("u"))
    moved = permuted(full, sample, y, group, draws, seed).groupBy(sample).agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "y"))), lambda s: s["y"]).alias("z"))
    m = full.agg(F.avg(F.col(y).cast("double")), F.stddev_pop(F.col(y).cast("double")), F.count(F.lit(1))).first()
    if not m[1]:
        return spark.createDataFrame([], out)
    shift, norm = float(m[0]), float(m[1]) * float(np.sqrt(m[2]))
    rows = profile.join(moved, sample).select("u", "z")

    def product(pdf: pd.DataFrame) -> np.ndarray:
        return (np.stack(pdf["u"].to_numpy()).T @ ((np.stack(pdf["z"].to_numpy()) - shift) / norm)).ravel()

    used = names["used"].to_numpy(float)
    with np.errstate(all="ignore"):
        mean = block_sums(rows, product, k * (draws + 1), "mean correlations by permutation").reshape(k, draws + 1) / used[:, None]
    found = []
    for i in range(k):
        if names["_kind"][i] == 0 and used[i]:
            on = np.flatnonzero(weight[i])
            back = (weight[i, on][:, None] * mean[on]).sum(axis=0)
            gap = mean[i] - back
            # equal up to rounding counts as equal
            hits = (np.abs(gap[1:]) >= abs(gap[0]) * (1 - 1e-12)).sum()
            found.append((names["_name"][i], int(names["size"][i]), float(mean[i, 0]), float(back[0]), float(gap[0]), float((1 + hits) / (1 + draws))))
    return spark.createDataFrame(found, out)
