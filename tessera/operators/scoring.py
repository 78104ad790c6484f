"""Per-sample scores of feature sets, on long tables (sample, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.nulls import safe_corr, zscore
from ..functions.ranks import average_rank, percentile_rank


def rank_matrix(long: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """sample, feature, p: percentile rank within each sample."""
    return long.select(sample, feature, percentile_rank(value, sample).alias("p"))


def background_score(ranks: DataFrame, sets: DataFrame, sample: str, feature: str, rank: str = "p") -> DataFrame:
    """sample, set, k, score: (mean rank of the set - mean of all) over the standard error
    of the mean of k drawn without replacement; NULL where that is 0.

    sets (set, feature) are a bounded list; the ranks are read once, and each sample's totals
    come from the same shuffle as its ranks."""
    w = W.partitionBy(sample)
    r = ranks.select(sample, feature, F.col(rank).alias("_p"), F.count(F.lit(1)).over(w).alias("_n"), F.avg(rank).over(w).alias("_m"), F.var_samp(rank).over(w).alias("_v"))
    s = sets.select("set", F.col(feature).alias("_f")).distinct()
    hit = r.join(s, F.col(feature) == F.col("_f"))
    out = hit.groupBy(sample, "set").agg(F.count(F.lit(1)).alias("k"), F.avg("_p").alias("_s"), F.max("_n").alias("_n"), F.max("_m").alias("_m"), F.max("_v").alias("_v"))
    n, k = F.col("_n").cast("double"), F.col("k").cast("double")
    se = F.sqrt(F.col("_v") / k * F.try_divide(n - k, n - 1))
    return out.select(sample, "set", "k", F.try_divide(F.col("_s") - F.col("_m"), F.nullif(se, F.lit(0.0))).alias("score"))


def up_down(scores: DataFrame, sample: str, up: str, down: str, name: str) -> DataFrame:
    """Scores with set `name` = up - down in place of both."""
    a = scores.filter(F.col("set") == up).select(sample, F.col("score").alias("_u"))
    b = scores.filter(F.col("set") == down).select(sample, F.col("score").alias("_d"))
    both = a.join(b, sample, "full").select(sample, F.lit(name).alias("set"), (F.col("_u") - F.col("_d")).alias("score"))
    return scores.filter(~F.col("set").isin(up, down)).select(sample, "set", "score").unionByName(both)


def ssgsea(ranks: DataFrame, sets: DataFrame, sample: str, feature: str, rank: str = "p", alpha: float = 0.25) -> DataFrame:
    """sample, set, score: the running in-set less out-set share down each sample's ranking,
    summed and divided by its range over samples. Equal ranks go by feature name."""
    w = W.partitionBy(sample)
    down = w.orderBy(F.desc(rank), F.asc(feature))
    n = F.count(F.lit(1)).over(w)
    r = ranks.select(sample, feature, F.pow((n - F.row_number().over(down) + 1).cast("double"), F.lit(alpha)).alias("_w"), F.row_number().over(down).alias("_i"), n.alias("_n"))
    names = [x.set for x in sets.select("set").distinct().orderBy("set").collect()]
    packed = sets.groupBy(F.col(feature).alias("_f")).agg(F.collect_set("set").alias("_sets"))
    r = r.join(packed, F.col(feature) == F.col("_f"), "left").drop("_f")
    # sum over places of a running share = share * places from it on: no second window
    left = F.col("_n") - F.col("_i") + 1
    parts = []
    for i, s in enumerate(names):
        has = F.coalesce(F.array_contains("_sets", s), F.lit(False))
        parts += [
            F.sum(F.when(has, F.col("_w") * left)).alias(f"a{i}"), F.sum(F.when(has, F.col("_w"))).alias(f"b{i}"),
            F.sum(F.when(~has, left)).alias(f"c{i}"), F.sum(F.when(~has, 1)).alias(f"d{i}"),
        ]
    agg = r.groupBy(sample).agg(*parts)
    raw = lambda i: F.try_divide(F.col(f"a{i}"), F.col(f"b{i}")) - F.try_divide(F.col(f"c{i}").cast("double"), F.col(f"d{i}").cast("double"))
    long = agg.select(sample, F.inline(F.array(*[F.struct(F.lit(s).alias("set"), raw(i).alias("raw")) for i, s in enumerate(names)])))
    span = F.max("raw").over(W.partitionBy("set")) - F.min("raw").over(W.partitionBy("set"))
    return long.select(sample, "set", F.try_divide("raw", F.nullif(span, F.lit(0.0))).alias("score"))


def zscore_within(df: DataFrame, value: str, *groups: str, ddof: int = 0) -> Column:
    return zscore(value, W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0)), ddof)


def mean_of_z(long: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """sample, score: z within each feature (population SD), mean over features, z again."""
    z = long.withColumn("_z", zscore(value, W.partitionBy(feature)))
    m = z.groupBy(sample).agg(F.avg("_z").alias("_m"))
    return m.select(sample, zscore("_m", W.partitionBy(F.lit(0))).alias("score"))


def ulm_activity(long: DataFrame, edges: DataFrame, sample: str, feature: str, value: str, least: int = 10) -> DataFrame:
    """sample, source, n, t: the t of the slope of a sample's values on a regulator's weights
    over all features, absent ones with weight 0; regulators with fewer than `least`
    targets in the universe are left out. edges: source, feature, weight.

    Only the edges are joined; features of zero weight enter by the sample's totals."""
    y = F.col(value).cast("double")
    known = long.filter(F.col(value).isNotNull())
    universe = known.select(feature).distinct()
    e = edges.select("source", F.col(feature), F.col("weight").cast("double").alias("weight")).join(universe, feature, "left_semi")
    x = e.groupBy("source").agg(F.count(F.lit(1)).alias("targets"), F.sum("weight").alias("sx"), F.sum(F.col("weight") * F.col("weight")).alias("sxx")).filter(F.col("targets") >= least)
    totals = known.groupBy(sample).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))
    sxy = known.join(e, feature).groupBy(sample, "source").agg(F.sum(y * F.col("weight")).alias("sxy"))
    s = sxy.join(x, "source").join(totals, sample)
    n = F.col("n").cast("double")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    scale = F.sqrt(n * F.col("sxx") - F.col("sx") * F.col("sx")) * F.sqrt(n * F.col("syy") - F.col("sy") * F.col("sy"))
    r = F.try_divide(cov, F.nullif(scale, F.lit(0.0)))
    s = s.withColumn("r", r)
    t = F.col("r") * F.sqrt(F.try_divide(n - 2, F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0))))
    return s.select(sample, "source", "n", t.alias("t"))


def trend_stats(df: DataFrame, feature: str, hours: str, value: str, first: int = 0, last: int = 48) -> DataFrame:
    """feature, n, trend_r, spearman, delta, cohens_d, t, t_df, and mean and SD at first and last time.

    Cohen's d uses the root of the mean of both sample variances; t has pooled variance."""
    ranked = df.withColumn("_rh", average_rank(hours, feature)).withColumn("_rv", average_rank(value, feature))
    at = lambda h: F.when(F.col(hours) == h, F.col(value))
    g = ranked.groupBy(feature).agg(
        F.count(F.lit(1)).alias("n"), safe_corr(hours, value).alias("trend_r"), safe_corr("_rh", "_rv").alias("spearman"),
        F.avg(at(first)).alias("mean_first"), F.avg(at(last)).alias("mean_last"), F.stddev_samp(at(first)).alias("sd_first"), F.stddev_samp(at(last)).alias("sd_last"),
        F.count(at(first)).alias("_n0"), F.count(at(last)).alias("_n1"),
    )
    delta, v0, v1 = F.col("mean_last") - F.col("mean_first"), F.pow("sd_first", F.lit(2.0)), F.pow("sd_last", F.lit(2.0))
    df_ = (F.col("_n0") + F.col("_n1") - 2).cast("double")
    pooled = F.try_divide((F.col("_n0") - 1) * v0 + (F.col("_n1") - 1) * v1, F.nullif(df_, F.lit(0.0)))
    se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("_n0").cast("double")) + F.try_divide(F.lit(1.0), F.col("_n1").cast("double"))))
    return g.select(
        feature, "n", "trend_r", "spearman", delta.alias("delta"), F.try_divide(delta, F.nullif(F.sqrt((v0 + v1) / 2), F.lit(0.0))).alias("cohens_d"),
        F.try_divide(delta, F.nullif(se, F.lit(0.0))).alias("t"), df_.alias("t_df"), "mean_first", "mean_last", "sd_first", "sd_last",
    )


def trend_by_time(df: DataFrame, feature: str, hours: str, value: str, times: list[int]) -> DataFrame:
    """feature, mean_<t>h and sd_<t>h at every time point."""
    at = lambda h: F.when(F.col(hours) == h, F.col(value))
    return df.groupBy(feature).agg(*[F.avg(at(t)).alias(f"mean_{t}h") for t in times], *[F.stddev_samp(at(t)).alias(f"sd_{t}h") for t in times])
