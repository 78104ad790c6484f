"""Association, enrichment and agreement tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.multiplicity import bh_q
from ..functions.nulls import pair_count, safe_corr
from ..functions.ranks import in_ranges, with_rank
from ..functions.special import hypergeometric_tail_udf, normal_two_sided_udf, pearson_p_udf, t_two_sided_udf
from .relational import paired


def pearson(df: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """groups, n, r, p over complete pairs."""
    g = df.groupBy(*groups).agg(pair_count(x, y).alias("n"), safe_corr(x, y).alias("r"))
    return g.withColumn("p", pearson_p_udf(F.col("r"), F.col("n").cast("double")))


def fisher_ci(r: str | Column, n: str | Column, k: int | Column = 0) -> tuple[Column, Column]:
    """95 % interval of r, k controls."""
    r, n = (F.col(v) if isinstance(v, str) else v for v in (r, n))
    z, half = F.atanh(r), F.lit(1.96) / F.sqrt(F.nullif(F.greatest(n.cast("double") - 3.0 - F.lit(k).cast("double"), F.lit(0.0)), F.lit(0.0)))
    return F.tanh(z - half), F.tanh(z + half)


def fisher_difference_z(r1: str, n1: str, r2: str, n2: str) -> Column:
    one = F.lit(1.0)
    return (F.atanh(r1) - F.atanh(r2)) / F.sqrt(F.try_divide(one, F.col(n1) - 3.0) + F.try_divide(one, F.col(n2) - 3.0))


def fisher_difference_p(r1: str, n1: str, r2: str, n2: str) -> Column:
    return normal_two_sided_udf(fisher_difference_z(r1, n1, r2, n2))


def partial_corr_1(df: DataFrame, x: str, y: str, control: str, *groups: str) -> DataFrame:
    """groups, n, r of x and y given one control (closed form), p with n - 2 degrees of freedom."""
    full = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull())
    g = full.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), safe_corr(x, y).alias("xy"), safe_corr(x, control).alias("xz"), safe_corr(y, control).alias("yz"))
    scale = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    g = g.select(*groups, "n", F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.nullif(scale, F.lit(0.0))).alias("r"))
    return g.withColumn("p", pearson_p_udf(F.col("r"), F.col("n").cast("double")))


def cross_products(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """X'X of (1, columns) over complete rows, summed where the rows are; and their number."""
    full = df.dropna(subset=columns) if columns else df
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    sums = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    got = iter(full.agg(*sums).first())
    out = np.zeros((len(x), len(x)))
    for i in range(len(x)):
        for j in range(i, len(x)):
            out[i, j] = out[j, i] = next(got) or 0.0
    return out, int(out[0, 0])


def residualized(df: DataFrame, y: str, controls: list[str], name: str = "residual") -> DataFrame:
    """df with y less its least-squares fit (minimum norm) on the controls; NULL on incomplete rows."""
    a, n = cross_products(df, [*controls, y])
    beta = np.linalg.lstsq(a[:-1, :-1], a[:-1, -1], rcond=None)[0] if n else np.zeros(len(controls) + 1)
    fit = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], controls, strict=True):
        fit = fit + F.lit(float(b)) * F.col(c).cast("double")
    return df.withColumn(name, F.col(y).cast("double") - fit)


def partial_corr(df: DataFrame, x: str, y: str, controls: list[str]) -> DataFrame:
    """n, r, p of x and y given the controls (plain Pearson without any)."""
    full = df.dropna(subset=[x, y, *controls])
    if not controls:
        return pearson(full, x, y)
    both = residualized(residualized(full, x, controls, "_rx"), y, controls, "_ry")
    return pearson(both, "_rx", "_ry")


def residual_axis(df: DataFrame, value: str, axis: str, *groups: str) -> DataFrame:
    """df with `residual`: value less its fit on one axis, within groups."""
    both = F.col(value).isNotNull() & F.col(axis).isNotNull()
    x, y = F.when(both, F.col(axis)), F.when(both, F.col(value))
    if not groups:  # one row of moments goes to every row
        m = df.agg(F.try_divide(F.covar_pop(x, y), F.nullif(F.var_pop(x), F.lit(0.0))).alias("_s"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
        return df.crossJoin(F.broadcast(m)).withColumn("residual", y - (F.col("_my") + F.col("_s") * (x - F.col("_mx")))).drop("_s", "_mx", "_my")
    w = W.partitionBy(*groups)
    slope = F.try_divide(F.covar_pop(x, y).over(w), F.nullif(F.var_pop(x).over(w), F.lit(0.0)))
    return df.withColumn("_s", slope).withColumn("residual", y - (F.avg(y).over(w) + F.col("_s") * (x - F.avg(x).over(w)))).drop("_s")


def hypergeometric_overlap(df: DataFrame, n_a: str, n_b: str, observed: str, universe: str) -> DataFrame:
    """df with expected, fold, p_value; NULL for an empty universe or set."""
    a, b, k, u = (F.col(c).cast("double") for c in (n_a, n_b, observed, universe))
    some = (u > 0) & (a > 0) & (b > 0)
    e = F.when(some, a * b / F.nullif(u, F.lit(0.0)))
    return df.withColumn("expected", e).withColumn("fold", F.try_divide(k, F.nullif(e, F.lit(0.0)))).withColumn("p_value", F.when(some, hypergeometric_tail_udf(u, a, b, k)))


def enrichment(query: DataFrame, sets: DataFrame, universe: DataFrame, gene: str, query_in_universe: bool = True) -> DataFrame:
    """set, universe_size, signature_size, query_size, observed, expected, fold, p_value.

    Sets are cut to the universe; so is the query, or (query_in_universe false) it is taken as it is."""
    u = universe.select(gene).distinct()
    q = query.select(gene).distinct()
    if query_in_universe:
        q = q.join(u, gene, "left_semi")
    s = sets.select("set", gene).distinct().join(u, gene, "left_semi")
    n_u, n_q = u.count(), q.count()
    g = s.join(q.withColumn("_q", F.lit(1)), gene, "left").groupBy("set").agg(F.count(F.lit(1)).alias("signature_size"), F.count("_q").alias("observed"))
    names = sets.select("set").distinct().join(g, "set", "left").fillna(0, ["signature_size", "observed"])
    names = names.withColumn("universe_size", F.lit(n_u)).withColumn("query_size", F.lit(n_q))
    return hypergeometric_overlap(names, "query_size", "signature_size", "observed", "universe_size")


def screen_agreement(a: DataFrame, b: DataFrame, key: str, value: str, lines: DataFrame | None = None, least: int = 10) -> DataFrame:
    """n, r, p, rho over shared lines; NULL under `least` of them."""
    both = paired(a, b, key, value, lines)
    ranked = with_rank(with_rank(both, "a", "_ra"), "b", "_rb")
    g = ranked.agg(F.count(F.lit(1)).alias("n"), safe_corr("a", "b").alias("r"), safe_corr("_ra", "_rb").alias("rho"))
    enough = F.col("n") >= least
    g = g.select("n", F.when(enough, F.col("r")).alias("r"), F.when(enough, F.col("rho")).alias("rho"))
    return g.withColumn("p", pearson_p_udf(F.col("r"), F.col("n").cast("double")))


def concordance(df: DataFrame, y: str, pred: str, event: str | None = None, ranges: int = 64) -> DataFrame:
    """pairs, concordance: share of comparable pairs (smaller y has the event) that pred orders
    alike, ties in pred as half.

    The distinct y are numbered in order. Two numbers differ first at one binary digit, so
    each pair of rows meets at one level, in the group of the digits before: those with 0 there
    come first in y. In a group the ones of smaller and equal pred are counted by running sums, over
    ranges of pred that are summed before. n log n rows, and no pairs."""
    rows = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    e = F.lit(True) if event is None else F.coalesce(F.col(event).cast("boolean"), F.lit(False))
    rows = rows.select(F.col(y).cast("double").alias("y"), F.col(pred).cast("double").alias("p"), e.alias("e"))
    cells = rows.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("e"), 1).otherwise(0)).alias("ne"))
    numbers = in_ranges(cells.select(F.col("y").alias("_y")).distinct().withColumn("_one", F.lit(1)), "_y", "_one", "_number").select("_y", "_number")
    top = numbers.agg(F.max("_number")).first()[0] or 0
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    borders = sorted(set(cells.agg(F.percentile_approx("p", steps, F.lit(1000)).alias("e")).first().e or []))
    cuts = F.array(*[F.lit(float(b)) for b in borders]) if borders else F.array().cast("array<double>")
    cells = cells.withColumn("range", F.size(F.filter(cuts, lambda b: b < F.col("p")))).join(numbers, F.col("y") == F.col("_y"))
    levels = F.sequence(F.lit(0), F.lit(max(int(top).bit_length() - 1, 0)))
    each = cells.select("p", "range", "n", "ne", "_number", F.explode(levels).alias("level"))
    high = F.expr("shiftright(_number, level) & 1") == 1
    g = each.groupBy("level", F.expr("shiftright(_number, level + 1)").alias("group"), "range", "p")
    g = g.agg(F.sum(F.when(high, 0).otherwise(F.col("ne"))).alias("first"), F.sum(F.when(high, F.col("n")).otherwise(0)).alias("second"))
    running = F.coalesce(F.sum("first").over(W.partitionBy("level", "group", "range").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = g.select((F.col("second") * (running + F.col("first") / 2.0)).alias("good"), F.lit(0.0).alias("pairs"))
    sums = g.groupBy("level", "group", "range").agg(F.sum("first").alias("first"), F.sum("second").alias("second"))
    earlier = F.coalesce(F.sum("first").over(W.partitionBy("level", "group").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    across = sums.select((F.col("second") * earlier).cast("double").alias("good"), F.lit(0.0).alias("pairs"))
    whole = sums.groupBy("level", "group").agg(F.sum("first").alias("first"), F.sum("second").alias("second"))
    whole = whole.select(F.lit(0.0).alias("good"), (F.col("first").cast("double") * F.col("second")).alias("pairs"))
    total = inside.unionByName(across).unionByName(whole).agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs"), F.sum("good").alias("good"))
    return total.select("pairs", F.try_divide("good", F.nullif(F.col("pairs"), F.lit(0.0))).alias("concordance"))


def corrected_ttest(df: DataFrame, diff: str, n_train: float, n_test: float, *groups: str) -> DataFrame:
    """groups, n_splits, mean_diff, t, p: variance times (1/J + n_test/n_train), J - 1 degrees of freedom."""
    g = df.groupBy(*groups).agg(F.count(diff).alias("n_splits"), F.avg(diff).alias("mean_diff"), F.var_samp(diff).alias("_v"))
    j = F.col("n_splits").cast("double")
    se = F.sqrt(F.col("_v") * (F.try_divide(F.lit(1.0), j) + F.lit(n_test / n_train)))
    g = g.withColumn("t", F.when(j >= 2, F.try_divide(F.col("mean_diff"), F.nullif(se, F.lit(0.0))))).drop("_v")
    return g.withColumn("p", t_two_sided_udf(F.col("t"), j - 1))


def difference_by_split(a: DataFrame, b: DataFrame) -> DataFrame:
    """repeat, fold, r_a, r_b, diff of two out-of-fold tables (line, repeat, fold, truth, pred)
    on the same splits; raises ValueError if splits or truth differ."""
    keys = ["line", "repeat", "fold", "truth"]
    odd = a.select(keys).exceptAll(b.select(keys)).limit(1).count() + b.select(keys).exceptAll(a.select(keys)).limit(1).count()
    if odd:
        raise ValueError("the models were not evaluated on the same splits")
    both = a.select(*keys, F.col("pred").alias("pa")).join(b.select(*keys[:3], F.col("pred").alias("pb")), keys[:3])
    g = both.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n"), safe_corr("truth", "pa").alias("r_a"), safe_corr("truth", "pb").alias("r_b"))
    return g.withColumn("diff", F.col("r_a") - F.col("r_b"))


def all_feature_corr(long: DataFrame, target: DataFrame, sample: str, feature: str, value: str, y: str) -> DataFrame:
    """feature, n, r, p, q of each feature with one target."""
    g = long.join(target.select(sample, y), sample).groupBy(feature).agg(pair_count(value, y).alias("n"), safe_corr(value, y).alias("r"))
    g = g.withColumn("p", pearson_p_udf(F.col("r"), F.col("n").cast("double")))
    return g.withColumn("_f", F.lit(0)).withColumn("q", bh_q("p", "_f")).drop("_f")


def point_biserial_gate(df: DataFrame, flag: str, value: str) -> DataFrame:
    """n, r, p of a 0/1 flag with a value; raises ValueError unless r > 0 and p < 0.05."""
    out = pearson(df.withColumn("_flag", F.col(flag).cast("double")), "_flag", value)
    row = out.first()
    if row.r is None or not (row.r > 0 and row.p < 0.05):
        raise ValueError(f"sanity check failed: r = {row.r}, p = {row.p}")
    return out


def two_sample(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """n_a, n_b, diff (b - a), t (pooled), df, p, cohens_d."""
    at = lambda g: F.when(F.col(group) == g, F.col(value))
    g = df.agg(*[f(at(x)).alias(f"{n}{i}") for i, x in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    diff, dof = F.col("mb") - F.col("ma"), (F.col("na") + F.col("nb") - 2).cast("double")
    pooled = F.try_divide((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"), F.nullif(dof, F.lit(0.0)))
    se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("na").cast("double")) + F.try_divide(F.lit(1.0), F.col("nb").cast("double"))))
    out = g.select(F.col("na").alias("n_a"), F.col("nb").alias("n_b"), diff.alias("diff"), F.try_divide(diff, F.nullif(se, F.lit(0.0))).alias("t"), dof.alias("df"), F.try_divide(diff, F.nullif(F.sqrt((F.col("va") + F.col("vb")) / 2), F.lit(0.0))).alias("cohens_d"))
    return out.withColumn("p", t_two_sided_udf(F.col("t"), F.col("df")))


def affine_fit(df: DataFrame, x: str, y: str) -> tuple[float, float, int]:
    """slope, intercept, n of y on x by least squares."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    row = df.filter(both).agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")), F.count(F.lit(1))).first()
    return (math.nan if row[0] is None else row[0]), (math.nan if row[1] is None else row[1]), row[2]


def not_interpreted(diff: Column, least: float = 0.10) -> Column:
    """Whether a difference is too small to be read."""
    return F.abs(diff) < least


def verdict(r_lo: str, r_hi: str, baseline: str) -> Column:
    """yes / no / inconclusive: an interval above, below, or across a baseline."""
    return F.when(F.col(r_lo) > F.col(baseline), "yes").when(F.col(r_hi) < F.col(baseline), "no").otherwise("inconclusive")
