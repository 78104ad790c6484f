"""Batch adjustment of a long table by empirical Bayes (Johnson, Li and Rabinovic 2007), without covariates.

A gene's values enter by count, mean and sum of squares in each batch, so that nothing but one row a
gene and batch is held anywhere: the priors are aggregates of those over genes, and the
posterior's fixed point needs no values, as the squared deviations from any centre follow from the moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.local import sized_broadcast

STEPS, TOLERANCE = 500, 1e-12


def _posterior(n: np.ndarray, g: np.ndarray, d: np.ndarray, g_bar: np.ndarray, t2: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fixed point of each row (batch effect, its variance); rows settle one by one."""
    gs, ds, moving = g.copy(), d.copy(), np.isfinite(g) & np.isfinite(d)
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            i = np.flatnonzero(moving)
            if not len(i):
                break
            gn = (n[i] * t2[i] * g[i] + ds[i] * g_bar[i]) / (n[i] * t2[i] + ds[i])
            ss = (n[i] - 1) * d[i] + n[i] * (g[i] - gn) ** 2
            dn = np.where(np.isfinite(a[i]), (0.5 * ss + b[i]) / (n[i] / 2 + a[i] - 1), ds[i])
            change = np.maximum(np.abs(gn - gs[i]), np.abs(dn - ds[i]) / ds[i])
            gs[i], ds[i] = gn, dn
            moving[i] = change > TOLERANCE
    return gs, ds


@F.pandas_udf(T.StructType([T.StructField("g", T.DoubleType()), T.StructField("d", T.DoubleType())]))
def _posterior_udf(n: pd.Series, g: pd.Series, d: pd.Series, g_bar: pd.Series, t2: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip("gd", _posterior(*(x.to_numpy(float) for x in (n, g, d, g_bar, t2, a, b))), strict=True)))


def batch_effects(long: DataFrame, gene: str, value: str) -> DataFrame:
    """gene, batch, _grand, _sd, _effect, _spread: what adjusted values are computed from.

    long has one value a gene and sample, with its batch. Genes that miss a sample of any batch are left
    out. A gene that is constant in a batch keeps its values (effect 0, spread 1, and no part in the priors).
    If a batch has one sample only, spreads are not adjusted."""
    known = long.select(F.col(gene).alias("_gene"), "batch", F.col(value).alias("_value")).filter("_value IS NOT NULL AND batch IS NOT NULL")
    m = known.groupBy("_gene", "batch").agg(F.count(F.lit(1)).alias("n"), F.avg("_value").alias("m"), F.var_pop("_value").alias("v"))
    whole = m.groupBy("batch").agg(F.max("n").alias("full"))  # a batch's samples: genes without gaps have them all
    batches = whole.agg(F.count(F.lit(1)).alias("k"), F.min("full").alias("least")).first()
    mean_only = (batches.least or 0) < 2
    m = m.join(sized_broadcast(whole, 32), "batch").filter("n = full")
    per = m.groupBy("_gene").agg(F.count(F.lit(1)).alias("k"), F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("grand"), F.sqrt(F.try_divide(F.sum(F.col("n") * F.col("v")), F.sum("n"))).alias("sd"), F.min("v").alias("least"))
    per = per.filter(F.col("k") == (batches.k or 0)).withColumn("moves", (F.col("sd") > 0) & (F.lit(mean_only) | (F.col("least") > 0))).drop("k", "least")
    rows = m.join(per, "_gene")
    own = F.col("n").cast("double")
    rows = rows.withColumn("g", F.when(F.col("moves"), (F.col("m") - F.col("grand")) / F.col("sd"))).withColumn("d", F.when(F.col("moves"), F.lit(1.0) if mean_only else own * F.col("v") / (own - 1) / (F.col("sd") * F.col("sd"))))
    s2, mean = F.var_samp("d"), F.avg("d")
    priors = rows.groupBy("batch").agg(F.avg("g").alias("g_bar"), F.coalesce(F.var_samp("g"), F.lit(0.0)).alias("t2"), F.try_divide(2 * s2 + mean * mean, F.nullif(s2, F.lit(0.0))).alias("a"), F.try_divide(mean * s2 + F.pow(mean, 3), F.nullif(s2, F.lit(0.0))).alias("b"))
    rows = rows.join(sized_broadcast(priors, 48), "batch")
    if mean_only:
        effect = (F.col("t2") * F.col("g") + F.col("g_bar")) / (F.col("t2") + 1)
        rows = rows.withColumn("p", F.struct(effect.alias("g"), F.lit(1.0).alias("d")))
    else:
        rows = rows.withColumn("p", _posterior_udf(own, "g", "d", "g_bar", "t2", "a", "b"))
    return rows.select(F.col("_gene").alias(gene), "batch", F.col("grand").alias("_grand"), F.col("sd").alias("_sd"), F.when(F.col("moves"), F.col("p.g")).otherwise(0.0).alias("_effect"), F.when(F.col("moves"), F.col("p.d")).otherwise(1.0).alias("_spread"))


def batch_adjusted(long: DataFrame, gene: str, sample: str, value: str, batch: DataFrame) -> DataFrame:
    """gene, sample, value after adjustment of the genes that all samples have; batch: sample, batch."""
    rows = long.select(gene, sample, value).join(sized_broadcast(batch.select(sample, "batch"), 64), sample)
    found = rows.join(sized_broadcast(batch_effects(rows, gene, value), 64), [gene, "batch"])
    z = F.try_divide(F.col(value) - F.col("_grand"), F.nullif("_sd", F.lit(0.0)))
    moved = (z - F.col("_effect")) / F.sqrt("_spread") * F.col("_sd") + F.col("_grand")
    return found.select(gene, sample, F.coalesce(moved, F.col(value)).alias(value))
