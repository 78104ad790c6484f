"""Principal components of samples: a blocked Gram matrix of features, summed where the samples are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.local import cut, to_local
from ..functions.sums import block_sums

TOP = 2000


def _dense(pdf: pd.DataFrame, width: int) -> np.ndarray:
    x = np.zeros((len(pdf), width))
    for i, (at, z) in enumerate(zip(pdf["at"], pdf["z"], strict=True)):
        x[i, np.asarray(at, int)] = z
    return x


def pca(long: DataFrame, sample: str, feature: str, value: str, top: int = TOP, k: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(sample, PC1 ... PCk; the share of the variance of each) over the `top` features of
    most variance (ties by name), standardised by population SD; missing values are means.

    Each component's largest loading (the first of equal ones) is positive. Samples may be any number; what the driver
    holds is top x top. Constant features, and components without variance, are zeros."""
    known = long.filter(F.col(value).isNotNull())
    per = known.groupBy(feature).agg(F.var_samp(value).alias("v"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    chosen = to_local(per.orderBy(F.desc_nulls_last("v"), feature).limit(top), "features of components").reset_index(drop=True)
    width = len(chosen)
    spark = long.sparkSession
    kind = long.schema[feature].dataType.simpleString()
    index = spark.createDataFrame([(f, i, float(m), float(s)) for i, (f, m, s) in enumerate(zip(chosen[feature].tolist(), chosen["m"], chosen["s"], strict=True))], f"`{feature}` {kind}, _i int, _m double, _s double")
    z = F.coalesce(F.try_divide(F.col(value) - F.col("_m"), F.nullif("_s", F.lit(0.0))), F.lit(0.0))
    cells = known.join(F.broadcast(index), feature).select(sample, F.struct(F.col("_i").alias("i"), z.alias("z")).alias("c"))  # top rows
    rows = cut(cells.groupBy(sample).agg(F.collect_list("c").alias("c")).select(sample, F.col("c.i").alias("at"), F.col("c.z").alias("z")))

    def gram(pdf: pd.DataFrame) -> np.ndarray:
        total = np.zeros((width, width))
        for lo in range(0, len(pdf), 1024):
            x = _dense(pdf.iloc[lo : lo + 1024], width)
            total += x.T @ x
        return total.ravel()

    g = block_sums(rows.select("at", "z"), gram, width * width, "a Gram matrix").reshape(width, width) if width else np.zeros((0, 0))
    values, vectors = np.linalg.eigh(g)
    values, vectors = np.maximum(values[::-1][:k], 0), vectors[:, ::-1][:, :k]
    if width:
        size = np.abs(vectors)
        first = (size >= size.max(axis=0) * (1 - 1e-9)).argmax(axis=0)
        sign = np.sign(vectors[first, np.arange(vectors.shape[1])])
        vectors = vectors * np.where(sign == 0, 1, sign) * (values > 1e-12 * max(np.trace(g), 1e-300))
    vectors = np.pad(vectors, ((0, 0), (0, k - vectors.shape[1])))
    share = np.pad(values, (0, k - len(values))) / (np.trace(g) or 1.0)
    shared = spark.sparkContext.broadcast(vectors)

    def project(batches):
        for pdf in batches:
            p = _dense(pdf, width) @ shared.value
            yield pd.DataFrame({sample: pdf[sample], **{f"PC{j + 1}": p[:, j] for j in range(k)}})

    kinds = f"`{sample}` {long.schema[sample].dataType.simpleString()}, " + ", ".join(f"PC{j + 1} double" for j in range(k))
    return rows.mapInPandas(project, kinds), share
