"""Writers of result tables, artefacts and reports."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import regression_metrics

log = logging.getLogger("tessera")


def flat(df: DataFrame) -> DataFrame:
    """Array, map and struct cells as JSON text, for text formats."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_result(df: DataFrame, path: str, label: str, single: bool = True) -> None:
    """A CSV with a header; one file for a result table, many for a large one."""
    out = flat(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)
    log.info("%s: written to %s", label, path)


def write_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet, partitioned; rows of a part are brought together first."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_report(path: str, text: str) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def save_model(spark: SparkSession, path: str, coefficients: DataFrame, meta: dict) -> None:
    """A fitted model as a coefficient table and its description."""
    coefficients.write.mode("overwrite").parquet(f"{path}/coefficients")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/coefficients"), json.loads(spark.read.text(f"{path}/meta").first().value)


def metric_row(df: DataFrame, name: str, truth: str, pred: str, ceiling: float | None = None) -> dict:
    """name, n, r, rho, r2, rmse, bias (and share of a ceiling) as a dict, logged."""
    row = {"name": name} | regression_metrics(df, truth, pred, ceiling=ceiling).first().asDict()
    log.info("%s", row)
    return row


def markdown(df: DataFrame, digits: int = 3, rows: int = 200) -> str:
    """A result table as Markdown (its first rows)."""
    fmt = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(fmt, r)) + " |" for r in df.take(rows))])


def one_row(df: DataFrame, **where) -> dict:
    """The only row that matches; none or several raise LookupError."""
    for c, v in where.items():
        df = df.filter(F.col(c) == v)
    got = df.take(2)
    if len(got) != 1:
        raise LookupError(f"{'no' if not got else 'more than one'} row with {where}")
    return got[0].asDict()
