"""What comes to the driver, or goes to every task, is counted first."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that the driver takes at most, and bytes that are broadcast at most.
CELLS, BROADCAST_BYTES = 100_000_000, 32 << 20


class TooLarge(ValueError):
    """A table that is meant to be a cohort's is not."""


def to_local(df: DataFrame, what: str, width: int = 1, cells: int = CELLS) -> pd.DataFrame:
    """df in pandas, if its rows times their values (width: those of an array column) are within
    bounds; raises TooLarge before any row comes otherwise."""
    n = df.count()
    if n * max(width, len(df.columns)) > cells:
        raise TooLarge(f"{what}: {n} rows of {max(width, len(df.columns))} values are more than the driver takes ({cells})")
    return df.toPandas()


def sized_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are small enough, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet into the folder that spark.checkpoint.dir names and read again: its lineage ends
    there, and it is computed once. In local mode a temporary folder serves if none is set."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tessera-shared"
    path = f"{base}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
