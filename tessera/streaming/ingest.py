"""Incremental ingest of long measurement tables.

The batch reader works in chunks of a growing file; as a stream, each new file is filtered
alike and added to running sums, so means are those of the batch read at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import flag
from ..sources.tables import EXPRESSION


def expression_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Rows of the CSV files that arrive in a folder (columns in the schema's order)."""
    return spark.readStream.schema(EXPRESSION).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def running_means(stream: DataFrame, ids: DataFrame) -> DataFrame:
    """model_id, gene_symbol, value, n: running means of the needed models' cells."""
    needed = stream.join(ids.select("model_id").distinct(), "model_id", "left_semi").filter(~flag("duplicate"))
    return needed.groupBy("model_id", "gene_symbol").agg(F.avg("rsem_tpm").alias("value"), F.count("rsem_tpm").alias("n"))


def start(means: DataFrame, path: str, checkpoint: str):
    """Write the running means that each batch changes to `path`, until no more input is there.

    A batch has a folder of its own, written anew if it is run again, so nothing is counted twice
    and nothing is held on the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return means.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """model_id, gene_symbol, value, n: the means as the last batch that changed them left them."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy("model_id", "gene_symbol").agg(F.max_by(F.struct("value", "n"), "batch").alias("m")).select("model_id", "gene_symbol", "m.value", "m.n")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The latest means as one table, for readers and for a new start."""
    latest(spark, path).write.mode("overwrite").parquet(to)
