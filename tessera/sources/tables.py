"""Readers of the input tables, always with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import flag, nan_to_null, number


class SourceError(ValueError):
    """An input is missing or empty."""


EXPRESSION = "model_id string, gene_symbol string, rsem_tpm float, duplicate string, data_source string"
RESPONSE = "SANGER_MODEL_ID string, CELL_LINE_NAME string, TCGA_DESC string, DRUG_ID int, DRUG_NAME string, LN_IC50 double, AUC double, RMSE double, Z_SCORE double, MIN_CONC double, MAX_CONC double"
MODELS = "model_id string, model_name string, synonyms string, tissue string, cancer_type string, cancer_type_detail string, growth_properties string, msi_status string, mutational_burden double, gender string, age_at_sampling double"
COMPOUNDS = "DRUG_ID int, DRUG_NAME string, TARGET string, TARGET_PATHWAY string"
MUTATIONS = "model_id string, gene_symbol string"
ALIASES = "alias string, symbol string"
TSS = "symbol string, chrom string, tss int, strand string, gene_start int, gene_end int, gene_length int"
PEAKS = "seqnames string, start int, end int, annotation string, name string"
EDGES = "source string, target string, weight double"
CLINICAL = "sample_id string, study string, response int, regimen string, bev_added boolean, purity double, StromalScore double, ImmuneScore double, cms string, msi_ntp string, msi_ntp_fdr double, platform string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """The schema's columns of a CSV with a header, wherever they stand in it."""
    if not exists(spark, path):
        raise SourceError(f"missing input: {path}")
    head = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path).columns
    wanted = spark.createDataFrame([], schema).schema
    raw = spark.read.option("sep", sep).option("header", True).schema(", ".join(f"`{c}` string" for c in head)).csv(path)
    lost = [f.name for f in wanted if f.name not in head]
    if lost:
        raise SourceError(f"{path} has no column {', '.join(lost)}")
    return nan_to_null(raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted]))


def select_csv(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """As csv, cut to the given columns, which the scan alone reads."""
    return csv(spark, path, schema).select(*columns)


def expression(spark: SparkSession, path: str, ids: DataFrame, cache: str | None = None) -> DataFrame:
    """model_id, gene_symbol, value (float): the needed models, flagged duplicates left out, means
    of repeated cells. With cache, it is written there once and read from then on."""
    if cache and exists(spark, cache):
        return spark.read.parquet(cache)
    raw = csv(spark, path, EXPRESSION)
    needed = raw.join(ids.select(F.col(ids.columns[0]).alias("model_id")).distinct(), "model_id", "left_semi")
    out = needed.filter(~flag("duplicate")).groupBy("model_id", "gene_symbol").agg(F.avg("rsem_tpm").cast("float").alias("value")).filter("value IS NOT NULL")
    if cache:
        out.write.parquet(cache)
        out = spark.read.parquet(cache)
    if out.isEmpty():
        raise SourceError("no expression row is left for the needed models")
    return out


def has_feature(long: DataFrame, feature: str, name: str) -> bool:
    """Whether a feature occurs: the long table's form of asking for a column."""
    return not long.filter(F.col(feature) == name).limit(1).isEmpty()


def counts(spark: SparkSession, path: str, samples: dict[str, tuple[int, str]], feature: str = "NAME") -> DataFrame:
    """feature, sample, hours, treatment, count of a TSV of counts: stray unnamed columns go,
    texts that are no number are missing, repeated features are summed.

    samples: name -> (hours, treatment); a missing one raises SourceError."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    lost = [s for s in samples if s not in raw.columns]
    if lost:
        raise SourceError(f"{path} lacks the samples {', '.join(lost)}")
    cells = F.array(*[F.struct(F.lit(s).alias("sample"), F.lit(h).alias("hours"), F.lit(t).alias("treatment"), number(F.col(f"`{s}`")).alias("count")) for s, (h, t) in samples.items()])
    long = raw.select(feature, F.inline(cells))
    return long.groupBy(feature, "sample", "hours", "treatment").agg(F.sum("count").alias("count"))


def set_files(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """set, line_no, gene of a directory of *.txt files, a symbol a line; a set is called after
    its file, or by names."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value")
    stem = F.regexp_replace("f", r"\.txt$", "")
    called = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[stem], stem) if names else stem
    return raw.filter(F.col("f").endswith(".txt")).select(called.alias("set"), F.posexplode(F.split("value", r"\r?\n"))).select("set", F.col("pos").alias("line_no"), F.col("col").alias("gene"))


def aliases(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """alias, symbol, ordinal (place in the file, by one ordered read)."""
    if not exists(spark, path):
        if required:
            raise SourceError(f"missing alias map: {path}")
        return spark.createDataFrame([], ALIASES + ", ordinal long")
    rows = csv(spark, path, ALIASES).coalesce(1)
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def ceiling(spark: SparkSession, path: str, target: str, drug: str) -> float:
    """The agreement r of a target and drug from a result table; missing raises SourceError."""
    rows = csv(spark, path, "drug string, target string, line_set string, n int, r double, p double, rho double").filter((F.col("drug") == drug) & (F.col("target") == target)).orderBy("line_set").take(1)
    if not rows or rows[0].r is None:
        raise SourceError(f"no ceiling for {drug} {target} in {path}")
    return rows[0].r


def matrix_csv(spark: SparkSession, path: str, feature: str = "gene", sep: str = ",") -> DataFrame:
    """feature, sample, value of a features x samples text table."""
    raw = spark.read.option("sep", sep).option("header", True).csv(path)
    names = [c for c in raw.columns[1:] if not c.startswith(("Unnamed", "_c"))]
    first = F.col(f"`{raw.columns[0]}`").alias(feature)
    cells = F.array(*[F.struct(F.lit(c).alias("sample"), number(F.col(f"`{c}`")).alias("value")) for c in names])
    return nan_to_null(raw.select(first, F.inline(cells)))


def clinical(spark: SparkSession, folder: str, cohorts: list[str]) -> tuple[dict[str, DataFrame], DataFrame] | None:
    """(cohort -> gene, sample, value; covariates), or None if any file is absent."""
    paths = {c: f"{folder}/{c}.csv" for c in cohorts}
    rest = f"{folder}/covariates.csv"
    if not all(exists(spark, p) for p in [*paths.values(), rest]):
        return None
    return {c: matrix_csv(spark, p) for c, p in paths.items()}, csv(spark, rest, CLINICAL)


def regulons(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, str]:
    """(edges, name of the network) from a local file; absent raises, nothing is fetched."""
    return csv(spark, path, EDGES), name


def interleaved(spark: SparkSession, path: str, value: str = "_AVG.Beta", p: str = "_Detection.PVal", probe: str = "probe", sep: str = "\t") -> DataFrame:
    """probe, sample, beta, pval of a table whose header lacks the first column's name and
    whose columns pair values and p-values by suffix."""
    head = spark.read.text(path).first().value.split(sep)
    body = ", ".join(f"`{c}` string" for c in [probe, *head])
    raw = spark.read.option("sep", sep).schema(body).csv(path).filter(F.col(probe) != head[0])  # the header line, one field short
    names = [c[: -len(value)] for c in head if c.endswith(value) and c[: -len(value)] + p in head]
    cells = F.array(*[F.struct(F.lit(n).alias("sample"), number(F.col(f"`{n}{value}`")).alias("beta"), number(F.col(f"`{n}{p}`")).alias("pval")) for n in names])
    return raw.select(probe, F.inline(cells))


def sheet(path: str, sheet_name: str, skip: int, columns: list[str], spark: SparkSession) -> DataFrame:
    """Fixed columns of a spreadsheet from a row on; needs openpyxl on the driver."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet_name, skiprows=skip, header=None, names=columns, dtype=str))
