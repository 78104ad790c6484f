"""From raw documents to a training set of token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import line_dedup as lines
from tessera.llm import mixing as mixes
from tessera.llm import near_dup
from tessera.llm import pieces
from tessera.llm import toxicity as tox
from tessera.llm.common import staged


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go; the labels teach it what is toxic."""
    model = tox.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = tox.score_documents(docs, model)
    return scored.filter("tox_score < 0.5").select(*[f"`{c}`" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of five words or more are deleted from the texts."""
    return lines.dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest doc_id.

    Groups are of the texts as they come, and of the documents before line_dedup cut the
    lines that copies share, which would leave stumps of them."""
    return near_dup.dedup_documents(docs, k=5, percent=80, as_read=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, up to twice, so that the sources have their shares of the words."""
    return mixes.mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, n_tokens."""
    return pieces.encode_documents(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: A trained score decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
