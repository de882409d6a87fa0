"""A training-data pipeline of five stages; each works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, of the same columns; the last one returns
what to train on: the documents with their rates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import decontam, mixing, near_text, secret_scan, toxicity
from sievewright.llm.common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose noisy-or score is one half or more; learned from the labels of these documents.

    Null and empty texts have the score of the model's leak; a score of exactly one half goes; repeated rows are judged
    alike; an empty table gives an empty one. Without labels of both kinds all documents have one score.
    """
    model = toxicity.fitted(docs, _table(spark, sf_dir, "labels"), "toxic")
    return toxicity.not_toxic(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of five-word Jaccard similarity 0.8 or more.

    Texts without words are copies of one another; rows of one id become one; rows without an id all stay.
    """
    return near_text.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of the benchmark out of texts; drop documents that are mostly such passages.

    Null and empty texts stay as they are; items without an id or without words cut nothing; repeated items cut once.
    """
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; null and empty texts, and all rows, stay."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add n_tokens, domain, rate and copies, so that languages get equal shares of the tokens; the labelled rows teach them.

    Columns of these names give way. All rows stay, those with null or repeated ids too; texts without words keep rate 1.
    """
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain")).join(labels, "id")
    return mixing.with_rates(docs, labelled)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]

#: Models and fingerprints are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
