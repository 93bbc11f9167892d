"""A training-corpus pipeline: each stage works on all that the one before it kept, written as Parquet between them.

The order, and each stage's decision: documents whose language is rejected go; one document of each group of near duplicates
stays; documents contaminated by the benchmark go; secrets are replaced by a mark; the rest is mixed to target weights.
All stages but the last return the columns of documents; the last adds shard, pass, position and partial.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantalume.llm import decontaminate, langid, mixing, neardup, secret_scan
from vantalume.llm._common import scratch
from vantalume.sources.paths import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every learned language, go; a missing language is filled in."""
    docs = docs.select(*COLUMNS)
    known = langid.identify(docs, langid.train(docs))
    return known.where(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8, the one with the least id stays."""
    return neardup.representatives(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words at least a twentieth lie in windows of the benchmark."""
    marked = decontaminate.mark(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.digest(marked).where(~F.col("contaminated")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span becomes a mark; the documents stay."""
    scanned = secret_scan.scan(docs.select(*COLUMNS))
    clean = secret_scan.redacted(F.col("text"), F.col("spans"))
    return scanned.withColumn("text", clean).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights, dealt to shards and shuffled there."""
    rows = mixing.Mix(docs.select(*COLUMNS)).rows()
    return rows.withColumn("n_chars", F.when(F.col("partial"), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: SQL can't express the language models and the seeded mixture; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with scratch(spark):  # a stage's own tables go when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
