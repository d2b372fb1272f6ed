"""Corpus pipeline over documents: quality, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is
written as Parquet and read again as the next stage's docs. Every stage but the last returns the
columns of documents.

Cases, for every stage: a null text is empty and stays null where the row is kept; a row with a null id is
decided like any other and is no copy of others; equal rows are decided alike, and one of those that
share an id stays (all, where their texts differ); columns beyond those of documents pass through, whatever
their names; a table without rows gives one. Stages that learn from labels keep all rows where there are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octavo.llm import jaccard, packing, quality, secrets, toxicity
from octavo.plans.tables import bound_batches, materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies (five words, 0.8)."""
    bound_batches(spark)
    return jaccard.keep_one(docs, width=5, num=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew."""
    spans = secrets.free_name(docs, "octavo_secrets")
    found = secrets.redact(secrets.find_secrets(docs, into=spans), spans=spans)
    counted = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", counted).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed."""
    bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_civil),
    ("near_duplicates", keep_distinct),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: the classifiers and the packing are not expressible; the tests run each stage against brute force.
ORACLE_SQL = None
