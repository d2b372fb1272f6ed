"""Queries over the corpus operators with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octavo.llm import gumbel, jaccard, neardup, packing, quality, secrets, separators, topk, toxicity, warc
from octavo.plans.tables import bound_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_read(spark, sf_dir, "documents"), width=3, num=90).drop("named")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon).withColumn("held_out", toxicity.in_fold(F.col("doc_id")))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_read(spark, sf_dir, "documents"))


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel.sample_segmentations(_read(spark, sf_dir, "documents"), k=2, packed=True)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(_read(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_toxicity": op2_toxicity,
        "op3_embedding_near_dedup": op3_embedding_near_dedup,
        "op4_warc": op4_warc,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_secret_scans": op6_secret_scans,
        "op7_sentencepiece_sampling": op7_sentencepiece_sampling,
        "op8_packing": op8_packing,
        "op9_token_counts": op9_token_counts,
        "op10_exact_top_k": op10_exact_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": jaccard.oracle_sql(3, 90),
        "op3_embedding_near_dedup": neardup.oracle_sql(),
        "op4_warc": warc.oracle_sql(),
        "op6_secret_scans": secrets.oracle_sql(),
        "op10_exact_top_k": topk.oracle_sql(100, 10),
    }
