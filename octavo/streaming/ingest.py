"""Streaming ingest of text points at continuous levels of detail.

A point's node depends on no other point, so each batch's nodes are packed on their own and kept as
parts keyed by the batch; a batch that runs again replaces its own parts. The grid filter has no
streaming form, since a later point may take an earlier one's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from octavo.operators import lod
from octavo.operators.cloud import SCALE, Cloud
from octavo.sources import store
from octavo.sources.points import SCHEMA


def ingest(
    spark: SparkSession, source: str, target: str, checkpoint: str, cloud: Cloud, levels: int, seed: int = 0, scale: float = SCALE
) -> StreamingQuery:
    """Starts a query that takes all files there are and ends; parts go to target/batch=<id>."""
    points = spark.readStream.schema(SCHEMA).option("sep", " ").csv(source).select("x", "y", "z", "r", "g", "b").na.drop()

    def save(batch: DataFrame, batch_id: int) -> None:
        leveled = lod.with_node_keys(lod.clod_levels(batch, levels, 3, seed=seed + batch_id), cloud.corner, cloud.side, levels)
        records = store.encode_points(leveled, cloud.corner, cloud.side, scale).persist()
        counts = records.groupBy("node_key").agg(F.count("*").alias("n"))
        store.as_table(store.node_blobs(records, counts)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        records.unpersist()

    return (
        points.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """All parts, with the batch that brought each."""
    return spark.read.parquet(target)
