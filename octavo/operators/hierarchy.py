"""Which nodes have which children, as bit masks, and what whole families of siblings merge to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.functions import encoding, keys


def with_ancestors(counts: DataFrame) -> DataFrame:
    """(node_key, n) with every missing ancestor as a node of no points."""
    prefixes = F.transform(
        F.sequence(F.lit(1), F.length("node_key")), lambda k: F.substring(F.col("node_key"), F.lit(1), k)
    )
    every = counts.select(
        F.explode(prefixes).alias("ancestor"), "node_key", "n"
    ).select(F.col("ancestor").alias("node_key"), F.when(F.col("ancestor") == F.col("node_key"), F.col("n")).otherwise(0).alias("n"))
    return every.groupBy("node_key").agg(F.sum("n").alias("n"))


def child_masks(nodes: DataFrame) -> DataFrame:
    """(node_key, mask) of every parent: bit d is set where child d exists."""
    children = nodes.where(keys.key_level(F.col("node_key")) > 0)
    bit = F.expr("shiftleft(1, cast(right(node_key, 1) as int))")
    return children.groupBy(keys.parent_key(F.col("node_key")).alias("node_key")).agg(F.bit_or(bit).alias("mask"))


def hierarchy_index(counts: DataFrame, ancestors: bool = True) -> DataFrame:
    """node_key, mask, n, count_code; written in the order of key length and key."""
    nodes = with_ancestors(counts) if ancestors else counts.select("node_key", "n")
    masked = nodes.join(child_masks(nodes), "node_key", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    return masked.select("node_key", "mask", "n", encoding.count_code(F.col("n")).alias("count_code"))


def index_bytes(index: DataFrame, counts: bool = True) -> bytes:
    """The index file: for each node by (length, key) its mask, and with counts its count code."""
    rows = index.orderBy(F.length("node_key"), "node_key").select("mask", "count_code").toLocalIterator()
    return b"".join(bytes([r.mask, r.count_code]) if counts else bytes([r.mask]) for r in rows)


def index_of_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """(node_key, mask) from names <level><key>.bin; other names are skipped."""
    named = paths.select(keys.key_of_file(F.col(path)).alias("node_key"), F.lit(0).alias("n")).where("node_key <> ''")
    return hierarchy_index(named.distinct(), ancestors=False).select("node_key", "mask")


def sibling_families(nodes: DataFrame) -> DataFrame:
    """parent_key, level (of the children), mask, merged, left_bottom, right_top.

    A family of all eight merges to its parent's cube, named by its first and last child.
    """
    masks = child_masks(nodes).withColumnRenamed("node_key", "parent_key")
    merged = F.col("mask") == 255
    return masks.select(
        "parent_key",
        F.length("parent_key").alias("level"),
        "mask",
        merged.alias("merged"),
        F.when(merged, F.concat("parent_key", F.lit("0"))).alias("left_bottom"),
        F.when(merged, F.concat("parent_key", F.lit("7"))).alias("right_top"),
    )
