"""Points from text files and from the line item table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: The columns of a text cloud.
SCHEMA = StructType(
    [StructField(c, DoubleType()) for c in ("x", "y", "z")]
    + [StructField(c, IntegerType()) for c in ("intensity", "r", "g", "b")]
)


def read_text(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """x, y, z, r, g, b of space-separated text, a file or a folder with folders in it.

    The schema is given, so files are read once; intensity is not kept. Lines that do not parse are
    dropped, or with strict fail the job.
    """
    read = spark.read.schema(SCHEMA).option("sep", " ").option("recursiveFileLookup", "true")
    points = read.option("mode", "FAILFAST" if strict else "DROPMALFORMED").csv(path)
    return points.select("x", "y", "z", "r", "g", "b").na.drop()


def point_view(lineitem: DataFrame) -> DataFrame:
    """A cloud made of line items: quantity, price and ship day as places, keys as colours.

    u is a uniform number made of the keys, supplier the supplier's key.
    """
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    mixed = F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber") * 7
    return lineitem.select(
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / F.lit(2000.0)).alias("y"),
        (days / F.lit(50.0)).alias("z"),
        (F.col("l_linenumber") * 32).cast("int").alias("r"),
        (F.col("l_suppkey") % 256).cast("int").alias("g"),
        (F.col("l_partkey") % 256).cast("int").alias("b"),
        ((mixed % 10007) / F.lit(10007.0)).alias("u"),
        F.col("l_suppkey").alias("supplier"),
    )


def peek(points: DataFrame) -> dict[str, float]:
    """One point by name of its columns; empty for no points."""
    row = points.limit(1).collect()
    return row[0].asDict() if row else {}
