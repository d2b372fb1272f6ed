"""Tables that cut lineage, kept where every executor and the driver can read them."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where that is unset, a session whose executors are threads of the driver gets a folder of its own; a
    cluster is refused, since a folder of one machine would lose the others' files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="octavo-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/octavo/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    A lost executor costs a reread of files, not a recomputation. The table lives until discard()
    or the end of the session.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._octavo_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df._octavo_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written[:] = [x for x in _written if x[1] != path]


def _sweep() -> None:
    for spark, path in list(_written):
        try:
            remove(spark, path)
        except Exception:  # the session may have ended
            return


def repeat_rows(df: DataFrame, n: str, run: int = 1 << 16) -> DataFrame:
    """Each row as often as its column n says, which is dropped; in runs, so that no array is longer than run."""
    runs = df.withColumn("octavo_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / run))))
    left = F.least(F.lit(run).cast("long"), F.col(n) - F.col("octavo_run") * run)
    return runs.where(F.col(n) > 0).withColumn("octavo_run", F.explode(F.array_repeat(F.lit(0), left.cast("int")))).drop("octavo_run", n)


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch, so that a Python task's memory does not
    depend on how long its rows are. A lower limit that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(str(spark.conf.get(key)).rstrip("bB"))
    except Exception:  # written with a unit, or unknown to this version
        now = 1 << 62
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def tidy() -> None:
    """Gives memory that a worker process has freed back to the system; called where a task's rows end."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
