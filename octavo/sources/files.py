"""Small whole files on any file system that Spark knows: documents, hierarchy indexes, listings.

Tasks that read or write files piece by piece open them by open_fs(), on any file system that pyarrow
knows by its address.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: An interim record is three little-endian doubles and three colour bytes.
INTERIM = np.dtype([("p", "<3f8"), ("c", "u1", 3)])


def open_fs(address: str):
    """(file system, path) of an address (file, hdfs, s3, gs) or of a path on this machine."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_bytes(spark: SparkSession, path: str, data: bytes, append: bool = False) -> None:
    """Writes a file from the driver; what is there is replaced, or kept in front with append."""
    if append and exists(spark, path):
        data = read_bytes(spark, path) + data
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(row.content)


def fresh_folder(spark: SparkSession, path: str) -> str:
    """Makes a folder, with those above it; its path."""
    fs, at = _fs(spark, path)
    fs.mkdirs(at)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str, recursive: bool = False) -> bool:
    """Whether something was deleted; a folder that is not empty needs recursive."""
    fs, at = _fs(spark, path)
    return fs.delete(at, recursive)


def list_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, length) of all files below a path whose names end in the suffix; contents are not read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
    return read.load(path).select("path", "length")


def write_interim(points: DataFrame, folder: str) -> int:
    """Writes interim records of x, y, z, r, g, b, a file for each batch; the number of files."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            rows = np.empty(batch.num_rows, dtype=INTERIM)
            rows["p"] = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            rows["c"] = np.column_stack([batch.column(i).to_numpy() for i in range(3, 6)])
            name = f"{uuid.uuid4().hex}.bin"
            with fs.open_output_stream(f"{at}/_{name}", compression=None) as out:
                out.write(rows.tobytes())
            fs.move(f"{at}/_{name}", f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    written = points.select("x", "y", "z", "r", "g", "b").dropna().mapInArrow(save, "name string")
    return written.count()


def read_interim(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, r, g, b of files of interim records."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = np.frombuffer(content, dtype=INTERIM)
                columns = [*rows["p"].T, *rows["c"].T.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=list("xyzrgb"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(decode, "x double, y double, z double, r int, g int, b int")
