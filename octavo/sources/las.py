"""LAS files: headers, variable records and points of formats 0 and 1.

Offsets are those of the public LAS specification, versions 1.0 to 1.4. The data source ``las`` plans
one input partition for a range of records, so a large file is read by many tasks. Files are opened by
their address on any file system that pyarrow knows, and only the bytes that are needed are read: a header's,
those before the first point for variable records, and a range's.

Cases: a file without points gives no rows; a file shorter than its header says fails; a file that is no
LAS file, or has another point format where points are read, is refused by name.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from octavo.sources.files import open_fs

#: Bytes that hold every header; records of an input partition.
HEADER_BYTES = 375
RECORDS = 1_000_000
FORMATS = (0, 1)
POINTS = "x double, y double, z double, intensity int, r int, g int, b int"


@dataclass(frozen=True)
class Header:
    version: str
    header_size: int
    point_offset: int
    vlr_count: int
    format: int
    record_length: int
    points: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]


def parse_header(data: bytes) -> Header:
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    size, at, vlrs = struct.unpack_from("<HII", data, 94)
    fmt, length, points = struct.unpack_from("<BHI", data, 104)
    numbers = struct.unpack_from("<12d", data, 131)
    if not points and (major, minor) >= (1, 4) and len(data) >= 255:
        points = struct.unpack_from("<Q", data, 247)[0]
    extent = numbers[6:]
    return Header(
        f"{major}.{minor}", size, at, vlrs, fmt & 63, length, points,
        tuple(map(abs, numbers[:3])), numbers[3:6], extent[1::2], extent[::2],
    )


def parse_vlrs(data: bytes, header: Header) -> list[tuple[str, int, str, bytes]]:
    """(user, record id, description, content) of each variable-length record."""
    out, at = [], header.header_size
    for _ in range(header.vlr_count):
        _, user, number, size, text = struct.unpack_from("<H16sHH32s", data, at)
        clean = lambda b: b.split(b"\0")[0].decode("latin-1")
        out.append((clean(user), number, clean(text), data[at + 54 : at + 54 + size]))
        at += 54 + size
    return out


def decode_points(data: bytes, header: Header) -> pa.RecordBatch:
    """Points of whole records. Formats other than 0 and 1 are not supported."""
    if header.format not in FORMATS:
        raise NotImplementedError(f"LAS point format {header.format}; only {FORMATS} are read")
    kind = np.dtype(
        {"names": ["q", "intensity"], "formats": ["<3i4", "<u2"], "offsets": [0, 12], "itemsize": header.record_length}
    )
    rows = np.frombuffer(data, dtype=kind)
    places = rows["q"] * np.array(header.scale) + np.array(header.offset)
    zero = np.zeros(len(rows), dtype=np.int32)
    columns = [*places.T, rows["intensity"].astype(np.int32), zero, zero, zero]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(c)) for c in columns], names=["x", "y", "z", "intensity", "r", "g", "b"]
    )


def list_files(path: str, suffix: str = ".las") -> list[str]:
    """Addresses of the files under a path, at any depth, whose names end in the suffix, or of the one file there."""
    from pyarrow.fs import FileSelector, FileType

    fs, at = open_fs(path)
    if fs.get_file_info(at).type == FileType.File:
        return [path]
    base = path.rstrip("/")
    found = [f.path for f in fs.get_file_info(FileSelector(at, recursive=True)) if f.type == FileType.File]
    return sorted(base + f[len(at.rstrip("/")) :] for f in found if f.lower().endswith(suffix))


def read_range(path: str, first: int, size: int) -> bytes:
    """So many bytes of a file from a place on, fewer where it ends before."""
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        return f.read_at(max(0, min(size, f.size() - first)), first)


def encode_file(q: np.ndarray, intensity: np.ndarray, scale, offset, vlrs=(), point_format: int = 0) -> bytes:
    """A LAS 1.2 file of points given as whole numbers of scale from offset; vlrs are (user, record id, description, content)."""
    length = {0: 20, 1: 28}[point_format]
    body = b"".join(struct.pack("<H16sHH32s", 0, u.encode(), n, len(c), t.encode()) + c for u, n, t, c in vlrs)
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HII", head, 94, 227, 227 + len(body), len(vlrs))
    struct.pack_into("<BHI", head, 104, point_format, length, len(q))
    xyz = q * np.abs(np.array(scale)) + np.array(offset)
    low, high = (xyz.min(axis=0), xyz.max(axis=0)) if len(q) else (np.zeros(3), np.zeros(3))
    struct.pack_into("<12d", head, 131, *scale, *offset, *np.column_stack([high, low]).ravel())
    rows = np.zeros(len(q), dtype=np.dtype({"names": ["q", "i"], "formats": ["<3i4", "<u2"], "offsets": [0, 12], "itemsize": length}))
    rows["q"], rows["i"] = q, intensity
    return bytes(head) + body + rows.tobytes()


@dataclass
class RecordRange(InputPartition):
    path: str
    first: int
    count: int

    def __init__(self, path: str, first: int, count: int):
        super().__init__(None)
        self.path, self.first, self.count = path, first, count


class LasReader(DataSourceReader):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records

    def partitions(self):
        out = []
        for path in list_files(self.path):
            header = parse_header(read_range(path, 0, HEADER_BYTES))
            out += [
                RecordRange(path, i, min(self.records, header.points - i)) for i in range(0, header.points, self.records)
            ]
        return out

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        header = parse_header(read_range(partition.path, 0, HEADER_BYTES))
        fs, at = open_fs(partition.path)
        with fs.open_input_file(at) as f:
            f.seek(header.point_offset + partition.first * header.record_length)
            left = partition.count
            while left:
                n = min(left, 1 << 16)
                data = f.read(n * header.record_length)
                if len(data) < n * header.record_length:
                    raise ValueError(f"{partition.path} ends before its last record")
                yield decode_points(data, header)
                left -= n


class LasDataSource(DataSource):
    """spark.read.format("las").option("records", n).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> LasReader:
        return LasReader(self.options["path"], int(self.options.get("records", RECORDS)))


def read_las(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    spark.dataSource.register(LasDataSource)
    return spark.read.format("las").option("records", records).load(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path of each file, a task for some; contents are not read."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.[lL][aA][sS]").option("recursiveFileLookup", "true")
    return read.load(path).select("path")


def las_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, version, format, points, bounds and scales, ready for cloud.merge_headers."""
    numbers = [f"{p}{a}" for p in "luso" for a in "xyz"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [parse_header(read_range(p, 0, HEADER_BYTES)) for p in batch.column(0).to_pylist()]
            rows = [(h.version, h.format, h.points, *h.low, *h.high, *h.scale, *h.offset) for h in heads]
            kinds = [pa.string(), pa.int32(), pa.int64()] + [pa.float64()] * 12
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 15
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["path", "version", "format", "points", *numbers],
            )

    schema = "path string, version string, format int, points long, " + ", ".join(f"{n} double" for n in numbers)
    return _files(spark, path).mapInArrow(parse, schema)


def las_vlrs(spark: SparkSession, path: str) -> DataFrame:
    """(path, user, record_id, description, content) of all variable-length records."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                header = parse_header(read_range(path, 0, HEADER_BYTES))
                rows += [(path, *v) for v in parse_vlrs(read_range(path, 0, header.point_offset), header)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["path", "user", "record_id", "description", "content"],
            )

    return _files(spark, path).mapInArrow(parse, "path string, user string, record_id int, description string, content binary")
