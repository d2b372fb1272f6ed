"""WARC archives: write, normalise a monolithic gzip file to one member per record, read by index.

Archives are files in a folder that the driver and all executors share, on any file system that pyarrow
opens by its address (file, hdfs, s3, gs). A task gives its files names of their own, and a table
that Spark commits lists the files that count: what a lost or repeated task has left is never read.

1. write_archives: every page becomes a WARC record. Of pages with equal payloads the one with the
   largest page_id is a response and the others are revisits of it, which carry the payload's digest
   and length but no payload. An archive is one gzip stream over all its records (.warc.gz).
2. normalise: each archive is inflated once, front to back, and every record is compressed again as a
   gzip member of its own (.warc.gz); beside it a sidecar index (.idx) lists each member's offset, length,
   type and page. Neither the archive nor its index is ever held whole.
3. read_records: takes members out of a normalised archive by its index, one at a time, and checks the digest.

Equal payloads meet by their SHA-1: counts per digest are pre-aggregated before they are shuffled,
and only digests that occur twice or more are joined back, by broadcast up to BROADCAST_ROWS digests
and else by a shuffled join whose skewed keys Spark splits.

A record's id is made of its page and digest where a revisit may name it, else of its archive and place;
equal rows (same page_id and payload) that are the response are one record repeated, with one id.

Cases: a null html is the empty payload; a null url or page_id leaves its header out and reads back
null; a payload that only pages without id have is a response in each; equal rows that are the response each
are one; other columns are not read; no pages give no archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.plans.tables import discard, materialize, new_path, remove

#: Uncompressed bytes after which an archive is closed, and duplicate digests that are still broadcast.
ARCHIVE_BYTES = 16 << 20
BROADCAST_ROWS = 200_000
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

#: Tasks that normalise or read archives, at most.
MOST_TASKS = 10_000


def _open(address: str):
    """(file system, path) of an address or of a path on this machine."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))


def classify(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload (binary), digest (hex SHA-1) and rep: the page that the payload's revisits name."""
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    slim = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
    )
    repeated = materialize(
        slim.groupBy("digest").agg(F.max("page_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "warc-digests",
    )
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    return slim.join(repeated, "digest", "left")


def record(page_id, url, payload: bytes, digest: str, rep, place: str) -> bytes:
    """One WARC record; digest is base32, place names its archive and place there."""
    revisit = rep is not None and rep != page_id
    name = lambda i: uuid.uuid5(_SPACE, f"page:{i}:{digest}").urn
    own = uuid.uuid5(_SPACE, f"place:{place}").urn if revisit or page_id is None else name(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        clean = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {clean}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{name(rep)}>",
            f"X-Refers-To-Page-Id: {rep}",
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    body = http.encode() + (b"" if revisit else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    """Named fields of a header block, its first line under the empty name."""
    first, *rest = block.decode("utf-8", "surrogatepass").split("\r\n")
    return {"": first} | {k.lower(): v for k, _, v in (x.partition(": ") for x in rest if x)}


def write_archives(classified: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives into the folder as its rows are computed: (path, records), one row for each file."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        fs.create_dir(at, recursive=True)
        task, made = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0
        name, out, packer, size, records = "", None, None, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal out
            out.write(packer.flush())
            out.close()
            out = None
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page_id, url, payload, digest, rep in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    name, made, size, records = f"whole-{task}-{made:06d}.warc.gz", made + 1, 0, 0
                    out, packer = fs.open_output_stream(f"{at}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31)
                b32 = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                raw = record(page_id.as_py(), url.as_py(), payload.as_py(), b32, rep.as_py(), f"{name}:{records}")
                out.write(packer.compress(raw))
                size, records = size + len(raw), records + 1
                if size >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    return classified.select("page_id", "url", "payload", "digest", "rep").mapInArrow(written, "path string, records long")


class _Inflated:
    """Reads a gzip stream (read(n) gives bytes) front to back, inflating no more than is asked for and a block."""

    def __init__(self, source, block: int = 1 << 20):
        self.source, self.rest, self.block = source, b"", block
        self.stream, self.buffer = zlib.decompressobj(wbits=31), bytearray()

    def _more(self) -> bool:
        self.rest = self.rest or self.source.read(self.block)
        if not self.rest:
            return False
        if self.stream.eof:
            self.stream = zlib.decompressobj(wbits=31)
        self.buffer += self.stream.decompress(self.rest, self.block)
        self.rest = self.stream.unused_data if self.stream.eof else self.stream.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Takes what stands before the mark, and the mark; None at the end of the stream."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.buffer:
                    raise ValueError("a record is cut off")
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("a record is cut off")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def split_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of a gzip file of any number of members, given as a stream."""
    stream = _Inflated(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        named = headers(head)
        body = stream.take(int(named["content-length"]) + 4)
        yield named, head + b"\r\n\r\n" + body


def _dealt(files: DataFrame) -> DataFrame:
    """files, a task for each as far as MOST_TASKS go."""
    return files.repartition(max(1, min(MOST_TASKS, files.count())), "path")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive of (path) anew with a member for every record, and its index: (path, index)."""

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                stem = f"{path.rsplit('/', 1)[-1].removesuffix('.warc.gz').removeprefix('whole-')}-{uuid.uuid4().hex}"
                there, source = _open(path)
                offset = 0
                with (
                    there.open_input_stream(source, compression=None) as whole,
                    fs.open_output_stream(f"{at}/{stem}.warc.gz", compression=None) as out,
                    fs.open_output_stream(f"{at}/{stem}.idx", compression=None) as index,
                ):
                    for named, raw in split_records(whole):
                        member = gzip.compress(raw, LEVEL, mtime=0)
                        out.write(member)
                        index.write(f"{offset} {len(member)} {named['warc-type']} {named.get('x-page-id', '-')}\n".encode())
                        offset += len(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{stem}.warc.gz"]), pa.array([f"{folder}/{stem}.idx"])], names=["path", "index"]
                )

    return _dealt(archives.select("path")).mapInArrow(rewritten, "path string, index string")


def read_records(normalised: DataFrame) -> DataFrame:
    """One row per record: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    schema = (
        "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long"
    )
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    number = lambda x: None if x is None else int(x)

    def parsed(raw: bytes) -> tuple:
        head, _, body = raw.partition(b"\r\n\r\n")
        http, _, payload = body[:-4].partition(b"\r\n\r\n")
        named = headers(head)
        digest = named["warc-payload-digest"].removeprefix("sha1:")
        revisit = named["warc-type"] == "revisit"
        size = int(headers(http)["content-length"])
        if not revisit:
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                raise ValueError(f"record {named['warc-record-id']}: the payload does not match its digest")
        return (
            number(named.get("x-page-id")), named.get("warc-target-uri"), None if revisit else payload, size, digest,
            named["warc-type"], number(named.get("x-refers-to-page-id")),
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")]
            )

        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (fs, at), (there, listed) = _open(path), _open(index)
                rows, size = [], 0
                with fs.open_input_file(at) as members, there.open_input_stream(listed, compression=None) as lines:
                    for line in _lines(lines):
                        offset, length = map(int, line.split()[:2])
                        rows.append(parsed(gzip.decompress(members.read_at(length, offset))))
                        size += rows[-1][3]
                        if size >= ARCHIVE_BYTES // 4:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    return _dealt(normalised.select("path", "index")).mapInArrow(read, schema)


def _lines(stream, block: int = 1 << 16) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(block):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages to archives, normalises these and reads every record back, without the payloads.

    The archives as first written are deleted once they are normalised.
    """
    spark = pages.sparkSession
    first, second = new_path(spark, "warc-whole"), new_path(spark, "warc-members")
    whole = materialize(write_archives(classify(pages, id_col, url, html), first), "warc-archives")
    single = materialize(normalise(whole, second), "warc-normalised")
    discard(whole)
    remove(spark, first)
    return read_records(single).drop("payload", "url")


def oracle_sql() -> str:
    """DuckDB SQL for archive_round_trip(pages): five hex digits are four of base32."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    b32 = " || ".join(
        f"substr('{letters}', CAST((CAST('0x' || substr(s, {5 * g + 1}, 5) AS BIGINT) >> {k}) & 31 AS BIGINT) + 1, 1)"
        for g in range(8)
        for k in (15, 10, 5, 0)
    )
    return f"""
    WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS s FROM pages),
    r AS (SELECT s, max(page_id) AS rep, count(*) AS n FROM d GROUP BY s)
    SELECT page_id, bytes AS payload_bytes, {b32} AS payload_digest,
        CASE WHEN n > 1 AND rep IS DISTINCT FROM page_id AND rep IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n > 1 AND rep IS DISTINCT FROM page_id THEN rep END AS refers_to
    FROM d JOIN r USING (s)
    """
