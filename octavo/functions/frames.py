"""Requests and answers of the serving interface.

A request is a text: the path and query of a point get, or the JSON of a message for one row or for the
children of a node. answer() takes a table of requests to the rows of a blob table by joins on their keys.

Cases: a request that says nothing known, a null one, and one for a row that is not there have no answer;
a request that is asked twice is answered twice; a message's answer is a frame, a get's the plain bytes.
"""

from __future__ import annotations

import gzip
import json

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameters of a request in the order in which they are looked for, and the qualifier each names.
PARAMETERS = (("lasName", "las"), ("binName", "bin"), ("hrcName", "hrc"), ("jsName", "js"))


def frame(row: str, qualifier: str, payload: bytes) -> bytes:
    """A type byte, the length of the name, "row.qualifier" and the payload in gzip."""
    name = f"{row}.{qualifier}".encode()
    if len(name) > 255:
        raise ValueError("the name is longer than 255 bytes")
    return bytes([1, len(name)]) + name + gzip.compress(payload, mtime=0)


def unframe(data: bytes) -> tuple[str, bytes]:
    n = data[1]
    return data[2 : 2 + n].decode(), gzip.decompress(data[2 + n :])


def query_map(query: Column) -> Column:
    """Parameters of a query string, not URL-decoded."""
    return F.str_to_map(query, F.lit("&"), F.lit("="))


def parse_request(path: str) -> tuple[str, str, str]:
    """(table, qualifier, row) of /pointCloudData/<table>?<parameter>=<row>."""
    head, _, query = path.partition("?")
    parts = head.strip("/").split("/")
    if len(parts) != 2 or parts[0] != "pointCloudData":
        raise ValueError(f"no such path: {head}")
    given = dict(p.partition("=")[::2] for p in query.split("&"))
    for parameter, qualifier in PARAMETERS:
        if parameter in given:
            return parts[1], qualifier, given[parameter]
    raise ValueError("none of " + ", ".join(p for p, _ in PARAMETERS))


def parse_message(text: str) -> tuple[str, str, str, str]:
    """(table, qualifier, row or parent key, digits) of a message; digits are empty for a message that names a row."""
    said = json.loads(text)
    if "dataName" in said:
        return said["tableName"], said["dataType"], said["dataName"], ""
    return said["tableName"], said["dataType"], said["parentNodeKey"], said["childNodeFilterStr"]


def asked_rows(requests: DataFrame) -> DataFrame:
    """(request, row_key, qualifier, framed): the rows that each text in column request asks for."""
    text = F.col("request")
    query = F.str_to_map(F.regexp_extract(text, r"^/pointCloudData/[^/?]+\?(.*)$", 1), F.lit("&"), F.lit("="))
    row = F.coalesce(*[query[p] for p, _ in PARAMETERS])
    named = F.coalesce(*[F.when(query[p].isNotNull(), F.lit(q)) for p, q in PARAMETERS])
    plain = requests.where(text.startswith("/")).select("request", row.alias("row_key"), named.alias("qualifier"), F.lit(False).alias("framed"))
    said = lambda key: F.get_json_object(text, f"$.{key}")
    messages = requests.where(text.startswith("{"))
    one = messages.select("request", said("dataName").alias("row_key"), said("dataType").alias("qualifier"), F.lit(True).alias("framed"))
    parent = said("parentNodeKey")
    digits = F.array_distinct(F.regexp_extract_all(said("childNodeFilterStr"), F.lit("[0-7]"), F.lit(0)))
    many = messages.where(said("dataName").isNull() & parent.isNotNull()).select("request", parent.alias("parent"), said("dataType").alias("qualifier"), F.explode(digits).alias("digit"))
    children = many.select("request", F.concat(F.length("parent").cast("string"), "parent", "digit").alias("row_key"), "qualifier", F.lit(True).alias("framed"))
    return plain.union(one).union(children).where("row_key IS NOT NULL AND qualifier IS NOT NULL")


def answer(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, name, part, payload, framed, frame) for every row of a blob table that a request asks for.

    frame is what goes back: the type, the name and the payload in gzip, or null where the payload itself does.
    """
    found = rows.join(asked_rows(requests), ["row_key", "qualifier"]).select("request", "row_key", "qualifier", "part", "value", "framed")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            whole = [frame(r, q, v) if framed else None for _, r, q, _, v, framed in zip(*columns, strict=True)]
            names = pa.array([f"{r}.{q}" for r, q in zip(columns[1], columns[2], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), names, batch.column(3), batch.column(4), batch.column(5), pa.array(whole, pa.binary())],
                names=["request", "name", "part", "payload", "framed", "frame"],
            )

    return found.mapInArrow(made, "request string, name string, part int, payload binary, framed boolean, frame binary")
