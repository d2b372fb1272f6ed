"""Token counts of documents in flat token files that have no index, by a separator scan.

A flat file is nothing but ids, one document after another, each closed by an end id; it is kept as a
table of blocks (file, block, ids) of a fixed number of ids, as a large file is read by ranges. Blocks
know nothing of documents:

1. Every block is searched for end ids at once (one vectorised comparison), on its own. It yields the
   lengths of the documents that lie inside it, and a summary: ids, end ids, ids before the first and
   after the last end.
2. A prefix scan over the summaries of a file, in block order, gives each block the number of
   documents closed before it and the ids of the document that runs into it, over however many blocks
   without an end. Summaries are a few numbers a block.
3. The first document of a block is stitched to what runs into it; ids after a file's last end are
   a document that is not closed.

write_flat() makes such files from documents, with a manifest (file, ordinal, id) so that counts can
be told by document.

The end id is the first id beyond the tokenizer's vocabulary, so no text can hold it, whatever the text
says (also where it spells the tokenizer's own end mark); an end id inside the vocabulary is refused
before anything is written. Ids take two bytes where the end id fits in two, else four.

Cases: a null or empty text is a document of no ids and its end (count 0); a null id is kept; equal
rows each are a document; a file without ends is one open document; no rows give no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octavo.llm.tokens import WordTokenizer, default_path, vocabulary_size
from octavo.plans.tables import materialize

BLOCK_IDS = 1 << 16


def _width(end_id: int) -> int:
    """Bytes of an id in files with that end id, which is above all others."""
    return 2 if end_id < 1 << 16 else 4


def write_flat(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    end_id: int | None = None,
    block_ids: int = BLOCK_IDS,
    tokenizer: str | None = None,
) -> DataFrame:
    """(file, block, ids, first, members): blocks of flat token files, one file for each input partition.

    first and members are the manifest: the ordinal of the first document that begins in the block
    and the ids of the documents that do. flat_blocks() and manifest() take the two apart.
    """
    path = tokenizer or default_path("word_bpe_49k.json")
    least = vocabulary_size(path)
    end_id = least if end_id is None else end_id
    if end_id < least:
        raise ValueError(f"end id {end_id} is in the vocabulary, which ends before {least}")
    width = _width(end_id)
    end = end_id.to_bytes(width, "little")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.load(path)
        file, block, buffer, begun = TaskContext.get().partitionId(), 0, bytearray(), 0
        members: list = []
        size = block_ids * width

        def cut(content: bytes, docs: list, first: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file], pa.int32()),
                    pa.array([block], pa.int64()),
                    pa.array([content], pa.binary()),
                    pa.array([first], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                ],
                names=["file", "block", "ids", "first", "members"],
            )

        for batch in batches:
            for doc, content in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(words.encode(content.as_py() or ""), dtype="<u4")
                members.append(doc.as_py())
                buffer += ids.astype(f"<u{width}").tobytes() + end
                while len(buffer) >= size:
                    yield cut(bytes(buffer[:size]), members, begun)
                    begun, members, block = begun + len(members), [], block + 1
                    del buffer[:size]
        if buffer or members:
            yield cut(bytes(buffer), members, begun)

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(written, "file int, block long, ids binary, first long, members array<long>")


def flat_blocks(written: DataFrame) -> DataFrame:
    return written.select("file", "block", "ids")


def manifest(written: DataFrame) -> DataFrame:
    """(file, ordinal, doc_id)."""
    return written.select("file", "first", F.posexplode("members").alias("k", "doc_id")).select(
        "file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id"
    )


def scan_separators(blocks: DataFrame, end_id: int) -> DataFrame:
    """(file, ordinal, n_tokens, closed): one row per document of each flat file, ends not counted."""
    dtype = f"<u{_width(end_id)}"

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [np.flatnonzero(np.frombuffer(x, dtype=dtype) == end_id) for x in batch.column(2).to_pylist()]
            sizes = [len(x) // int(dtype[-1]) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(e) for e in ends], pa.int64()),
                    pa.array([int(e[0]) if len(e) else n for e, n in zip(ends, sizes, strict=True)], pa.int64()),
                    pa.array([n - int(e[-1]) - 1 if len(e) else n for e, n in zip(ends, sizes, strict=True)], pa.int64()),
                    pa.array([np.diff(e) - 1 for e in ends], pa.list_(pa.int64())),
                ],
                names=["file", "block", "ends", "head", "tail", "inner"],
            )

    found = materialize(
        blocks.mapInArrow(searched, "file int, block long, ends long, head long, tail long, inner array<long>"), "separators"
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(before)
    scanned = (
        found.select("file", "block", "ends", "tail")
        .withColumn("closed_before", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("run", F.coalesce(runs, F.lit(0)))
        .withColumn("last", F.lead("block").over(order).isNull())
    )
    in_run = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        scanned.withColumn("opens", F.lag("tail").over(order))
        .withColumn("in_run", F.coalesce(F.sum("tail").over(in_run), F.lit(0)))
        .withColumn("run_opens", F.coalesce(F.first("opens").over(Window.partitionBy("file", "run").orderBy("block")), F.lit(0)))
        .select("file", "block", "closed_before", "last", (F.col("in_run") + F.col("run_opens")).alias("carry"))
    )
    joined = found.join(carried, ["file", "block"])
    first = joined.where("ends > 0").select(
        "file", F.col("closed_before").alias("ordinal"), (F.col("carry") + F.col("head")).alias("n_tokens"), F.lit(True).alias("closed")
    )
    inner = joined.select("file", "closed_before", F.posexplode("inner").alias("k", "n_tokens")).select(
        "file", (F.col("closed_before") + F.col("k") + 1).alias("ordinal"), "n_tokens", F.lit(True).alias("closed")
    )
    left = F.col("tail") + F.when(F.col("ends") > 0, 0).otherwise(F.col("carry"))
    open_ = joined.where("last").where(left > 0).select(
        "file", (F.col("closed_before") + F.col("ends")).alias("ordinal"), left.alias("n_tokens"), F.lit(False).alias("closed")
    )
    return first.union(inner).union(open_)


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, end_id: int | None = None
) -> DataFrame:
    """doc_id, n_tokens, file, ordinal: flat files written from the documents, scanned and told by document."""
    path = default_path("word_bpe_49k.json")
    end_id = vocabulary_size(path) if end_id is None else end_id
    written = materialize(write_flat(docs, id_col, text, end_id, block_ids, path), "flat-tokens")
    counted = scan_separators(flat_blocks(written), end_id).where("closed")
    return manifest(written).join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
