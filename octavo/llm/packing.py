"""Hierarchical multi-length packing of token documents.

Each input partition is packed on its own as it streams through, so nothing is shuffled, no key
groups rows and memory is one buffer of ids, however long or uneven the documents are:

1. A document's ids are cut into full windows of the longest context; what is left over is routed to
   the shortest tier (context size) that holds it.
2. When the buffer is full, tiers are packed from the longest down. A remainder opens a window of its
   tier; the gap is filled with the largest waiting remainders of the shorter tiers that fit, and
   where none fits, with a part cut from a longer one. Every window then is full.
3. What stays at the end of a partition closes in windows of powers of two.

Tiers are powers of two, so no sequence is padded. Sequences of one tier are dealt to step groups of
STEP_TOKENS tokens, so that every step costs the same: in a partition all groups but the last of each
tier hold exactly so many. A group has sequences of one tier, and its number is no other group's.

A sequence id is the partition's number and a count within it; a task that runs again gives the same
ids, since it reads the same rows in the same order.

Cases: a null text is empty and gives one piece, the end mark; a null id is kept; equal rows each are
packed; other columns of the input are not read; no rows give no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.llm.tokens import WordTokenizer, default_path
from octavo.plans.tables import tidy

TIERS = (256, 512, 1024, 2048)
#: Ids that wait in a partition before they are packed, and tokens of one step group.
BUFFER_IDS = 1 << 20
STEP_TOKENS = 1 << 16

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier int, step_group long"
)


class _Part:
    """A document's ids from start on, not yet placed."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: memoryview, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[_Part, _Part]:
        return (
            _Part(self.doc, self.start, self.ids[: 4 * n], self.total),
            _Part(self.doc, self.start + n, self.ids[4 * n :], self.total),
        )


class _Waiting:
    """Parts by length; ties leave in the order of arrival, last first."""

    def __init__(self):
        self.lengths: list[int] = []
        self.parts: list[_Part] = []
        self.ids = 0

    def add(self, part: _Part) -> None:
        at = bisect.bisect_right(self.lengths, len(part))
        self.lengths.insert(at, len(part))
        self.parts.insert(at, part)
        self.ids += len(part)

    def largest(self, most: int) -> _Part | None:
        """Takes the longest part of at most so many ids."""
        at = bisect.bisect_right(self.lengths, most) - 1
        return self._take(at) if at >= 0 else None

    def shortest(self) -> _Part | None:
        return self._take(0) if self.parts else None

    def _take(self, at: int) -> _Part:
        self.ids -= self.lengths.pop(at)
        return self.parts.pop(at)


class Packer:
    """Packs a stream of documents; rows() gives the pieces placed so far."""

    def __init__(self, first_id: int, tiers=TIERS, buffer_ids: int = BUFFER_IDS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.buffer_ids, self.step_tokens = sorted(tiers), buffer_ids, step_tokens
        self.longest = self.tiers[-1]
        self.next_id = first_id
        self.waiting = _Waiting()
        #: For each tier its open step group and the tokens that this still takes.
        self.next_group = first_id
        self.steps = {t: (0, 0) for t in self.tiers}
        self.out: list[list] = [[] for _ in range(9)]

    def add(self, doc, ids: bytes) -> None:
        whole, total = memoryview(ids), len(ids) // 4
        start = 0
        while total - start >= self.longest:
            self._emit([_Part(doc, start, whole[4 * start : 4 * (start + self.longest)], total)], self.longest)
            start += self.longest
        if start < total:
            self.waiting.add(_Part(doc, start, whole[4 * start :], total))
        if self.waiting.ids >= self.buffer_ids:
            self.pack()

    def pack(self) -> None:
        """Fills windows from the longest tier down while they can be filled."""
        waiting, shorter = self.waiting, [0, *self.tiers]
        for tier, below in zip(reversed(self.tiers), reversed(shorter[:-1]), strict=True):
            while waiting.lengths and waiting.lengths[-1] > below and waiting.ids >= tier:
                window, gap = [], tier
                while gap:
                    part = waiting.largest(gap)
                    if part is None:
                        part, rest = waiting.shortest().cut(gap)
                        waiting.add(rest)
                    window.append(part)
                    gap -= len(part)
                self._emit(window, tier)

    def close(self) -> None:
        """Packs the rest in windows of powers of two."""
        self.pack()
        parts = self.waiting.parts[::-1]
        left = self.waiting.ids
        self.waiting = _Waiting()
        while left:
            size = min(self.longest, 1 << (left.bit_length() - 1))
            left -= size
            window, gap = [], size
            while gap:
                part = parts.pop(0)
                if len(part) > gap:
                    part, rest = part.cut(gap)
                    parts.insert(0, rest)
                window.append(part)
                gap -= len(part)
            self._emit(window, size)

    def _emit(self, window: list[_Part], size: int) -> None:
        seq, self.next_id = self.next_id, self.next_id + 1
        tier = next(t for t in self.tiers if size <= t)
        group, room = self.steps[tier]
        if room < size:
            group, room, self.next_group = self.next_group, max(self.step_tokens, size), self.next_group + 1
        self.steps[tier] = group, room - size
        offset = 0
        for p in window:
            row = (p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, seq, offset, tier, group)
            for column, value in zip(self.out, row, strict=True):
                column.append(value)
            offset += len(p)

    def rows(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(x, type=t) for x, t in zip(self.out, kinds, strict=True)], names=names
        )
        self.out = [[] for _ in kinds]
        return batch


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    buffer_ids: int = BUFFER_IDS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece; pieces of a sequence follow one another from offset 0 without a gap."""
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    path = tokenizer or default_path("word_bpe_49k.json")
    end = end_id.to_bytes(4, "little")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.load(path)
        packer = Packer(TaskContext.get().partitionId() << 33, tiers, buffer_ids, step_tokens)
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, words.encode(content.as_py() or "") + end)
            yield packer.rows()
        packer.close()
        yield packer.rows()
        tidy()

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(packed, SCHEMA)
