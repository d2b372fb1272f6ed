"""Exact top-k by inner product: a Voronoi join of query and data vectors, solved group by group.

Components become integers floor(1024 * x), so scores are exact and ties are real.

1. Pivots are centres of a bounded sample, about the root of the number of rows; every vector, query
   or not, belongs to the cell of its nearest pivot.
2. A query's floor is its k-th best score among the sample, so its k best of all are no lower. A grouped
   aggregation summarises each cell's queries: their number, radius, largest norm and lowest floor.
3. For a cell of queries with pivot c and radius r no score of a vector x exceeds c.x + r|x|, nor the
   largest norm times |x|. Where that is below the cell's floor, no query of the cell needs x. Cells that lie
   together form a group, of bounded bytes of queries; a cell with more is dealt to several. Of the
   numbers of groups that are possible the largest is taken that, by the sample, hardly adds copies.
4. A data vector is sent to those groups only of which a cell needs it. A group's data are dealt to
   chunks by a hash, and its queries go to each of its chunks.
5. A task holds its group's queries and their k best so far, and streams its chunk's data past them; each
   cell meets those rows alone that reach the lowest of its best. So memory is bounded by the
   group's queries, however many data there are.
6. The best k of the chunks are ranked for each query, ties to the smaller vec_id.

Pivots, summaries and bounds (at most PLAN_BYTES) are on the driver and travel with tasks; they are made
for at most PLANNED vector lengths, those with the most rows. Vectors of other lengths meet in one cell without
bounds, dealt to chunks in the same way.

Cases: a null or empty vector, or one that holds a null or non-finite component, takes no part; every
finite one does, however large: scores beyond 53 bits are summed in 64-bit and beyond that in Python's
integers, ranked exactly and given as the nearest long. Vectors meet vectors of their own length only;
a query's own rows (equal vec_id) are no candidates, other equal vectors are and tie; rows with
a null id take no part; fewer than k candidates give all; a repeated query row is one query; columns
other than id and vector are not read; no rows give no rows.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octavo.plans.tables import materialize

SCALE = 1024.0
SAMPLE = 4096
MOST_PIVOTS = 1024
PLANNED = 8
#: Bytes of pivots and samples in all; of a group's queries; of a chunk's data, about.
PLAN_BYTES, GROUP_BYTES, CHUNK_BYTES = 16 << 20, 16 << 20, 16 << 20
#: Copies of the data that more groups may cost over the fewest.
SLACK = 1.1
#: Data rows that meet the queries at once.
BLOCK = 4096

LARGEST, LEAST = (1 << 63) - 1, -(1 << 63)


def usable_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, d, v): vectors as little-endian doubles, without those that take no part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, out = [], [], []
            for i, v in zip(batch.column(0), batch.column(1), strict=True):
                if not i.is_valid or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                if len(x) and np.isfinite(x).all():
                    ids.append(i.as_py())
                    size.append(len(x))
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(out, pa.binary())], names=["id", "d", "v"]
            )

    slim = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("x"))
    return slim.mapInArrow(read, "id long, d int, v binary")


def _matrix(column, d: int) -> np.ndarray:
    """Scaled vectors, whole numbers in doubles; infinite where a component over 2**1013 leaves them."""
    raw = b"".join(column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else column)
    with np.errstate(over="ignore"):
        return np.floor(np.frombuffer(raw, dtype="<f8").reshape(-1, d) * SCALE)


def _whole(raw: bytes) -> list[int]:
    """Scaled components of one vector as Python integers, exact at any size."""
    return [math.floor(x * SCALE) if abs(x) < 2.0**900 else int(x) * 1024 for x in np.frombuffer(raw, dtype="<f8").tolist()]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def exact_scores(q: np.ndarray, x: np.ndarray, q_raw: list[bytes], x_raw: list[bytes]) -> np.ndarray:
    """Inner products of scaled vectors: doubles where all are whole in them, else 64-bit or Python integers."""
    most = _norms(q).max(initial=0) * _norms(x).max(initial=0)
    if most < 2.0**52:
        return q @ x.T
    if most < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    a, b = ([_whole(r) for r in raw] for raw in (q_raw, x_raw))
    out = np.empty((len(a), len(b)), dtype=object)
    for i, u in enumerate(a):
        for j, w in enumerate(b):
            out[i, j] = sum(s * t for s, t in zip(u, w, strict=True))
    return out


def _order_key(score: int) -> bytes:
    """Bytes that order scores beyond a long: those below all longs, all longs alike, those above."""
    if LEAST <= score <= LARGEST:
        return b"\x80"
    size = (abs(score).bit_length() + 7) // 8
    if score > 0:
        return b"\x81" + size.to_bytes(4, "big") + score.to_bytes(size, "big")
    return b"\x7f" + bytes(255 - b for b in size.to_bytes(4, "big") + (-score).to_bytes(size, "big"))


class Plan:
    """Pivots, sample, cells' summaries and groups of one vector length."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, rows: int):
        self.ids, self.sample, self.rows = ids, sample, rows
        self.d = sample.shape[1]
        self.pivots = self._centres(min(MOST_PIVOTS, max(1, math.isqrt(rows) // 4), max(1, len(sample) // 8)))
        n = len(self.pivots)
        self.queries, self.radius, self.norm = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
        self.floor = np.full(n, -np.inf)
        self.group, self.parts, self.chunks = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64), np.ones(1, dtype=np.int64)

    def _centres(self, n: int) -> np.ndarray:
        """Sample vectors, moved twice to the means of their cells."""
        finite = self.sample[np.isfinite(self.sample).all(axis=1) & (np.abs(self.sample) < 1e150).all(axis=1)]
        if not len(finite):
            return np.zeros((1, self.d))
        centres = np.unique(finite[:: max(1, len(finite) // n)][:n], axis=0)
        for _ in range(2):
            cell = ((centres**2).sum(axis=1) - 2 * (finite @ centres.T)).argmin(axis=1)
            counts = np.bincount(cell, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, cell, finite)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        return centres

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector and its distance to the pivot."""
        cell = np.nan_to_num((self.pivots**2).sum(axis=1) - 2 * (x @ self.pivots.T), nan=0.0).argmin(axis=1)
        far = _norms(x - self.pivots[cell])
        return cell, np.where(np.isnan(far), np.inf, far)

    def floors(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """A score that the k best of each query reach, by the sample; rounding is taken off."""
        if len(self.ids) <= k:
            return np.full(len(q), -np.inf)
        scores = np.where(ids[:, None] == self.ids[None, :], -np.inf, q @ self.sample.T)
        low = np.partition(np.nan_to_num(scores, nan=-np.inf, posinf=-np.inf), -k, axis=1)[:, -k]
        return low - np.abs(low) * 1e-9 - _norms(q) * _norms(self.sample).max(initial=0) * (self.d + 4) * 1e-15 - 1

    def needed(self, x: np.ndarray, cells=slice(None)) -> np.ndarray:
        """(cells, rows): whether a query of the cell can need the row; rounding is allowed for."""
        norm, pivots, radius = _norms(x), self.pivots[cells], self.radius[cells]
        slack = (_norms(pivots) + radius)[:, None] * norm[None, :] * 1e-9 + 1
        most = np.minimum(pivots @ x.T + radius[:, None] * norm[None, :], self.norm[cells][:, None] * norm[None, :]) + slack
        return ~(most < self.floor[cells][:, None]) & (self.queries[cells] > 0)[:, None]

    def arrange(self, group_bytes: int, chunk_bytes: int) -> None:
        """Sets groups of cells and their chunks from the cells' summaries."""
        room = max(1, group_bytes // (8 * self.d))
        self.parts = np.maximum(1, -(-self.queries // room))
        held = np.flatnonzero(self.queries > 0)
        need = self.needed(self.sample)
        # Cells in the order of their pivots' main direction, so that neighbours come together.
        centred = self.pivots[held] - self.pivots[held].mean(axis=0) if len(held) else self.pivots[:0]
        order = held[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0])] if len(held) > 1 else held
        best = None
        total = max(1, int(self.queries.sum()))
        fewest = max(1, -(-total // room))
        wanted = fewest
        while wanted <= max(fewest, len(held)):
            group, size, at = np.zeros(len(self.pivots), dtype=np.int64), 0, 0
            for c in order:
                n = min(int(self.queries[c]), room)
                if size and size + n > min(room, -(-total // wanted)):
                    at, size = at + 1, 0
                group[c] = at
                size += n
            shares = np.array([need[held[group[held] == g]].any(axis=0).mean() for g in range(at + 1)]) if len(held) else np.ones(1)
            if best is None or shares.sum() <= SLACK * best[0]:
                best = (shares.sum() if best is None else best[0], group, shares)
            wanted *= 2
        _, self.group, shares = best
        self.chunks = np.maximum(1, np.ceil(shares * self.rows * 8 * self.d / chunk_bytes)).astype(np.int64)


def _blank(d: int, rows: int, queries: int, group_bytes: int, chunk_bytes: int) -> Plan:
    """One cell without bounds for a vector length that is not planned."""
    plan = Plan(np.empty(0, dtype=np.int64), np.zeros((0, d)), 1)
    plan.queries[0], plan.radius[0], plan.norm[0] = queries, np.inf, np.inf
    plan.parts[0] = max(1, -(-queries * 8 * d // group_bytes))
    plan.chunks[0] = max(1, -(-rows * 8 * d // chunk_bytes))
    return plan


class _Best:
    """The k best of each query of a group and of one length, while its data go by."""

    def __init__(self, plan: Plan, k: int, numbers, ids, cells, raw):
        order = np.argsort(cells, kind="stable")
        self.plan, self.k = copy.copy(plan), k
        self.plan.floor = plan.floor.copy()  # raised for these queries only
        self.numbers, self.ids, self.cells = numbers[order], ids[order], cells[order]
        self.raw = [raw[i] for i in order]
        self.q = _matrix(self.raw, plan.d)
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(len(order))]
        self.least = np.full(len(order), -np.inf)
        self.cuts = np.flatnonzero(np.diff(self.cells, prepend=-1, append=-2))

    def meet(self, ids: np.ndarray, raw: list[bytes]) -> None:
        x, held = _matrix(raw, self.plan.d), self.cells[self.cuts[:-1]]
        need = self.plan.needed(x, held)
        for here, a, b in zip(need, self.cuts[:-1], self.cuts[1:], strict=True):
            rows = np.flatnonzero(here)
            if not len(rows):
                continue
            scores = exact_scores(self.q[a:b], x[rows], self.raw[a:b], [raw[i] for i in rows])
            own = self.ids[a:b, None] == ids[rows][None, :]
            high = (scores >= self.least[a:b, None]).astype(bool) & ~own
            for r in np.flatnonzero(high.any(axis=1)):
                at = np.flatnonzero(high[r])
                s, i = scores[r, at], ids[rows[at]]
                if len(at) > self.k and s.dtype != object:
                    edge = s >= np.partition(s, -self.k)[-self.k]
                    s, i = s[edge], i[edge]
                merged = sorted(self.found[a + r] + [(-int(v), int(w)) for v, w in zip(s, i, strict=True)])[: self.k]
                self.found[a + r] = merged
                if len(merged) == self.k and abs(merged[-1][0]) < 1 << 53:
                    self.least[a + r] = -merged[-1][0]
        self.plan.floor[held] = np.maximum(self.plan.floor[held], np.minimum.reduceat(self.least, self.cuts[:-1]))

    def rows(self) -> pa.RecordBatch:
        flat = [(n, q, i, -s) for n, q, best in zip(self.numbers, self.ids, self.found, strict=True) for s, i in best]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f[0] for f in flat], pa.int64()),
                pa.array([f[1] for f in flat], pa.int64()),
                pa.array([f[2] for f in flat], pa.int64()),
                pa.array([max(LEAST, min(LARGEST, f[3])) for f in flat], pa.int64()),
                pa.array([_order_key(f[3]) for f in flat], pa.binary()),
            ],
            names=["number", "query_id", "vec_id", "score", "beyond"],
        )


def plan_join(data: DataFrame, queries: DataFrame, k: int, group_bytes: int = GROUP_BYTES, chunk_bytes: int = CHUNK_BYTES):
    """(plans by length, queries with number, floor, cell and distance): the summaries of steps 1 to 3.

    Lengths beyond PLANNED have no plan here; their rows and queries are counted by length where they meet.
    """
    spark = data.sparkSession
    lengths = data.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(PLANNED).collect()
    plans: dict[int, Plan] = {}
    share = PLAN_BYTES // max(1, len(lengths))
    wanted = {r.d: min(SAMPLE, max(64, share // (16 * r.d))) for r in lengths if 8 * r.d * 64 <= share}
    if wanted:
        odds = F.lit(0)
        for r in lengths:
            if r.d in wanted:
                odds = F.when(F.col("d") == r.d, min(1 << 20, (wanted[r.d] << 20) // r.n + 1)).otherwise(odds)
        picked = data.where(F.pmod(F.xxhash64("v", "id"), F.lit(1 << 20)) < odds).limit(2 * sum(wanted.values())).toArrow()
        sizes = picked.column("d").to_numpy()
        for r in lengths:
            if r.d in wanted:
                some = picked.filter(pa.array(sizes == r.d)).slice(0, 2 * wanted[r.d])
                plans[r.d] = Plan(some.column("id").to_numpy(), _matrix(some.column("v"), r.d), r.n)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, n = batch.column(2).to_numpy(), batch.num_rows
            cell, far, norm, low = np.zeros(n, dtype=np.int32), np.full(n, np.inf), np.full(n, np.inf), np.full(n, -np.inf)
            with np.errstate(all="ignore"):
                for d in np.unique(sizes):
                    if (plan := plans.get(int(d))) is not None:
                        at = np.flatnonzero(sizes == d)
                        q = _matrix(batch.column(3).take(pa.array(at)), int(d))
                        cell[at], far[at] = plan.nearest(q)
                        norm[at] = np.nan_to_num(_norms(q), nan=np.inf)
                        for part in np.array_split(np.arange(len(at)), -(-len(at) // 512)):
                            low[at[part]] = plan.floors(batch.column(1).to_numpy()[at[part]], q[part], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (cell, far, norm, low))], names=names)

    schema = "number long, id long, d int, v binary, cell int, far double, norm double, low double"
    names = [x.split()[0] for x in schema.split(", ")]
    celled = materialize(queries.select("number", "id", "d", "v").mapInArrow(placed, schema), "topk-queries")
    summary = celled.where(F.col("d").isin(list(plans))).groupBy("d", "cell").agg(
        F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm"), F.min("low").alias("low")
    )
    for r in summary.collect():
        p = plans[r.d]
        p.queries[r.cell], p.radius[r.cell] = r.n, r.far * (1 + 1e-9) + 1e-6
        p.norm[r.cell], p.floor[r.cell] = r.norm * (1 + 1e-9) + 1e-6, r.low
    with np.errstate(all="ignore"):
        for p in plans.values():
            p.arrange(group_bytes, chunk_bytes)
    return plans, celled


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector: str = "embedding",
    group_bytes: int = GROUP_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every row for which is_query(id) holds.

    is_query is an expression over column ``id``.
    """
    data = materialize(usable_vectors(vectors, id_col, vector), "topk-vectors")
    asked = data.where(is_query).dropDuplicates(["id", "v"])
    asked = materialize(asked.withColumn("number", F.monotonically_increasing_id()), "topk-asked")
    plans, celled = plan_join(data, asked, k, group_bytes, chunk_bytes)

    schema = "d int, grp long, chunk long, kind int, number long, id long, cell int, v binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def dealt(columns: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    # Lengths without a plan: rows and queries of a length are joined on, so chunks follow from their counts.
    rare = data.where(~F.col("d").isin(list(plans))).groupBy("d").agg(F.count("*").alias("rows"))
    held = celled.where(~F.col("d").isin(list(plans))).groupBy("d").agg(F.count("*").alias("asked"))
    other = materialize(rare.join(held, "d"), "topk-lengths")
    spread = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40))

    def send_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, ids, sizes, cells = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            rows, queries, hashed = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 7))
            who, grp, chunk = [], [], []
            for r in range(batch.num_rows):
                d, c = int(sizes[r]), int(cells[r])
                plan = plans.get(d) or _blank(d, int(rows[r]), int(queries[r]), group_bytes, chunk_bytes)
                n = int(plan.chunks[plan.group[c]])
                who += [r] * n
                grp += [int(plan.group[c]) << 20 | int(hashed[r] % plan.parts[c])] * n
                chunk += range(n)
                if len(who) >= 1 << 16:
                    yield dealt([sizes[who], grp, chunk, np.zeros(len(who), dtype=np.int32), number[who], ids[who], cells[who], batch.column(3).take(pa.array(who))])
                    who, grp, chunk = [], [], []
            if who:
                yield dealt([sizes[who], grp, chunk, np.zeros(len(who), dtype=np.int32), number[who], ids[who], cells[who], batch.column(3).take(pa.array(who))])

    def send_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows, queries, hashed = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                plan = plans.get(int(d)) or _blank(int(d), int(rows[at[0]]), int(queries[at[0]]), group_bytes, chunk_bytes)
                with np.errstate(all="ignore"):
                    need = plan.needed(_matrix(batch.column(2).take(pa.array(at)), int(d)))
                for g in range(len(plan.chunks)):
                    cells = np.flatnonzero((plan.group == g) & (plan.queries > 0))
                    who = at[np.flatnonzero(need[cells].any(axis=0))]
                    for part in range(int(plan.parts[cells].max(initial=0)) if len(who) else 0):
                        some = who[need[cells[plan.parts[cells] > part]].any(axis=0)[np.searchsorted(at, who)]]
                        n = len(some)
                        yield dealt([
                            sizes[some], np.full(n, g << 20 | part), hashed[some] % plan.chunks[g], np.ones(n, dtype=np.int32), np.zeros(n, dtype=np.int64),
                            ids[some], np.zeros(n, dtype=np.int32), batch.column(2).take(pa.array(some)),
                        ])

    def with_counts(df: DataFrame) -> DataFrame:
        """df with rows and asked of its length, zero where a plan has them; lengths that nobody asks about go."""
        known = df.where(F.col("d").isin(list(plans))).withColumns({"rows": F.lit(0).cast("long"), "asked": F.lit(0).cast("long")})
        return known.union(df.where(~F.col("d").isin(list(plans))).join(other, "d").select(*df.columns, "rows", "asked"))

    sent = (
        with_counts(celled.select("number", "id", "d", "v", "cell")).withColumn("spread", spread).mapInArrow(send_queries, schema)
    ).union(with_counts(data.select("id", "d", "v")).withColumn("spread", spread).mapInArrow(send_data, schema))
    met = sent.repartition("d", "grp", "chunk").sortWithinPartitions("d", "grp", "chunk", "kind")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, waiting, best = None, [], [], None

        def flush() -> None:
            nonlocal waiting, best, asked
            if best is None and asked:
                table = pa.Table.from_batches(asked)
                plan = plans.get(key[0]) or _blank(key[0], 1, 1, group_bytes, chunk_bytes)
                best = _Best(plan, k, *(table.column(i).to_numpy() for i in (4, 5, 6)), table.column(7).to_pylist())
                asked = []
            if best is not None and waiting:
                table = pa.Table.from_batches(waiting)
                with np.errstate(all="ignore"):
                    best.meet(table.column(5).to_numpy(), table.column(7).to_pylist())
            waiting = []

        def close() -> pa.RecordBatch | None:
            nonlocal best
            flush()
            out = None
            if best is not None:
                out = best.rows()
            best = None
            return out

        for batch in batches:
            marks = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1, [len(marks)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                here = tuple(marks[a, :3].tolist())
                if here != key:
                    if (out := close()) is not None:
                        yield out
                    key, asked = here, []
                if marks[a, 3] == 0:
                    asked.append(batch.slice(a, b - a))
                else:
                    for at in range(a, b, BLOCK):
                        waiting.append(batch.slice(at, min(BLOCK, b - at)))
                        if sum(w.num_rows for w in waiting) >= BLOCK:
                            flush()
        if (out := close()) is not None:
            yield out

    found = met.mapInArrow(solve, "number long, query_id long, vec_id long, score long, beyond binary")
    ranked = Window.partitionBy("number").orderBy(F.desc("beyond"), F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def oracle_sql(every: int, k: int) -> str:
    return f"""
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
    """
