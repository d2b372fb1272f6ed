"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

1. Vectors of one label that are equal are one class (pre-aggregated); only classes go on.
2. The classes of a label are dealt to shards by a hash; shards grow with the root of the label's classes,
   from SHARD_LEAST to SHARD_MOST. Each shard, whatever its size, gets a graph of several layers: every node is in
   layer 0, a falling share in each layer above; neighbours are chosen for diversity, so that a clump
   of copies does not close on itself.
3. Every class queries every shard of its label: down the layers to an entry, then with a beam. Links are
   the beam's vectors whose cosine, computed again in double precision from the vectors as given, is at
   least the threshold.
4. Audits compare a query with all of the shard and so count how often a beam's links are whole. Until ENOUGH
   audited queries have had a link other than themselves, every query is audited; then some of each
   block are. A beam that does not reach RECALL is widened, and where the widest does not, all queries stay
   audited. An audited query has all its links, found by the beam or not; a query whose beam is
   half full of links may have lost some and is audited too.
5. A task counts each query's links and joins what they connect by vectorised label propagation, so it emits a
   row for each query and edges no more than its queries and nodes, never all pairs. Components of the
   edges give the groups.

Memory of a task is one shard, its graph and a block of queries. A label with most of the rows is
many shards.

Cases: a vector that is null, empty, zero or holds a null or non-finite component, or whose label is
null, links with nothing: n_links 0, its own id as component, kept; vectors of different lengths do
not link; equal vectors link with each other, also where their id repeats; a row with a null id
counts as a link of others and gets its group's component; kept is false for it where the group has
an id. No rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.llm.components import connected_components
from octavo.llm.shingles import mix
from octavo.plans.tables import discard, materialize

#: Least and most classes of a shard.
SHARD_LEAST, SHARD_MOST = 4096, 32768
NEIGHBOURS = 12
BUILD_BEAM = 32
BEAMS = (32, 128, 512)
AUDITED = 64
RECALL = 0.999
#: Audited queries with a link without which no beam is relied on: so many that a thousandth of them is one.
ENOUGH = 1000
#: Queries of a block, and numbers of the tables that a block needs for each node.
QUERY_BLOCK, BLOCK_CELLS = 1024, 1 << 24


class Graph:
    """A navigable small-world graph over unit vectors; all searches run for a block of queries at once."""

    def __init__(self, unit: np.ndarray, seeds: np.ndarray, m: int = NEIGHBOURS, beam: int = BUILD_BEAM):
        self.x, self.m, self.beam = np.ascontiguousarray(unit, dtype=np.float32), m, beam
        n = len(unit)
        draw = (mix(seeds.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.minimum((-np.log(draw + 1e-18) / np.log(m)).astype(int), 8)
        self.order = np.argsort(-level, kind="stable")
        self.top = int(level.max(initial=0))
        self.layers = [np.full((n, 2 * m if layer == 0 else m), -1, dtype=np.int32) for layer in range(self.top + 1)]
        self.entry = int(self.order[0]) if n else -1
        for layer in range(self.top, -1, -1):
            self._build(layer, self.order[level[self.order] >= layer])

    def _build(self, layer: int, nodes: np.ndarray) -> None:
        """Inserts the nodes of a layer in waves: a wave searches what is there and meets itself."""
        done = 1
        while done < len(nodes):
            wave = nodes[done : done + min(done, 256)]
            found, _ = self.search(self.x[wave], self.beam, layer)
            width = min(self.beam, len(wave))
            among = self.x[wave] @ self.x[wave].T
            np.fill_diagonal(among, -2)
            near = np.argpartition(-among, width - 1, axis=1)[:, :width]
            peers = np.where(np.take_along_axis(among, near, axis=1) > -2, wave[near], -1)
            chosen = self._diverse(wave, np.concatenate([found, peers], axis=1), self.m)
            table = self.layers[layer]
            table[wave, : self.m] = chosen
            who, slot = np.nonzero(chosen >= 0)
            self._back(layer, chosen[who, slot], wave[who])
            done += len(wave)

    def _back(self, layer: int, at: np.ndarray, new: np.ndarray) -> None:
        """Adds links at -> new; a full node keeps the most diverse of its neighbours."""
        order = np.argsort(at, kind="stable")
        at, new = at[order], new[order]
        nodes, first, counts = np.unique(at, return_index=True, return_counts=True)
        slot = np.minimum(np.arange(len(at)) - np.repeat(first, counts), 63)
        table = self.layers[layer]
        extra = np.full((len(nodes), int(slot.max(initial=0)) + 1), -1, dtype=np.int32)
        extra[np.repeat(np.arange(len(nodes)), counts), slot] = new
        table[nodes] = self._diverse(nodes, np.concatenate([table[nodes], extra], axis=1), table.shape[1])

    def _diverse(self, nodes: np.ndarray, options: np.ndarray, most: int) -> np.ndarray:
        """Neighbours for each node: nearest first, one that is nearer to a chosen one than to the node
        only if places stay free."""
        out = np.full((len(nodes), most), -1, dtype=np.int32)
        for at in range(0, len(nodes), 128):
            n, o = nodes[at : at + 128], np.sort(options[at : at + 128], axis=1)
            o[:, 1:][o[:, 1:] == o[:, :-1]] = -1
            o[o == n[:, None]] = -1
            sims = np.where(o >= 0, np.einsum("nd,ncd->nc", self.x[n], self.x[o]), -3)
            rank = np.argsort(-sims, axis=1)
            o, sims = np.take_along_axis(o, rank, axis=1), np.take_along_axis(sims, rank, axis=1)
            v = self.x[o]
            pair = v @ v.transpose(0, 2, 1)
            taken = np.zeros(o.shape, dtype=bool)
            for c in range(o.shape[1]):
                nearest = np.where(taken, pair[:, c], -2).max(axis=1)
                taken[:, c] = (o[:, c] >= 0) & (sims[:, c] > nearest) & (taken.sum(axis=1) < most)
            keyed = np.where(taken, 0, np.where(o >= 0, 1, 2)) * o.shape[1] + np.arange(o.shape[1])
            pick = np.argsort(keyed, axis=1)[:, :most]
            got = np.take_along_axis(o, pick, axis=1)
            out[at : at + 128, : got.shape[1]] = got
        return out

    def search(self, q: np.ndarray, beam: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam of each query in the layer; -1 where it is not full."""
        entry = np.full((len(q), 1), self.entry, dtype=np.int32)
        for upper in range(self.top, layer, -1):
            entry = self._beam(q, entry, 2, upper)[0]
        return self._beam(q, entry, beam, layer)

    def _beam(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int, at_once: int = 4):
        q, table, n = q.astype(np.float32), self.layers[layer], len(self.x)
        rows = np.arange(len(q))
        ids = np.full((len(q), beam + entry.shape[1]), -1, dtype=np.int32)
        ids[:, : entry.shape[1]] = entry
        sims = np.where(ids >= 0, np.einsum("qd,qcd->qc", q, self.x[ids]), -3).astype(np.float32)
        ids, sims = ids[:, :beam], sims[:, :beam]
        open_ = ids >= 0
        seen = np.zeros((len(q), n + 1), dtype=bool)
        np.put_along_axis(seen, entry, True, axis=1)
        active = rows
        while len(active):
            some = np.where(open_[active], sims[active], -4)
            k = min(at_once, beam)
            pick = np.argpartition(-some, k - 1, axis=1)[:, :k]
            live = np.take_along_axis(some, pick, axis=1) > -3
            going = live.any(axis=1)
            active, pick, live = active[going], pick[going], live[going]
            if not len(active):
                break
            head = np.where(live, np.take_along_axis(ids[active], pick, axis=1), -1)
            opened = open_[active]
            np.put_along_axis(opened, pick, False, axis=1)
            near = np.where(head[:, :, None] >= 0, table[head], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[active[:, None], near]] = -1
            seen[active[:, None], near] = True
            seen[:, n] = False
            fresh = np.where(near >= 0, np.einsum("qd,qcd->qc", q[active], self.x[near]), -3).astype(np.float32)
            every = np.concatenate([sims[active], fresh], axis=1)
            best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(every, best, axis=1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), best, axis=1)
            open_[active] = np.take_along_axis(np.concatenate([opened, near >= 0], axis=1), best, axis=1) & (ids[active] >= 0)
        return ids, sims


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines of two sets of vectors in double precision."""
    return (a @ b.T) / (np.sqrt((a**2).sum(axis=1))[:, None] * np.sqrt((b**2).sum(axis=1))[None, :])


class Shard:
    """The vectors of a shard, their graph and the search for all links of a block of queries."""

    def __init__(self, x: np.ndarray, seeds: np.ndarray, beams=BEAMS, recall: float = RECALL):
        self.x, self.recall = x, recall
        self.norm = np.sqrt((x**2).sum(axis=1))
        self.graph = Graph(x / self.norm[:, None], seeds)
        self.beams = sorted({min(b, len(x)) for b in beams})
        self.at = 0
        #: Audited queries with links under the present beam, and those that it gave whole.
        self.audited = self.whole = 0

    def block(self) -> int:
        """Queries that may be searched for at once."""
        return max(16, min(QUERY_BLOCK, BLOCK_CELLS // max(1, len(self.x))))

    @property
    def beam(self) -> int:
        return self.beams[self.at]

    def trusted(self) -> bool:
        """Whether enough audits say that the beam's links are whole."""
        return self.audited >= ENOUGH and self.whole >= self.recall * self.audited

    def _scan(self, q: np.ndarray, least: float) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        step = max(16, min(256, (BLOCK_CELLS >> 3) // max(1, len(self.x))))
        for at in range(0, len(q), step):
            out += [np.flatnonzero(r) for r in cosines(q[at : at + step], self.x) >= least]
        return out

    def _search(self, q: np.ndarray, beam: int, least: float) -> list[np.ndarray]:
        norm = np.sqrt((q**2).sum(axis=1))
        ids, _ = self.graph.search(q / norm[:, None], beam)
        dots = np.einsum("qd,qcd->qc", q, self.x[ids])
        near = (ids >= 0) & (dots / (norm[:, None] * self.norm[ids]) >= least)
        return [i[n].astype(np.int64) for i, n in zip(ids, near, strict=True)]

    def _audit(self, found: list[np.ndarray], truth: list[np.ndarray], own: np.ndarray) -> None:
        """Counts queries that have a link other than themselves and do not crowd the beam; widens it if need be."""
        for got, want, node in zip(found, truth, own, strict=True):
            if (want != node).any() and 2 * len(got) < self.beam:
                self.audited += 1
                self.whole += bool(np.isin(want, got).all())
        if self.audited >= ENOUGH and not self.trusted() and self.at + 1 < len(self.beams):
            self.at, self.audited, self.whole = self.at + 1, 0, 0

    def links(self, q: np.ndarray, least: float, own: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query the nodes of the shard with a cosine of at least least, and how many of these the graph
        missed, -1 where the query was not audited; own is its own node, -1 if elsewhere."""
        own = np.full(len(q), -1) if own is None else own
        missed = np.full(len(q), -1)
        if not len(q):
            return [], missed
        out = self._search(q, self.beam, least)
        if self.trusted():
            crowded = np.array([2 * len(f) >= self.beam for f in out])
            crowded[np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(int)] = True
        else:
            crowded = np.ones(len(q), dtype=bool)
        audit = np.flatnonzero(crowded)
        truth = self._scan(q[audit], least)
        self._audit([out[i] for i in audit], truth, own[audit])
        for i, want in zip(audit, truth, strict=True):
            missed[i] = len(np.setdiff1d(want, out[i]))
            out[i] = want
        if not crowded.all() and not self.trusted():  # this very block took away the trust
            rest = np.flatnonzero(~crowded)
            for i, want in zip(rest, self._scan(q[rest], least), strict=True):
                missed[i] = len(np.setdiff1d(want, out[i]))
                out[i] = want
        return out, missed


class Joined:
    """Which nodes of a shard the links of the queries so far connect: label is a node's group's smallest node."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, found: list[np.ndarray]) -> None:
        """All nodes of one query's links are in one group."""
        sizes = np.array([len(f) for f in found])
        at = np.flatnonzero(sizes > 1)
        if not len(at):
            return
        nodes = np.concatenate([found[i] for i in at])
        starts = np.cumsum(sizes[at]) - sizes[at]
        while True:
            before = self.label[nodes]
            np.minimum.at(self.label, before, np.repeat(np.minimum.reduceat(before, starts), sizes[at]))
            while (jumped := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = jumped
            if (self.label[nodes] == before).all():
                return


def _clean(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """id, label and v: the vector's doubles as bytes, null where it links with nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2):
                x = None
                if v.is_valid and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                    if not len(x) or not np.isfinite(x).all() or not x.any():
                        x = None
                out.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "v"])

    kind = vectors.schema[label].dataType.simpleString()
    slim = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("x")
    )
    return slim.mapInArrow(read, f"id long, label {kind}, v binary")


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.98,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    shard_size: int | None = None,
    audits: bool = False,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    With audits two more columns: audited_links, links other than itself that audits of the vector's class saw, and
    missed_links, those of them that the graphs alone had not found; their sums give the recall.
    """
    rows = materialize(_clean(vectors, id_col, vector, label), "neardup-rows")
    usable = rows.where("label IS NOT NULL AND v IS NOT NULL")
    classes = materialize(
        usable.groupBy("label", "v")
        .agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        .withColumn("node", F.monotonically_increasing_id()),
        "neardup-classes",
    )
    held = F.count("*").cast("double")
    room = F.lit(float(shard_size)) if shard_size else F.greatest(F.lit(float(SHARD_LEAST)), F.least(F.lit(float(SHARD_MOST)), 64 * F.sqrt(held)))
    shards = materialize(
        classes.groupBy("label", F.length("v").alias("size")).agg(F.ceil(held / room).cast("int").alias("shards")), "neardup-shards"
    )
    sized = classes.withColumn("size", F.length("v")).join(shards, ["label", "size"])
    own = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    layout = ("label", "size", "shard", "query", "node", "n", "v")
    data = sized.withColumn("shard", own).withColumn("query", F.lit(False)).select(*layout)
    asked = sized.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("query", F.lit(True)).select(*layout)
    key = ("label", "size", "shard")
    dealt = data.union(asked).repartition(*key).sortWithinPartitions(*key, "query", "node")

    names, kinds = ["node", "links", "other", "audited", "missed"], [pa.int64()] * 5

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, data, queries = None, [], []
        shard, nodes, counts, joined = None, None, None, None

        def batch_of(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def answer() -> pa.RecordBatch | None:
            """A row for each waiting query: its links, one node that it links with, and what an audit saw."""
            nonlocal queries, shard, nodes, counts, joined, data
            if at is None:
                return None
            if shard is None:
                nodes, counts, raw = (np.array([d[0] for d in data]), np.array([d[1] for d in data]), [d[2] for d in data])
                shard = Shard(np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1), nodes)
                joined, data = Joined(len(nodes)), []
            if not queries:
                return None
            q = np.frombuffer(b"".join(x[2] for x in queries), dtype="<f8").reshape(len(queries), -1)
            asked = np.array([x[0] for x in queries])
            at_node = np.minimum(np.searchsorted(nodes, asked), len(nodes) - 1)  # data come sorted by node
            own = np.where(nodes[at_node] == asked, at_node, -1)
            found, missed = shard.links(q, least, own=own)
            found = [f if o < 0 else np.union1d(f, [o]) for f, o in zip(found, own, strict=True)]
            joined.add(found)
            others = np.array([len(f) - (o >= 0) for f, o in zip(found, own, strict=True)])
            links = [int(counts[f].sum()) - (int(counts[o]) if o >= 0 else 0) for f, o in zip(found, own, strict=True)]
            near = [int(nodes[f[0]]) if len(f) else None for f in found]
            audited = np.where(missed >= 0, others, 0)
            out = batch_of(asked, links, near, audited, np.minimum(np.maximum(missed, 0), audited))
            queries = []
            return out

        def edges() -> pa.RecordBatch:
            own = np.flatnonzero(joined.label != np.arange(len(joined.label))) if joined else np.empty(0, dtype=np.int64)
            zero = np.zeros(len(own), dtype=np.int64)
            return batch_of(nodes[own] if joined else own, zero, nodes[joined.label[own]] if joined else own, zero, zero)

        for batch in batches:
            for lab, size, sh, query, node, n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (lab, size, sh):
                    if (out := answer()) is not None:
                        yield out
                    yield edges()
                    at, data, queries, shard, joined = (lab, size, sh), [], [], None, None
                if query:
                    queries.append((node, n, v))
                    if len(queries) >= (shard.block() if shard else 16):
                        yield answer()
                else:
                    data.append((node, n, v))
        if (out := answer()) is not None:
            yield out
        yield edges()

    found = materialize(
        dealt.mapInArrow(search, "node long, links long, other long, audited long, missed long"), "neardup-links"
    )
    groups = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    sums = ("links", "audited", "missed")
    degree = found.groupBy("node").agg(*[F.sum(c).alias(c) for c in sums])
    extra = ("audited", "missed") if audits else ()
    known = materialize(
        classes.join(degree, "node", "left")
        .join(groups, "node", "left")
        .select("label", "v", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), *extra, F.coalesce("component", "node").alias("c")),
        "neardup-known",
    )
    smallest = materialize(known.groupBy("c").agg(F.min("rep").alias("component_id")), "neardup-smallest")
    final = materialize(
        known.join(smallest, "c").select(F.col("label").alias("l"), F.col("v").alias("w"), "n_links", *extra, "component_id"), "neardup-final"
    )
    discard(classes, shards, found, known, smallest)
    out = rows.join(final, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
        *[F.coalesce(c, F.lit(0)).alias(f"{c}_links") for c in extra],
    )


def oracle_sql(least: float = 0.98) -> str:
    """DuckDB SQL for near_duplicates(embeddings), by all pairs of a label; ids taken to be unique."""
    return f"""
    WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    u AS (
        SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE list_cosine_similarity(a.v, b.v) >= {least} OR a.v = b.v),
    reach AS (SELECT vec_id AS id, vec_id AS c FROM e UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(reach.c) AS component_id, min(reach.c) = e.vec_id AS kept
    FROM e JOIN reach ON reach.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id GROUP BY e.vec_id
    """
