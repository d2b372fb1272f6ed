"""Size-aware heavy-light Jaccard join over word shingles, and the groups that its links make.

Every document is the set of its distinct w-word shingles. Two link when the Jaccard similarity of
their sets is at least num/100. No link between different sets is lost; documents with equal sets
are one class and link without being paired. Steps:

1. Classes. A set's size and two 64-bit sums over its hashes name its class; a pre-aggregated
   minimum gives each class a representative. Only representatives go on.
2. Boundary. For each size the number of fixed-size subsets that a set must emit is compared with the
   posting cost of scanning lists, over the sizes seen in the fitting sample; the boundary with the
   least total cost splits small (light) from large (heavy) sets.
3. Small sets emit hashes of all their subsets of the least overlap size for each partner size. Sets
   that share such a subset do link, so a bucket needs no pairs: all its sets link to its smallest.
4. Large sets post the first few shingles of a global order (those that a similar set cannot all
   miss) to inverted lists. Shingles that are frequent in the sample come last in that order, the rest
   is ordered by hash; any order gives the same links, a better one gives shorter lists.
5. Where lists of more than SHORT sets hold many postings, their shingles are put last as well and the
   texts are scanned again. Lists up to SHORT sets then give candidate pairs that pass the size bound
   and the positional bound, and bounds on the difference of binned counts, first few, then more. A longer
   list of a shingle that is last already (its sets have hardly another) or of more than BLOCK sets
   gives no pairs: its sets join one candidate cluster.
6. Candidate clusters (components of candidate pairs and long lists) are resolved from the whole sets:
   a cluster's sets are dealt to block pairs, each block pair counts all overlaps by one matrix
   product and emits a spanning forest of the links it finds. Components of these edges and classes
   are the result.

Bounds: the sample has about SAMPLE_DOCS documents, the order at most ORDER_TOKENS shingles
(broadcast), ids of candidate documents are broadcast up to BROADCAST_IDS and else joined by shuffle.
Work on a group of n near copies that are not one class is n/BLOCK rows a document, without pairs.

Cases: a null or empty text, or one without words, has no shingle and links with nothing; a text
with fewer than w words is one shingle; a row with a null id takes part in its class only, and its
component is the class's; so does a row whose id other rows carry with another set of shingles, since
such an id names no document, and its component is its own id where its class has none; rows that
share an id and a set are one node; equal rows each give a row; no rows give no rows; columns other
than id and text are not read by jaccard_groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.llm.components import connected_components
from octavo.llm.shingles import mix, shingle_sets
from octavo.llm.tokens import forget
from octavo.plans.tables import discard, materialize, tidy

SAMPLE_DOCS = 8192
ORDER_TOKENS = 1_000_000
BROADCAST_IDS = 1_000_000
BLOCK = 256
#: Shingles of a block, about; a set with more is a block's worth alone.
BLOCK_SHINGLES = 1 << 20
#: Lists up to so many sets give pairs; shingles with longer lists are worth a place at the order's end.
SHORT = 32
#: Bins of a set's binned counts: a power of two, about one for BIN_SIZE shingles.
BIN_SIZE, BINS_LEAST = 8, 32
#: Bins, and first listed shingles of its set, that travel with a posting.
MINI, HEADS = 16, 4
#: Largest size that may be small, and the cost of a posting in subset keys.
SMALL_MOST = 40
POSTING_COST = 6.0
#: Scan again while long lists of shingles not yet last hold more postings than this share of the sets,
#: so often at most.
LONG_SHARE = 0.05
RESCANS = 1


def least_overlap(a, b, num: int):
    """Least intersection of sets of sizes a and b that link."""
    return -(-num * (a + b) // (100 + num))


def prefix_length(n, num: int):
    """So many first shingles of any common order cannot all be missed by a set that links."""
    return n - -(-num * n // 100) + 1


def subset_keys(n: int, num: int) -> int:
    """Number of subset keys a set of n shingles emits."""
    return sum(math.comb(n, least_overlap(n, m, num)) for m in range(-(-num * n // 100), 100 * n // num + 1))


def boundary(sizes: dict[int, int], num: int) -> int:
    """Largest size of a small set, by the least total cost over the sizes seen."""
    best, at = math.inf, 0
    for x in range(0, SMALL_MOST + 1):
        cost = 0.0
        for n, count in sizes.items():
            if 0 < n <= x:
                cost += count * subset_keys(n, num)
            if n and 100 * n // num > x:
                cost += count * prefix_length(n, num) * POSTING_COST
        if cost < best:
            best, at = cost, x
    return at


def _subsets(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hash sums of all subsets of that size, by what they leave out."""
    total = tokens.sum(dtype=np.uint64)
    out = np.array([0], dtype=np.uint64)
    last = np.array([-1])
    for _ in range(len(tokens) - size):
        counts = len(tokens) - 1 - last
        base, start = np.repeat(out, counts), np.repeat(last + 1, counts)
        step = np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts)
        last = start + step
        out = base + tokens[last]
    return total - out


def light_keys(tokens: np.ndarray, num: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a small set's subsets, and for each which side its set is on: 0 equal, 1 smaller, 2 larger."""
    n, keys, sides = len(tokens), [], []
    scattered = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    for m in range(-(-num * n // 100), 100 * n // num + 1):
        if m > most:
            continue
        k = _subsets(scattered, least_overlap(n, m, num))
        shape = np.uint64(min(n, m) * 65536 + max(n, m))
        keys.append(mix(k ^ mix(np.array([shape], dtype=np.uint64))))
        sides.append(np.full(len(k), 0 if m == n else 1 if n < m else 2, dtype=np.int8))
    return np.concatenate(keys), np.concatenate(sides)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    sizes = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts))
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind)
    )


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums over a set, as signed 64-bit numbers."""
    a = tokens.sum(dtype=np.uint64)
    b = mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def binned(tokens: np.ndarray) -> bytes:
    """Counts of a set's hashes in bins, a byte each; half as many bins are their sums in pairs."""
    k = BINS_LEAST
    while k * BIN_SIZE < len(tokens):
        k *= 2
    counts = np.bincount((tokens >> np.uint64(7)) % np.uint64(k), minlength=k)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _folded(bins: np.ndarray, k: int) -> np.ndarray:
    return np.minimum(bins.reshape(len(bins), -1, k).sum(axis=1), 255)


SCAN = "id long, n long, s1 long, s2 long, mini binary, bins binary, post array<long>, keys array<long>, sides array<tinyint>"


def scan_sets(docs: DataFrame, width: int, num: int, small: int, late: np.ndarray) -> DataFrame:
    """One row per document of docs (id, text): its class, binned counts, prefix and subset keys.

    late: sorted hashes that come last in the order.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            n, s1, s2, mini, bins, post, keys, sides = [], [], [], [], [], [], [], []
            with np.errstate(over="ignore"):
                for t in shingle_sets(batch.column(1), width):
                    size = len(t)
                    a, b = _signature(t)
                    n.append(size)
                    s1.append(a)
                    s2.append(b)
                    bins.append(binned(t))
                    mini.append(_folded(np.frombuffer(bins[-1], dtype=np.uint8)[None], MINI).astype(np.uint8).tobytes())
                    if size and 100 * size // num > small:
                        at = np.searchsorted(late, t)
                        is_late = late[np.minimum(at, len(late) - 1)] == t if len(late) else np.zeros(size, dtype=bool)
                        p = prefix_length(size, num)
                        first = t[~is_late][:p]
                        post.append(np.concatenate([first, t[is_late][: p - len(first)]]))
                    else:
                        post.append(t[:0])
                    if 0 < size <= small:
                        k, side = light_keys(t, num, small)
                    else:
                        k, side = t[:0], np.empty(0, dtype=np.int8)
                    keys.append(k)
                    sides.append(side)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(s1, pa.int64()),
                    pa.array(s2, pa.int64()),
                    pa.array(mini, pa.binary()),
                    pa.array(bins, pa.binary()),
                    _lists(post, pa.int64()),
                    _lists(keys, pa.int64()),
                    _lists(sides, pa.int8()),
                ],
                names=[x.split()[0] for x in SCAN.split(", ")],
            )
        tidy()

    return docs.mapInArrow(scanned, SCAN)


def fit_order(docs: DataFrame, width: int, num: int) -> tuple[np.ndarray, int]:
    """Hashes that come last and the boundary, from a sample of about SAMPLE_DOCS documents, copies once."""
    rows = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    picked = docs.where(F.abs(F.xxhash64("id", F.lit(7))) % (1 << 20) < int(share * (1 << 20)) + 1)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), width))
            with np.errstate(over="ignore"):
                sums = [_signature(t)[0] for t in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(t) for t in sets], pa.int64()), pa.array(sums, pa.int64()), _lists(sets, pa.int64())],
                names=["n", "s1", "t"],
            )
        tidy()

    sample = materialize(
        picked.mapInArrow(tokens, "n long, s1 long, t array<long>").dropDuplicates(["n", "s1"]), "jaccard-sample"
    )
    sizes = {r.n: r["count"] for r in sample.where(f"n <= {2 * SMALL_MOST}").groupBy("n").count().collect()}
    large = sample.where(f"n > {2 * SMALL_MOST}").count()
    late = _hashes(
        sample.select(F.explode("t").alias("t")).groupBy("t").count().where("count >= 3").orderBy(F.desc("count"), "t").limit(ORDER_TOKENS)
    )
    discard(sample)
    sizes[2 * SMALL_MOST + 1] = large
    return late, boundary(sizes, num)


def _hashes(tokens: DataFrame) -> np.ndarray:
    got = tokens.select("t").toArrow().column("t").to_numpy()
    return np.sort(got.astype(np.int64).view(np.uint64))


def _marked(lists: DataFrame, late: np.ndarray) -> DataFrame:
    """lists (t, count) with column late: whether t is in the sorted hashes."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_late = np.isin(batch.column(0).to_numpy().view(np.uint64), late)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(is_late)], names=["t", "count", "late"])
        tidy()

    return lists.select("t", "count").mapInArrow(marked, "t long, count long, late boolean")


def _light_edges(sets: DataFrame) -> DataFrame:
    """Edges among small sets: every set of a bucket whose sets link, to the smallest."""
    keys = sets.select("id", F.explode(F.arrays_zip("keys", "sides")).alias("k")).select(
        "id", F.col("k.keys").alias("key"), F.col("k.sides").alias("side")
    )
    buckets = materialize(
        keys.groupBy("key")
        .agg(F.min("id").alias("hub"), F.max("id").alias("far"), F.min("side").alias("lo"), F.max("side").alias("hi"))
        .where("hub <> far AND (hi = 0 OR lo <> hi)")
        .select("key", "hub"),
        "jaccard-buckets",
    )
    return keys.join(buckets, "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))


def _list_pairs(postings: DataFrame, num: int) -> DataFrame:
    """Distinct candidate pairs of the inverted lists in (t, id, n, pos, mini, heads), within bounds on size,
    position and the difference of the few binned counts that a posting carries.

    heads are the first shingles of the set that have a short list. Where two sets share one of these, the first
    that they share is the first they share at all, and only its list gives the pair.
    """
    none = np.iinfo(np.int64).min

    def pairs_of(t, ids, n, pos, mini, heads):
        """All pairs of rows with the same t; rows are sorted by t."""
        cuts = np.flatnonzero(np.diff(t)) + 1
        starts, sizes = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(t)]]))
        found = []
        for size in np.unique(sizes):
            if size < 2:
                continue
            i, j = np.triu_indices(size, 1)
            first = starts[sizes == size]
            step = max(1, 500_000 // len(i))
            for k in range(0, len(first), step):
                a = (first[k : k + step, None] + i).ravel()
                b = (first[k : k + step, None] + j).ravel()
                na, nb = n[a], n[b]
                ok = 100 * np.minimum(na, nb) >= num * np.maximum(na, nb)
                a, b, na, nb = a[ok], b[ok], na[ok], nb[ok]
                ok = np.minimum(na - pos[a], nb - pos[b]) >= least_overlap(na, nb, num)
                a, b = a[ok], b[ok]
                far = np.abs(mini[a].astype(np.int16) - mini[b]).sum(axis=1)
                ok = far <= n[a] + n[b] - 2 * least_overlap(n[a], n[b], num)
                a, b = a[ok], b[ok]
                both = ((heads[a][:, :, None] == heads[b][:, None, :]) & (heads[a] != none)[:, :, None]).any(axis=2)
                earliest = heads[a][np.arange(len(a)), both.argmax(axis=1)]
                ok = ~both.any(axis=1) | (earliest == t[a])
                x, y = ids[a[ok]], ids[b[ok]]
                ok = x != y
                found.append(np.column_stack([np.minimum(x, y)[ok], np.maximum(x, y)[ok]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]]
            now.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8).reshape(-1, MINI))
            heads = [x + [none] * (HEADS - len(x)) for x in batch.column(5).to_pylist()]
            now.append(np.array(heads, dtype=np.int64).reshape(-1, HEADS))
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0
            held = [c[cut:] for c in now]
            if cut:
                out = pairs_of(*[c[:cut] for c in now])
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])
        if held is not None and len(held[0]):
            out = pairs_of(*held)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])
        tidy()

    dealt = postings.select("t", "id", "n", "pos", "mini", "heads").repartition("t").sortWithinPartitions("t")
    return dealt.mapInArrow(paired, "a long, b long").distinct()


def _near_enough(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """Pairs whose binned counts differ by no more than sets that link can."""
    slim = materialize(sets.select("id", "n", "bins"), "jaccard-bins")
    left = slim.toDF("a", "na", "ba")
    right = slim.toDF("b", "nb", "bb")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            raw = [batch.column(i).to_pylist() for i in (4, 5)]
            shape = np.array([[len(x), len(y)] for x, y in zip(*raw, strict=True)]).reshape(-1, 2)
            ok = np.zeros(len(na), dtype=bool)
            for ka, kb in np.unique(shape, axis=0):
                at = np.flatnonzero((shape[:, 0] == ka) & (shape[:, 1] == kb))
                for part in np.array_split(at, -(-len(at) * int(max(ka, kb)) // (1 << 20))):
                    x, y = (
                        np.frombuffer(b"".join([r[i] for i in part]), dtype=np.uint8).reshape(len(part), -1).astype(np.int64)
                        for r in raw
                    )
                    k = int(min(ka, kb))
                    far = np.abs(_folded(x, k) - _folded(y, k)).sum(axis=1)
                    ok[part] = far <= na[part] + nb[part] - 2 * least_overlap(na[part], nb[part], num)
            yield batch.select(["a", "b"]).filter(pa.array(ok))
        tidy()

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ba", "bb")
    return joined.mapInArrow(bounded, "a long, b long")


def _resolve(docs: DataFrame, clusters: DataFrame, width: int, num: int) -> DataFrame:
    """Edges (a, b) that span the links inside each cluster of (node, component, blocks)."""
    ids = clusters.select(F.col("node").alias("id"), "component", "blocks")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    read = docs.join(ids, "id").select("id", "component", "blocks", "text")

    names = ["c", "i", "j", "own", "id", "t"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

        for batch in batches:
            rows, size = [], 0
            ids, comps, blocks = (batch.column(i).to_pylist() for i in range(3))
            for i, c, k, t in zip(ids, comps, blocks, shingle_sets(batch.column(3), width), strict=True):
                own = int(mix(np.array([i], dtype=np.int64).view(np.uint64))[0] % np.uint64(k))
                raw = t.tobytes()
                for other in range(k):
                    rows.append((c, min(own, other), max(own, other), own, i, raw))
                    size += len(raw)
                    if size > 16 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
            yield batch_of(rows)
        tidy()

    def forest(ids, own, tokens, i, j):
        """What the links between the blocks (or within the one block) join, as edges to the first of each group."""
        sizes = np.array([len(t) for t in tokens])
        flat, index = np.unique(np.concatenate(tokens), return_inverse=True)
        row = np.repeat(np.arange(len(tokens)), sizes)
        shared = np.bincount(index, minlength=len(flat))[index] > 1
        row, index = row[shared], np.unique(index[shared], return_inverse=True)[1]
        order = np.argsort(index, kind="stable")
        row, index = row[order], index[order]
        common = np.zeros((len(tokens), len(tokens)), dtype=np.float32)
        width = max(1, 4_000_000 // len(tokens))
        top = int(index[-1]) + 1 if len(index) else 0
        for at in range(0, top, width):
            a, b = np.searchsorted(index, [at, at + width])
            m = np.zeros((len(tokens), min(width, top - at)), dtype=np.float32)
            m[row[a:b], index[a:b] - at] = 1
            common += m @ m.T
        common = np.rint(common).astype(np.int64)
        linked = (100 + num) * common >= num * (sizes[:, None] + sizes[None, :])
        linked &= (own[:, None] == i) & (own[None, :] == j)
        linked |= linked.T
        label = np.arange(len(tokens))
        while True:
            lower = np.minimum(label, np.where(linked, label[None, :], len(tokens)).min(axis=1))
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
        return [(int(ids[x]), int(ids[y])) for x, y in enumerate(label) if x != y]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out():
            if len(held) < 2:
                return []
            return forest([h[0] for h in held], np.array([h[1] for h in held]), [h[2] for h in held], key[1], key[2])

        def batch_of(edges):
            return pa.RecordBatch.from_arrays(
                [pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            edges = []
            for c, i, j, own, doc, raw in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if key != (c, i, j):
                    edges += out()
                    key, held = (c, i, j), []
                if not any(doc == h[0] and raw == h[3] for h in reversed(held[-2:])):
                    held.append((doc, own, np.frombuffer(raw, dtype=np.uint64), raw))
            yield batch_of(edges)
        yield batch_of(out())
        held = []
        tidy()

    rows = read.mapInArrow(dealt, "c long, i int, j int, own int, id long, t binary")
    return (
        rows.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "id").mapInArrow(linked, "a long, b long")
    )


def _unnamed(scanned: DataFrame) -> DataFrame:
    """scanned with column given, the id, and id made null where rows with that id have different sets."""
    found = scanned.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("n", "s1", "s2")).alias("lo"), F.max(F.struct("n", "s1", "s2")).alias("hi"))
    several = materialize(found.where("lo <> hi").select(F.col("id").alias("several")), "jaccard-several")
    out = scanned.withColumn("given", F.col("id"))
    n = several.count()
    if not n:
        return out
    several = F.broadcast(several) if n <= BROADCAST_IDS else several
    return out.join(several, F.col("id") == F.col("several"), "left").withColumn("id", F.expr("if(several IS NULL, id, NULL)")).drop("several")


def jaccard_groups(docs: DataFrame, width: int = 5, num: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links), named (false where
    the id is null or several sets of shingles carry it)."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    late, small = fit_order(slim, width, num)
    for again in range(RESCANS + 1):
        scanned = materialize(scan_sets(slim, width, num, small, late), "jaccard-sets")
        stored, scanned = scanned, _unnamed(scanned)
        classes = materialize(
            scanned.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")), "jaccard-classes"
        )
        reps = classes.where("rep IS NOT NULL").select(F.col("rep").alias("id"), "n", "s1", "s2")
        sets = materialize(
            scanned.join(reps, ["id", "n", "s1", "s2"], "left_semi").dropDuplicates(["id", "n", "s1", "s2"]).drop("s1", "s2", "given"),
            "jaccard-reps",
        )
        posted = sets.select("id", "n", F.posexplode("post").alias("pos", "t"))
        lists = materialize(_marked(posted.groupBy("t").count().where("count > 1"), late), "jaccard-lists")
        long = lists.where(f"NOT late AND count > {SHORT}")
        held = long.agg(F.sum("count")).first()[0] or 0
        if again == RESCANS or held <= LONG_SHARE * sets.count() or len(late) >= ORDER_TOKENS:
            break
        more = long.orderBy(F.desc("count"), "t").limit(ORDER_TOKENS - len(late))
        late = np.union1d(late, _hashes(more))
        discard(stored, classes, sets, lists)
    met = materialize(
        posted.join(lists, "t").withColumn("crowded", F.expr(f"count > {BLOCK} OR late AND count > {SHORT}")), "jaccard-postings"
    )
    short = met.where("NOT crowded")
    heads = short.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("h"))
    heads = heads.select("id", "n", F.slice("h", 1, HEADS)["t"].alias("heads")).join(sets.select("id", "n", "mini"), ["id", "n"])
    short = short.join(materialize(heads, "jaccard-heads"), ["id", "n"])
    pairs = _near_enough(_list_pairs(short, num), sets, num)
    crowded = met.where("crowded")
    hubs = materialize(crowded.groupBy("t").agg(F.min("id").alias("hub")), "jaccard-hubs")
    candidates = materialize(pairs.union(crowded.join(hubs, "t").select(F.col("id").alias("a"), F.col("hub").alias("b"))), "jaccard-candidates")
    clusters = connected_components(candidates)
    weighed = clusters.join(sets.select(F.col("id").alias("node"), "n"), "node")
    sized = materialize(
        weighed.groupBy("component").agg(
            F.ceil(F.greatest(F.count("*") / F.lit(float(BLOCK)), F.sum("n") / F.lit(float(BLOCK_SHINGLES)))).cast("int").alias("blocks")
        ),
        "jaccard-sizes",
    )
    clusters = materialize(clusters.join(sized, "component"), "jaccard-clusters")
    edges = materialize(_resolve(slim, clusters, width, num).union(_light_edges(sets)), "jaccard-edges")
    groups = connected_components(edges)
    found = classes.join(groups, classes.rep == groups.node, "left").select(
        "n", "s1", "s2", F.coalesce("component", "rep").alias("component_id")
    )
    discard(met, lists, hubs, candidates, sized, clusters)
    found = materialize(found, "jaccard-groups").toDF("c_n", "c_1", "c_2", "component_id")
    rows = scanned.select("given", "id", "n", "s1", "s2").alias("d")
    return rows.join(
        found, (F.col("n") == F.col("c_n")) & (F.col("s1") == F.col("c_1")) & (F.col("s2") == F.col("c_2")), "left"
    ).select(
        F.col("given").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "given").alias("component_id"),
        F.col("id").isNotNull().alias("named"),
    )


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one document of each group: that with the smallest id.

    Ids that go are broadcast up to BROADCAST_IDS and else joined by shuffle, so texts are shuffled
    only then. Rows with a null id stay. Of rows that share an id and a set of shingles one stays; where rows with
    one id have different sets, all stay, equal texts once.
    """
    groups = materialize(jaccard_groups(docs, width, num, id_col, text).where("doc_id IS NOT NULL"), "jaccard-kept")
    key = "octavo_id"
    while key in docs.columns:
        key += "_"
    repeated = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("named").alias("named")).where("n > 1")
    repeated = materialize(repeated.select(F.col("doc_id").alias(key), "named"), "jaccard-repeated")
    gone = groups.where("named AND doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    ids = F.col(f"`{id_col}`").cast("long")

    def minus(rows: DataFrame, out: DataFrame, how: str) -> DataFrame:
        return rows.join(out, ids == F.col(key), how)

    few = lambda x, n: F.broadcast(x) if n <= BROADCAST_IDS else x
    kept = minus(docs, few(gone, gone.count()), "left_anti")
    many = repeated.count()
    if not many:
        return kept
    once = minus(kept, few(repeated.where("named").select(key), many), "left_semi").dropDuplicates([id_col])
    each = minus(kept, few(repeated.where("NOT named").select(key), many), "left_semi").dropDuplicates([id_col, text])
    return minus(kept, few(repeated.select(key), many), "left_anti").unionByName(once).unionByName(each)


def oracle_sql(width: int, num: int) -> str:
    """DuckDB SQL for jaccard_groups(documents)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH RECURSIVE d AS (
        SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
            '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (
        SELECT DISTINCT id, unnest(CASE WHEN len(w) >= {width}
            THEN list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    shared AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
    links AS (
        SELECT a, b FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b
        WHERE {100 + num} * o >= {num} * (x.n + y.n)),
    reach AS (SELECT id, id AS c FROM d UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id)
    SELECT d.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.c) AS component_id
    FROM d JOIN reach USING (id) LEFT JOIN n USING (id) GROUP BY d.id
    """
