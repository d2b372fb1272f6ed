import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from octavo.llm import neardup, topk
from octavo.llm.components import connected_components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_links(rows, least=0.98):
    """n_links and component of each usable row, by all pairs."""
    use = [i for i, (_, v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for i in use:
        for j in use:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least or (a == b).all():
                    near[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), c, rows[i][0] == c))
    return sorted(out, key=str)


def vectors(seed=0, n=240, d=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = i % 4
        if kind == 0 or not rows:
            v = rng.normal(size=d)
        elif kind == 1:
            v = np.array(rows[0][1]) + 0.02 * rng.normal(size=d)
        elif kind == 2:
            v = np.array(rows[int(rng.integers(0, len(rows)))][1]) * float(rng.choice([1.0, 2.0]))
        else:
            v = np.array(rows[int(rng.integers(0, len(rows)))][1]) + 0.05 * rng.normal(size=d)
        rows.append((i, [float(x) for x in np.float32(v)], int(i % 3 > 0)))
    return rows


ODD = [
    (None, [1.0] * 12, 1), (1000, [1.0] * 12, 1), (1000, [1.0] * 12, 1), (1001, None, 1), (1002, [0.0] * 12, 1), (1003, [None] + [1.0] * 11, 1),
    (1004, [float("nan")] * 12, 1), (1005, [float("inf")] * 12, 1), (1006, [1.0] * 12, None), (1007, [1.0] * 3, 1), (1008, [], 1), (1009, [1.0] * 12, 0),
]


def test_near_duplicates_equal_brute_force(spark):
    rows = vectors() + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("n", F.lit("n"))
    for size in (None, 30):
        got = sorted((tuple(r) for r in neardup.near_duplicates(df, shard_size=size).collect()), key=str)
        assert [g[:3] for g in got] == [w[:3] for w in brute_links(rows)]
        assert all(r[3] == (r[0] == r[2]) for r in got if r[0] is not None)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    x[:500] = x[0] + 0.05 * rng.normal(size=(500, 24))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = neardup.Graph(unit, np.arange(3000))
    q = unit[rng.choice(3000, 200, replace=False)] + 0.01 * rng.normal(size=(200, 24))
    want = np.argsort(-(q @ unit.T), axis=1)[:, :10]
    recall = [np.mean([len(np.intersect1d(a, b)) / 10 for a, b in zip(graph.search(q, beam)[0], want, strict=True)]) for beam in (32, 128)]
    assert graph.top >= 2 and recall[1] >= recall[0] and recall[0] > 0.85 and recall[1] > 0.95


def exact(found, q, x):
    return all(set(f) == set(np.flatnonzero(w)) for f, w in zip(found, neardup.cosines(q, x) >= 0.98, strict=True))


def test_crowded_beams_lose_nothing():
    """A shard where a narrow beam loses links still gives all of them."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=32)
    x = np.concatenate([base + 0.02 * rng.normal(size=(900, 32)), rng.normal(size=(1200, 32))])
    shard = neardup.Shard(x, np.arange(len(x)))
    found, missed = shard.links(x[:64], 0.98)
    assert exact(found, x[:64], x) and missed.min() > 0


def test_sparse_links_are_not_lost(monkeypatch):
    """No evenly picked query has a link other than itself, and the graph finds nothing."""
    monkeypatch.setattr(neardup.Graph, "search", lambda self, q, beam, layer=0: (np.full((len(q), beam), -1), np.full((len(q), beam), -3.0)))
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(1024, 32)), rng.normal(size=(512, 32))
    linked = np.setdiff1d(np.arange(512), np.linspace(0, 511, neardup.AUDITED).astype(int))
    q[linked] = x[linked] + 0.05 * rng.normal(size=(len(linked), 32))
    shard = neardup.Shard(x, np.arange(len(x)))
    for _ in range(12):
        found, _ = shard.links(q, 0.98)
        assert exact(found, q, x)
    assert shard.beam == neardup.BEAMS[-1] and not shard.trusted()


def test_beam_is_relied_on_after_enough_links():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1024, 16))
    shard = neardup.Shard(x, np.arange(len(x)))
    found, _ = shard.links(x, 0.98, own=np.arange(len(x)))
    assert [f.tolist() for f in found] == [[i] for i in range(len(x))]
    assert shard.audited == 0  # hits on itself are no evidence
    for k in range(2):
        found, missed = shard.links(x + 0.01 * rng.normal(size=x.shape), 0.98)
        assert np.mean([i in f for i, f in enumerate(found)]) >= 0.999
    assert shard.trusted() and shard.beam == 32 and (missed < 0).sum() > 900


def test_joined_groups():
    joined = neardup.Joined(8)
    joined.add([np.array([5, 6]), np.array([1, 2]), np.array([4])])
    joined.add([np.array([2, 6]), np.array([], dtype=np.int64), np.array([7, 3])])
    assert joined.label.tolist() == [0, 1, 1, 3, 4, 1, 1, 3]


def test_graphs_serve_shards_of_thousands(spark):
    """Three shards of over 2,000: links by all pairs, and what the graphs find of them without audits."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(3500, 24))
    x = np.float32(np.concatenate([base, base[rng.integers(0, 3500, 3000)] + 0.03 * rng.normal(size=(3000, 24))]))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    found = sorted(map(tuple, neardup.near_duplicates(df, shard_size=2200, audits=True).collect()))
    near = neardup.cosines(x.astype(float), x.astype(float)) >= 0.98
    label = np.arange(len(x))
    while ((lower := np.where(near, label, len(x)).min(axis=1)) != label).any():
        label = lower
    recall = 1 - sum(r[5] for r in found) / sum(r[4] for r in found)
    assert sum(r[4] for r in found) > 3000 and recall > 0.99
    assert np.mean([r[1] == n for r, n in zip(found, near.sum(axis=1) - 1, strict=True)]) > 0.999
    assert np.mean([r[2] == c for r, c in zip(found, label, strict=True)]) > 0.999


def brute_top(rows, every, k):
    """query_id, rank, vec_id, score of each distinct query, in Python's integers; scores are cut to a long."""
    use = [(i, tuple(math.floor(x * 1024) if abs(x) < 1e200 else int(x) * 1024 for x in map(float, v))) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in {x for x in use if x[0] % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in use if j != i and len(v) == len(q))
        out += [(i, r + 1, j, max(topk.LEAST, min(topk.LARGEST, -s))) for r, (s, j) in enumerate(scored[:k])]
    return Counter(out)


DOUBLES = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("room", "sample"), [(1 << 20, 4096), (500, 64)])
def test_top_k_equals_brute_force(spark, monkeypatch, room, sample):
    monkeypatch.setattr(topk, "SAMPLE", sample)
    rows = vectors(3, 400) + [r for r in ODD if r[0] != 1000] + [(1010, [2.0] * 3, 1), (1011, [0.5] * 12, 1), (1011, [0.5] * 12, 1), (1020, [0.5] * 12, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit(1)).withColumn("id", F.lit("x"))
    found = topk.top_k(df, F.col("id") % 10 == 0, k=10, group_bytes=room, chunk_bytes=room)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    single = [(i, [None if x is None else float(np.float32(x)) for x in v] if v else v, y) for i, v, y in rows]
    assert Counter(map(tuple, found.collect())) == brute_top(single, 10, 10)
    assert topk.top_k(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_top_k_keeps_large_components_and_all_lengths(spark):
    rng = np.random.default_rng(5)
    large = [(i, [float(x) for x in rng.normal(size=6) * 10.0 ** int(rng.choice([0, 3, 6, 8, 12]))], 0) for i in range(200)]
    large += [(300 + i, [float(x) for x in rng.normal(size=2) * 10.0 ** (40 * i)], 0) for i in range(8)] + [(500, [300000.0, 0.0], 0), (501, [2.0, 1.0], 0)]
    large += [(510, [1.7e308, -1.7e308, 1.0], 0), (520, [1.7e308, 1.7e308, -1.0], 0), (521, [-1.0, 0.0, 5e-324], 0)]
    lengths = [(1000 + 10 * n + j, [float(x) for x in rng.normal(size=n)], 0) for n in range(13, 1113) for j in (0, 1)]
    found = topk.top_k(spark.createDataFrame(large + lengths, DOUBLES), F.col("id") % 10 == 0, k=5)
    assert Counter(map(tuple, found.collect())) == brute_top(large + lengths, 10, 5)


def test_top_k_replicates_only_what_groups_need(spark):
    """Clustered vectors: several groups, each given a part of the data, and the bounds lose nothing."""
    rng = np.random.default_rng(0)
    centres = np.concatenate([np.eye(6), -np.eye(6)]) * 40
    x = centres[rng.integers(0, 12, 4000)] + rng.normal(size=(4000, 6)) / 10
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    data = topk.usable_vectors(spark.createDataFrame(rows, DOUBLES), "vec_id", "embedding").cache()
    asked = data.where("id % 20 = 0").withColumn("number", F.col("id"))
    plans, celled = topk.plan_join(data, asked, 10)
    plan, whole = plans[6], np.floor(x * 1024)
    cells = {r.id: r.cell for r in celled.collect()}
    assert plan.queries.sum() == 200 and plan.group.max() >= 3
    need = plan.needed(whole)
    sent = sum(need[(plan.group == g) & (plan.queries > 0)].any(axis=0).sum() for g in range(plan.group.max() + 1))
    assert sent < 2 * len(x) and need[plan.queries > 0].mean() < 0.4
    for i in range(0, 4000, 20):
        scores = whole @ whole[i]
        scores[i] = -np.inf
        assert all(need[cells[i], j] for j in np.argsort(-scores)[:10])
    found = topk.top_k(spark.createDataFrame(rows, DOUBLES), F.col("id") % 400 == 0, k=10, group_bytes=480)
    assert Counter(map(tuple, found.collect())) == brute_top(rows, 400, 10)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, j) for j in range(101, 140)] + [(200, 200), (None, 5), (300, 301), (301, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
