import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from octavo.functions import boxes, encoding
from octavo.operators import boxsums, cloud, hierarchy, lod, neighbors, octree
from octavo.sources import store

POINT = "x double, y double, z double, r int, g int, b int"


def make(spark, places):
    return spark.createDataFrame([(*map(float, p), 1, 2, 3) for p in places], POINT)


@pytest.fixture(scope="module")
def random_cloud(spark):
    rng = np.random.default_rng(5)
    p = np.round(np.concatenate([rng.random((1500, 3)) * 8, 3 + rng.random((900, 3)) * 0.3]), 3)
    return make(spark, np.concatenate([p, p[:40]])).cache()


def test_grid_lod_keeps_every_point_once_and_respects_capacity(random_cloud):
    c = cloud.measure(random_cloud)
    corner, side = c.grown()
    found = lod.grid_lod(random_cloud, corner, side, cells=4, max_level=6).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter(tuple(r) for r in random_cloud.collect())
    sizes = Counter((r.level, r.node_key) for r in found)
    assert all(n <= 64 for (level, _), n in sizes.items() if level < 6)
    nodes = {k for _, k in sizes}
    assert all(k[:-1] in nodes for k in nodes if len(k) > 1)
    assert all(len(r.node_key) == r.level + 1 for r in found)


def test_grid_lod_against_insertion(random_cloud):
    """The same filter, written out for one node after the other."""
    c = cloud.measure(random_cloud)
    corner, side = c.grown()
    cells, deepest = 4, 4
    want = Counter()
    rest = [tuple(r) for r in random_cloud.collect()]
    for level in range(deepest + 1):
        width = side / cells / 2**level
        nodes: dict = {}
        for p in rest:
            cell = tuple(int((v - m) // width) for v, m in zip(p, corner, strict=False))
            nodes.setdefault(tuple(i // cells for i in cell), []).append((cell, p))
        rest = []
        for node, members in nodes.items():
            if len(members) <= cells**3 or level == deepest:
                want.update((level, p) for _, p in members)
                continue
            best: dict = {}
            for cell, p in members:
                d = sum((v - ((i + 0.5) * width + m)) ** 2 for v, i, m in zip(p, cell, corner, strict=False)) ** 0.5
                best.setdefault(cell, []).append((d, p))
            for ranked in best.values():
                ranked.sort()
                want[(level, ranked[0][1])] += 1
                rest += [p for _, p in ranked[1:]]
    found = lod.grid_lod(random_cloud, corner, side, cells, deepest).collect()
    assert Counter((r.level, tuple(r)[:6]) for r in found) == want


def test_grid_lod_of_one_place(spark):
    """A place that holds all points neither loops nor loses any."""
    found = lod.grid_lod(make(spark, [(1, 1, 1)] * 30 + [(2, 2, 2)]), (0.9, 0.9, 0.9), 1.2, cells=2, max_level=3)
    assert sorted(Counter(r.level for r in found.collect()).items()) == [(0, 2), (1, 1), (2, 1), (3, 27)]


def test_empty_cloud_is_refused(spark):
    with pytest.raises(ValueError):
        cloud.measure(make(spark, []).limit(0))


def test_flat_cloud_has_no_search_length(spark):
    assert cloud.search_summary(make(spark, [(0, 0, 0), (1, 1, 0)])).first().search_length is None


def test_cloud_js(spark):
    import json

    doc = json.loads(cloud.cloud_js(cloud.metadata(make(spark, [(0, 0, 0), (2, 1, 4)]))).first().json)
    assert doc["points"] == 2 and doc["boundingBox"]["uy"] == 4.0 and doc["tightBoundingBox"]["uy"] == 1.0
    assert doc["scale"] == [0.001] * 3


def test_octree_leaves_partition_the_elements(random_cloud):
    c = cloud.measure(random_cloud)
    corner, side = c.grown()
    tree = octree.Split(corner, side, 200, 5)
    parts = octree.leaves(random_cloud, tree)
    rows = parts.orderBy("partition_id").collect()
    assert sum(r.n for r in rows) == random_cloud.count()
    assert [r.partition_id for r in rows] == list(range(len(rows)))
    assert all(r.n <= 200 or r.level == 5 for r in rows)
    assert len(rows) % 7 == 1
    held = octree.assign_partitions(random_cloud, parts, tree).groupBy("partition_id").count().collect()
    assert {r.partition_id: r["count"] for r in held} == {r.partition_id: r.n for r in rows if r.n}
    halo = octree.replicate_halo(random_cloud, parts, tree, 0.5)
    assert halo.where("is_local").count() >= random_cloud.count() and halo.where("NOT is_local").count() > 0


def test_kdb_leaves_hold_the_sample(random_cloud):
    found = octree.kdb_leaves(random_cloud, (0, 0, 0, 8, 8, 8), 300, 8).collect()
    assert sum(r.n for r in found) == random_cloud.count() and all(r.n <= 300 for r in found)


def test_kdb_leaves_hold_all_points(spark):
    """More points than any sample, many of them equal: the tree of the recursion over all of them."""
    rng = np.random.default_rng(5)
    xyz = np.round(rng.uniform(0, 8, size=(26_000, 3)), 2)
    xyz[:6000] = (1.0, 2.0, 3.0)

    def grow(low, high, p, level):
        if len(p) <= 1500 or level >= 6:
            return [(*low, *high, level, len(p))]
        s = high - low
        axis = 0 if s[0] > s[1] and s[0] > s[2] else 1 if s[0] <= s[1] and s[1] > s[2] else 2
        cut = np.sort(p[:, axis])[len(p) // 2]
        at = np.arange(3) == axis
        below = p[:, axis] <= cut
        return grow(low, np.where(at, cut, high), p[below], level + 1) + grow(np.where(at, cut, low), high, p[~below], level + 1)

    cloud = spark.createDataFrame(xyz.tolist(), "x double, y double, z double").repartition(7)
    found = [tuple(r) for r in octree.kdb_leaves(cloud, (0, 0, 0, 8, 8, 8), 1500, 6).collect()]
    assert sum(r[-1] for r in found) == len(xyz)
    assert sorted(found) == sorted(grow(np.zeros(3), np.full(3, 8.0), xyz, 0))


def test_neighbours_against_brute_force(random_cloud):
    side = 0.7
    p = np.array([tuple(r)[:3] for r in random_cloud.collect()])
    near = (np.abs(p[:, None] - p[None]) <= side / 2).all(axis=2)
    want = {tuple(q): (int(row.sum()), np.cov(p[row].T) if row.sum() > 1 else None) for q, row in zip(p, near, strict=True)}
    for r in neighbors.covariances(random_cloud, side).collect():
        n, cov = want[(r.x, r.y, r.z)]
        assert r.n == n
        if cov is None:
            assert r.cxx is None
        else:
            assert np.allclose([r.cxx, r.cxy, r.cxz, r.cyy, r.cyz, r.czz], cov[np.triu_indices(3)], atol=1e-9)


def _dense_cloud(spark):
    """Whole numbers, equal places, edges at exactly half a cube, a place alone, places without coordinates."""
    rng = np.random.default_rng(5)
    p = [(float(rng.integers(-4, 5)), round(float(rng.uniform(-5, 5)), 1), float(rng.normal())) for _ in range(1500)]
    odd = [(90.0, 90.0, 90.0)] * 4 + [(math.nan, 0.0, 0.0)]
    return spark.createDataFrame(p + p[:200] + odd, "x double, y double, z double")


def test_dense_neighbour_counts_without_pairs(spark, monkeypatch):
    p = _dense_cloud(spark)
    want = sorted(map(tuple, neighbors.neighbour_counts(p, 2.0).collect()))
    monkeypatch.setattr(neighbors, "DENSE", 1)
    monkeypatch.setattr(neighbors, "neighbour_pairs", None)  # no pairs from here on
    for group in (2_000_000, 1):  # the widest and the narrowest tiles
        monkeypatch.setattr(neighbors, "GROUP", group)
        found = neighbors.neighbour_counts(p, 2.0)
        assert sorted(map(tuple, found.select("x", "y", "z", "m", "n_neighbors").collect())) == want


def test_dense_covariances_without_pairs(spark, monkeypatch):
    p = _dense_cloud(spark)
    want = sorted(map(tuple, neighbors.covariances(p, 2.0).collect()))
    monkeypatch.setattr(neighbors, "DENSE", 1)
    monkeypatch.setattr(neighbors, "neighbour_pairs", None)
    found = sorted(map(tuple, neighbors.covariances(p, 2.0).collect()))
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(found, want, strict=True):
        assert all(u == v if v is None else abs(u - v) < 1e-12 for u, v in zip(a[5:], b[5:], strict=True))
    assert [r[5:] for r in found if r[0] == 90.0] == [(0.0,) * 6]


def test_dense_normals_without_pairs(spark, monkeypatch):
    p = _dense_cloud(spark)
    want = sorted(map(tuple, neighbors.normals(p, 2.0, 1e-3).collect()))
    monkeypatch.setattr(neighbors, "DENSE", 1)
    monkeypatch.setattr(neighbors, "neighbour_pairs", None)
    found = sorted(map(tuple, neighbors.normals(p, 2.0, 1e-3).collect()))
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.abs(np.array([r[5:] for r in found]) - np.array([r[5:] for r in want])).max() < 1e-8


def test_dense_normal_lines_without_pairs(spark, monkeypatch):
    p = _dense_cloud(spark)
    lines = lambda: sorted(r.value for r in neighbors.normal_lines(neighbors.normals(p, 2.0, 1e-3), digits=3).collect())
    want = lines()
    monkeypatch.setattr(neighbors, "DENSE", 1)
    monkeypatch.setattr(neighbors, "neighbour_pairs", None)
    assert lines() == want and len(want) == 1704


def _steps(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0]


def test_dense_normals_take_one_shuffle_and_compiled_code(spark, monkeypatch):
    """Points are dealt to tiles once, equal ones too; the closed form is no Spark expression, which would not be compiled."""
    monkeypatch.setattr(neighbors, "DENSE", 1)
    steps = _steps(neighbors.normals(_dense_cloud(spark), 2.0, 1e-3))
    assert steps.count("Exchange ") == 1 and "ACOS" not in steps.upper() and "MapInArrow" in steps


def test_dense_normal_lines_take_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "DENSE", 1)
    lines = neighbors.normal_lines(neighbors.normals(_dense_cloud(spark), 2.0, 1e-3), digits=3)
    assert _steps(lines).count("Exchange ") == 1 and lines.count() == 1704


def test_dense_normals_are_one_python_stage(spark, monkeypatch):
    """Rows go to Python once, and are sorted by one number."""
    monkeypatch.setattr(neighbors, "DENSE", 1)
    steps = _steps(neighbors.normals(_dense_cloud(spark), 2.0, 1e-3))
    assert "FlatMapGroups" not in steps and steps.count("MapInArrow") == 1 and steps.count("Sort [") == steps.count("Sort [tile") == 1


def test_places_that_many_points_share_are_counted_first(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LOOKED", 4)
    monkeypatch.setattr(neighbors, "DENSE", 1)
    p = _dense_cloud(spark)
    shared = p.crossJoin(spark.range(20)).drop("id")
    assert neighbors.tiling(p, 2.0).few and not neighbors.tiling(shared, 2.0).few
    lines = lambda c: sorted(r.value for r in neighbors.normal_lines(neighbors.normals(c, 2.0, 1e-3), digits=3).collect())
    counts = lambda c: sorted(map(tuple, neighbors.neighbour_counts(c, 2.0).collect()))
    assert [(*r[:3], 20 * r[3], 20 * r[4]) for r in counts(p)] == counts(shared)
    found = lines(shared)
    monkeypatch.setattr(neighbors, "DENSE", 10**9)  # pairs
    assert found == lines(shared) and len(found) == 20 * 1704


def test_tiles_too_far_apart_for_one_number(spark, monkeypatch):
    far = spark.createDataFrame([(1e12, -1e12, 1e12), (-1e12, 1e12, 3e18)], "x double, y double, z double")
    p = _dense_cloud(spark).union(far)
    want = sorted(map(tuple, neighbors.neighbour_counts(p, 2.0).collect()))
    monkeypatch.setattr(neighbors, "DENSE", 1)
    assert neighbors.tiling(p, 2.0).grid is None
    assert sorted(map(tuple, neighbors.neighbour_counts(p, 2.0).select("x", "y", "z", "m", "n_neighbors").collect())) == want


def test_some_hundred_pairs_a_point_are_not_made(spark):
    """The join is slower than sums over tiles from there on: 40 places in a cube of the search, as in lineitem of sf0.1."""
    p = np.random.default_rng(8).uniform(0, 8, (2560, 3))
    cloud = spark.createDataFrame([tuple(map(float, r)) for r in p], "x double, y double, z double")
    assert neighbors.tiling(cloud, 2.0) and not neighbors.tiling(cloud.limit(500), 2.0)


def test_box_sums_by_runs_equal_those_by_a_tree(monkeypatch):
    rng = np.random.default_rng(4)
    places = np.unique(np.column_stack([rng.integers(0, 9, 3000) * 1.0, rng.uniform(0, 8, 3000), rng.integers(0, 300, 3000) / 50]), axis=0)
    m, asked = rng.integers(1, 5, len(places)), np.arange(0, len(places), 3)
    n, sums = boxsums.moments(places, m, asked, 1.0)
    monkeypatch.setattr(boxsums, "SPANS", 0)
    for found, want in zip((n, sums), boxsums.moments(places, m, asked, 1.0), strict=True):
        assert (found == want).all()


def test_box_sums_hold_where_prefix_sums_wrap():
    """Many groups far apart: each cube's sums are near 64 bits, sums over all are far beyond."""
    rng = np.random.default_rng(2)
    places = np.unique(np.concatenate([rng.uniform(0, 1, (40, 3)) + [4.0 * k, 0.0, 0.0] for k in range(200)]), axis=0)
    m = rng.integers(1, 1000, len(places))
    n, sums = boxsums.moments(places, m, np.arange(len(places)), 1.0)
    for i in range(0, len(places), 97):
        near = (np.abs(places - places[i]) <= 1.0).all(axis=1)
        d, w = places[near].astype(np.longdouble) - places[i], m[near]
        want = [*(w[:, None] * d).sum(axis=0), *[(w * d[:, a] * d[:, b]).sum() for a, b in boxsums.PAIRS]]
        assert n[i] == w.sum() and np.abs(np.array(want) - sums[i]).max() < 1e-6  # of 3e9 from the middle


def test_normals_of_a_plane(spark):
    plane = make(spark, [(i, j, 0.5 * i) for i, j in itertools.product(range(8), repeat=2)])
    n = np.array([0.5, 0, -1]) / np.sqrt(1.25)
    for r in neighbors.normals(plane, 4.0).collect():
        assert abs(abs(np.dot(n, [r.normal_x, r.normal_y, r.normal_z])) - 1) < 1e-9
    lonely = neighbors.normals(make(spark, [(0, 0, 0), (9, 9, 9)]), 1.0)
    assert all((r.normal_x, r.normal_y, r.normal_z) == (0, 0, 0) for r in lonely.collect())
    assert neighbors.normal_lines(lonely).orderBy("value").first().value == "0.0 0.0 0.0[0.0, 0.0, 0.0]"
    with pytest.raises(ValueError):
        neighbors.neighbour_pairs(plane, 0.0)


def test_normals_are_least_eigenvectors(random_cloud):
    found = neighbors.normals(random_cloud, 1.5).join(neighbors.covariances(random_cloud, 1.5).drop("n", "m"), ["x", "y", "z"]).collect()
    checked = 0
    for r in found:
        if r.n < 3:
            assert (r.normal_x, r.normal_y, r.normal_z) == (0, 0, 0)
            continue
        w, v = np.linalg.eigh([[r.cxx, r.cxy, r.cxz], [r.cxy, r.cyy, r.cyz], [r.cxz, r.cyz, r.czz]])
        assert abs(r.spread_gap - (w[1] - w[0]) / w[2]) < 1e-6
        if r.spread_gap > 1e-3:
            got = np.array([r.normal_x, r.normal_y, r.normal_z])
            assert abs(abs(v[:, 0] @ got) - 1) < 1e-7 and got[np.abs(got).argmax()] > 0
            checked += 1
    assert checked > 100


def test_odd_points_have_no_place(spark):
    """Null and NaN coordinates are left out, clashing columns pass through, one place alone is a cloud."""
    nan = float("nan")
    rows = [(1.0, 2.0, 3.0), (1.0, 2.0, 3.0), (2.0, 3.0, 5.0), (None, 1.0, 1.0), (nan, 1.0, 1.0), (1.0, None, 2.0), (0.0, 0.0, nan)]
    p = spark.createDataFrame([(*r, i, 0, 0) for i, r in enumerate(rows)], "x double, y double, z double, r int, g int, b int")
    clash = p
    for name in ("octavo_box", "search", "deep_key", "stays", "n", "level", "node_key", "partition_id", "region"):
        clash = clash.withColumn(name, F.lit(name))
    tree = octree.Split((0.0, 0.0, 0.0), 8.0, 1, 3)
    parts = octree.leaves(clash, tree)
    assert parts.agg(F.sum("n")).first()[0] == 3
    held = octree.assign_partitions(clash, parts, tree)
    assert sorted(r.r for r in held.collect()) == [0, 1, 2] and {"search", "stays", "region"} <= set(held.columns)
    halo = octree.replicate_halo(clash.drop("octavo_box"), parts, tree, 0.5)
    assert {r.r for r in halo.where("is_local").collect()} == {0, 1, 2}
    assert sorted((r.r, r.level) for r in lod.grid_lod(clash, (0.0, 0.0, 0.0), 8.0, 2, 3, 1).collect())[-1][0] == 2
    assert {(r.x, r.n_neighbors) for r in neighbors.neighbour_counts(clash, 1.0).collect()} == {(1.0, 2), (2.0, 1)}
    assert octree.kdb_leaves(clash, (0, 0, 0, 8, 8, 8), 1, 3).agg(F.sum("n")).first()[0] == 3
    alone = p.where("r < 2")
    flat = octree.Split((1.0, 2.0, 3.0), 0.0, 1, 2)
    assert octree.replicate_halo(alone, octree.leaves(alone, flat), flat, 1.0).count() > 0
    assert lod.grid_lod(alone, (1.0, 2.0, 3.0), 0.0, 2, 2, 1).count() == 2
    assert octree.leaves(p.limit(0), tree).count() == 1 and octree.assign_partitions(p.limit(0), parts, tree).count() == 0
    assert neighbors.normals(p.limit(0), 1.0).count() == 0 and lod.grid_lod(p.limit(0), (0.0, 0.0, 0.0), 8.0).count() == 0


def test_boxes_of_all_sizes_find_their_leaves(spark, random_cloud):
    """Every leaf that a box touches, by comparing all; the join has no nested loop."""
    tree = octree.Split((0.0, 0.0, 0.0), 8.0, 40, 5)
    parts = octree.leaves(random_cloud, tree)
    rng = np.random.default_rng(3)
    low = np.round(rng.uniform(-1, 9, size=(200, 3)), 1)
    side = np.round(rng.choice([0.0, 0.1, 0.5, 1.0, 4.0, 9.0], size=(200, 1)) * rng.uniform(0.5, 1, size=(200, 3)) * 4) / 4
    rows = [(i, *map(float, a), *map(float, a + s)) for i, (a, s) in enumerate(zip(low, side, strict=True))] + [(200, 0.0, 0.0, 0.0, 4.0, 4.0, 4.0), (201, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0)]
    objects = spark.createDataFrame(rows, "i int, " + ", ".join(f"{f} double" for f in boxes.FIELDS))
    objects = objects.select("i", boxes.box(*[F.col(f) for f in boxes.FIELDS]).alias("box"))
    found = octree.lookup_partitions(objects, parts, tree)
    leaves = parts.collect()
    assert len(leaves) > 50 and len({r.level for r in leaves}) > 1
    want = {(i, p.partition_id) for i, *b in rows for p in leaves if all(p.region[k] <= b[k + 3] and p.region[k + 3] >= b[k] for k in range(3))}
    got = [(r.i, r.partition_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    halo = octree.replicate_halo(random_cloud, parts, tree, 0.5)
    for df in (found, halo):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_rows_repeat_in_runs(spark):
    from octavo.plans.tables import repeat_rows

    df = spark.createDataFrame([("a", 1), ("b", 10), ("c", 11), ("d", 0)], "k string, n long")
    assert {r.k: r["count"] for r in repeat_rows(df, "n", run=5).groupBy("k").count().collect()} == {"a": 1, "b": 10, "c": 11}


SAMPLE_MASKS = {"r": 66, "r1": 4, "r2": 18}


def test_masks(spark):
    nodes = spark.createDataFrame([(k, 1) for k in ("r", "r1", "r6", "r12", "r21", "r24", *[f"r6{d}" for d in range(8)])], "node_key string, n long")
    got = {r.parent_key: r for r in hierarchy.sibling_families(nodes).collect()}
    assert {k: got[k].mask for k in SAMPLE_MASKS} == SAMPLE_MASKS
    assert got["r6"].merged and (got["r6"].left_bottom, got["r6"].right_top) == ("r60", "r67") and not got["r"].merged


def test_index_has_missing_ancestors_and_bytes(spark):
    index = hierarchy.hierarchy_index(spark.createDataFrame([("r01", 95), ("r", 3)], "node_key string, n long"))
    assert {r.node_key: (r.mask, r.n, r.count_code) for r in index.collect()} == {"r": (1, 3, 3), "r0": (2, 0, 0), "r01": (0, 95, 0x1A)}
    assert hierarchy.index_bytes(index) == bytes([1, 3, 2, 0, 0, 0x1A])
    files = spark.createDataFrame([("/a/0r.bin",), ("/a/1r3.bin",), ("/a/r.hrc",)], "path string")
    assert hierarchy.index_bytes(hierarchy.index_of_files(files).withColumn("count_code", F.lit(0)), counts=False) == bytes([8, 0])


def test_records_decode_within_the_scale(random_cloud):
    c = cloud.measure(random_cloud)
    keyed = lod.with_node_keys(random_cloud.withColumn("level", F.lit(0)), c.corner, c.side, 2)
    blobs = store.node_blobs(store.encode_points(keyed, c.corner, c.side, 0.001), lod.node_counts(keyed))
    got = sorted(encoding.decode_records(bytes.fromhex(blobs.first().payload), c.corner, 0.001))
    want = sorted(tuple(r) for r in random_cloud.collect())
    a, b = np.array([g[:3] for g in got]), np.array([w[:3] for w in want])
    assert len(a) == len(b) and np.abs(np.sort(a, axis=0) - np.sort(b, axis=0)).max() < 0.0011


def test_a_large_node_is_one_row(spark, monkeypatch):
    """A node of more points than a part holds has one payload, all records in order, however ranges cut it."""
    from octavo.plans import catalog

    n = store.PART_POINTS + 5000
    x = (F.col("id") % 70_000) / 16384.0  # 536 places twice
    points = spark.range(n).select(x.alias("x"), x.alias("y"), x.alias("z"), *[F.lit(7).alias(a) for a in "rgb"], F.lit(0.0).alias("u"))
    monkeypatch.setattr(catalog, "_points", lambda *_: points)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several ranges
    try:
        found = catalog.blob_table(spark, "").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.node_key, r.part, r.n) for r in found] == [("r", 0, n)]
    keyed, c = catalog._keyed(spark, "")
    records = sorted(r.record for r in store.encode_points(keyed, c.corner, c.side, cloud.SCALE).collect())
    assert found[0].payload == "".join(records) and found[0].size == len(found[0].payload) // 2


def test_hot_node_is_dealt_to_parts(spark, random_cloud):
    """Parts are bounded, also where one point fills a node, and the order of the rows does not matter."""
    c = cloud.measure(random_cloud)
    same = spark.range(2000).select(*[F.lit(v).alias(a) for v, a in zip((1.0, 1.0, 1.0), "xyz", strict=True)], *[F.lit(5).alias(a) for a in "rgb"])
    points = random_cloud.select("x", "y", "z", "r", "g", "b").union(same)

    def dealt(rows):
        keyed = lod.with_node_keys(rows.withColumn("level", F.lit(0)), c.corner, c.side, 1)
        found = store.node_blobs(store.encode_points(keyed, c.corner, c.side, 0.001), lod.node_counts(keyed), part_points=500)
        return sorted((b.part, b.n, b.payload) for b in found.collect())

    blobs = dealt(points)
    n = points.count()
    assert len(blobs) == -(-n // 500) and sum(b[1] for b in blobs) == n and max(b[1] for b in blobs) <= 2000
    assert blobs == dealt(points.orderBy(F.rand(3)).repartition(13))
    got = sorted(p for b in blobs for p in encoding.decode_records(bytes.fromhex(b[2]), c.corner, 0.001))
    assert len(got) == n and sum(p[3:] == (5, 5, 5) for p in got) >= 2000


def test_records_with_normals(spark):
    rows = [(1.0, 2.0, 3.0, 1, 2, 3, "r", 0.5, -0.25, 0.0), (0.0, 0.0, 0.0, 9, 9, 9, "r", -1.0, 1.0, 0.001)]
    df = spark.createDataFrame(rows, "x double, y double, z double, r int, g int, b int, node_key string, u double, v double, w double")
    found = store.encode_points(df, (0.0, 0.0, 0.0), 4.0, 0.001, normal=("u", "v", "w")).collect()
    got = sorted(encoding.decode_records(bytes.fromhex("".join(r.record for r in found)), (0.0, 0.0, 0.0), 0.001, normals=True))
    assert np.allclose(got, sorted((*r[:6], *r[7:]) for r in rows), atol=0.0011)


def test_partitions_of_a_sample(random_cloud):
    c = cloud.measure(random_cloud)
    corner, side = c.grown()
    sample, tree = octree.sampled_split(random_cloud, corner, side, 8, fraction=0.2, seed=3)
    parts = octree.sampled_leaves(random_cloud, corner, side, 8, fraction=0.2, seed=3)
    assert parts.agg(F.sum("n")).first()[0] == sample.count() < random_cloud.count() / 3 and parts.count() >= 8
    assigned = octree.assign_partitions(random_cloud, parts, tree)
    assert assigned.count() == random_cloud.count()
    dealt = octree.repartition_points(assigned, 5).withColumn("task", F.spark_partition_id())
    assert dealt.groupBy("partition_id").agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0


def test_load_order_within_partitions(random_cloud):
    ordered = neighbors.load_order(random_cloud, (0.0, 0.0, 0.0, 8.0, 8.0, 8.0), 2.0).withColumn("part", F.col("load_order") % 3)
    for rows in neighbors.in_load_order(ordered, "part").select("part", "load_order").rdd.glom().collect():
        assert rows == sorted(rows)
