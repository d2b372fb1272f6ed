import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from octavo.operators import cloud, lod
from octavo.sources import las, points, store
from octavo.streaming import ingest


def las_file(path, q, fmt=0, vlrs=(), minor=2, scale=(0.01, -0.01, 0.001), offset=(100.0, 0.0, -5.0)):
    length = {0: 20, 1: 28}.get(fmt, 26)
    body = b"".join(struct.pack("<H16sHH32s", 0, b"me", n, len(c), b"note") + c for n, c in vlrs)
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24], head[25] = 1, minor
    struct.pack_into("<HII", head, 94, 227, 227 + len(body), len(vlrs))
    struct.pack_into("<BHI", head, 104, fmt, length, len(q))
    xyz = np.array(q, dtype=float).reshape(-1, 3) * np.abs(scale) + offset
    low, high = (xyz.min(axis=0), xyz.max(axis=0)) if len(q) else (np.zeros(3), np.zeros(3))
    struct.pack_into("<12d", head, 131, *scale, *offset, *[v for pair in zip(high, low, strict=True) for v in pair])
    rows = b"".join(struct.pack("<3iH", *p, i % 65536).ljust(length, b"\0") for i, p in enumerate(q))
    path.write_bytes(bytes(head) + body + rows)
    return xyz


@pytest.mark.parametrize("minor", [2, 3, 4])
@pytest.mark.parametrize("fmt", [0, 1])
def test_las_points(spark, tmp_path, fmt, minor):
    (tmp_path / "deep").mkdir()
    a = las_file(tmp_path / "a.las", [(i, -i, 2 * i) for i in range(1000)], fmt, [(7, b"abc"), (8, b"")], minor)
    b = las_file(tmp_path / "deep" / "B.LAS", [(5, 6, 7)], fmt, minor=minor)
    las_file(tmp_path / "none.las", [], fmt, minor=minor)
    df = las.read_las(spark, str(tmp_path), records=300)
    assert df.rdd.getNumPartitions() == 5
    got = np.array([(r.x, r.y, r.z) for r in df.collect()])
    assert np.allclose(np.sort(got, axis=0), np.sort(np.concatenate([a, b]), axis=0))
    assert df.agg(F.max("intensity")).first()[0] == 999
    heads = las.las_headers(spark, str(tmp_path))
    merged = cloud.merge_headers(heads.where("points > 0")).first()
    assert merged.points == 1001 and merged.scale == 0.001 and merged.lx == 100.0
    assert [tuple(r)[1:] for r in las.las_vlrs(spark, str(tmp_path)).orderBy("record_id").collect()] == [
        ("me", 7, "note", bytearray(b"abc")),
        ("me", 8, "note", bytearray(b"")),
    ]


def test_other_las_formats_are_refused(spark, tmp_path):
    las_file(tmp_path / "a.las", [(1, 2, 3)], fmt=2)
    with pytest.raises(Exception, match="point format 2"):
        las.read_las(spark, str(tmp_path)).collect()


def test_text_points(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1.000 2.500 0.125 17 255 128 0\n1 2 3 4 5 6 7\nbroken line\n")
    found = points.read_text(spark, str(tmp_path)).orderBy("z").collect()
    assert [tuple(r) for r in found] == [(1.0, 2.5, 0.125, 255, 128, 0), (1.0, 2.0, 3.0, 5, 6, 7)]
    assert points.peek(points.read_text(spark, str(tmp_path)).where("z = 3"))["g"] == 6
    assert points.peek(points.read_text(spark, str(tmp_path)).limit(0)) == {}
    with pytest.raises(Exception):
        points.read_text(spark, str(tmp_path), strict=True).collect()


@pytest.fixture()
def table(spark, tmp_path):
    rows = [
        (f"{len(k) - 1}{k}", "bin", len(k) - 1, k, 0, 1, bytearray(k.encode()))
        for k in ("r", "r0", "r7", "r00", "r05", "r06", "r70", "r051")
    ] + [("r", "hrc", 0, "", 0, None, bytearray(b"\1"))]
    df = spark.createDataFrame(rows, "row_key string, qualifier string, level int, node_key string, part int, n long, value binary")
    store.write_table(df, str(tmp_path / "t"))
    return store.BlobTable(spark, str(tmp_path / "t"))


def test_table_reads(table):
    assert table.payload("1r7", "bin") == b"r7" and table.payload("1r6", "bin") is None and table.payload("r", "hrc") == b"\1"
    assert sorted(r.name for r in table.scan("1r0", "2r05").collect()) == ["1r0-data-bin", "1r7-data-bin", "2r00-data-bin"]
    assert sorted(r.row_key for r in table.children("r0").collect()) == ["2r00", "2r05", "2r06"]
    assert sorted(r.row_key for r in table.children("r0", "56").collect()) == ["2r05", "2r06"]
    with pytest.raises(ValueError):
        table.children("r0", "9]")


def test_table_scan_is_pruned(table):
    plan = table.children("r0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "GreaterThanOrEqual(row_key" in plan


def test_written_rows_keep_their_order(spark, tmp_path):
    """Each file has its rows by key, also where sorts spill and a column is one constant."""
    level = 3 + (F.col("id") % 2).cast("int")
    key = F.concat(level.cast("string"), F.lit("r"), F.lpad(F.conv("id", 10, 8), 4, "0"))
    rows = spark.range(3000).orderBy(F.rand(1)).select(
        key.alias("row_key"), F.lit("bin").alias("qualifier"), level.alias("level"), F.lit("r").alias("node_key"),
        F.lit(0).alias("part"), F.col("id").alias("n"), F.lit(b"x" * 99).alias("value"),
    )
    conf, name = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(name, "50")
    try:
        store.write_table(rows, str(tmp_path / "t"))
    finally:
        conf.remove(name)
    found = spark.read.parquet(str(tmp_path / "t")).select("row_key", "_metadata.file_path", "_metadata.row_index").collect()
    files = {r.file_path for r in found}
    assert len(found) == 3000
    for f in files:
        held = [r.row_key for r in sorted((r for r in found if r.file_path == f), key=lambda r: r.row_index)]
        assert held == sorted(held)


def test_table_changes(table, spark):
    table.delete_row("1r7")
    table.delete_qualifier("r", "hrc")
    assert table.payload("1r7", "bin") is None and table.rows().count() == 7
    table.put(table.rows().where("row_key = '1r0'").withColumn("part", F.lit(1)))
    assert table.payload("1r0", "bin") == b"r0r0"
    table.delete()
    assert not table.exists()


def test_scan_filters_and_families(table):
    assert [r.name for r in table.scan(qualifier="bin", where=F.col("level") == 1).orderBy("name").collect()] == ["1r0-data-bin", "1r7-data-bin"]
    assert table.scan(family="other").count() == 0


def test_a_crash_between_renames_loses_nothing(table, spark):
    """What is set aside is put back; a failed replacement leaves the old table."""
    import os

    before = table.rows().count()
    os.rename(table.path, table.path + store.ASIDE)
    assert table.rows().count() == before and not os.path.exists(table.path + store.ASIDE)
    table.delete_row("1r0")
    assert table.rows().count() == before - 1
    new = store.BlobTable(spark, table.path + "2")
    assert new.rows().count() == 0 and not new.exists()
    new.create()
    new.create()
    assert new.exists() and new.rows().count() == 0
    assert store.list_tables(spark, os.path.dirname(table.path)) == ["t", "t2"]
    assert store.list_tables(spark, "/no/such/folder") == []


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from octavo.plans import tables

    def session(master, named=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named, set=lambda *_: None), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_dir(session(master))
        assert tables.shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert tables.shared_dir(session("local[2]")) and tables.shared_dir(session("local"))


def test_a_folder_left_behind_is_no_subpackage(tmp_path):
    """With the corpus modules deleted and their caches left, the rest imports and has its queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/octavo", tmp_path / "octavo", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "octavo" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) == set(q) and len(q) > 50 and not [n for n in q if n.startswith('op1_')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_files_in_and_out(table, spark, tmp_path):
    (tmp_path / "out").mkdir()
    assert store.write_node_files(table.rows(), str(tmp_path / "out")) == 9
    (tmp_path / "out" / "skip.tmp").write_text("x")
    again = store.import_files(spark, str(tmp_path / "out"))
    key = lambda df: {(r.row_key, r.qualifier, r.level, bytes(r.value)) for r in df.collect()}
    assert key(again) == key(table.rows())


def test_composite_keys(spark):
    got = store.split_composite(spark.createDataFrame([("1r2-data-bin",), ("a",)], "k string"), "k").orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [("1r2", "data", "bin"), ("a", None, None)]


def test_streaming_ingest_equals_its_points_and_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in range(3):
        (tmp_path / "in" / f"{f}.txt").write_text("".join(f"{i % 7} {i % 5} {f} 0 1 2 3\n" for i in range(50)))
    c = cloud.Cloud(150, 0.0, 0.0, 0.0, 6.0, 4.0, 2.0)
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), c, 2).awaitTermination()
        assert ingest.ingested(spark, str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 150


def test_lod_keys_are_prefixes(spark):
    p = spark.createDataFrame([(1.0, 2.0, 3.0, i) for i in range(4)], "x double, y double, z double, level int")
    found = [r.node_key for r in lod.with_node_keys(p, (0.0, 0.0, 0.0), 4.0, 3).orderBy("level").collect()]
    assert all(b.startswith(a) and len(b) == len(a) + 1 for a, b in zip(found, found[1:], strict=False))


def test_small_files(spark, tmp_path):
    from octavo.sources import files

    path = f"{tmp_path}/d/cloud.js"
    files.write_bytes(spark, path, b"{}")
    files.write_bytes(spark, path, bytes(range(256)), append=True)
    assert files.read_bytes(spark, path) == b"{}" + bytes(range(256))
    files.write_bytes(spark, f"{tmp_path}/d/r.hrc", b"\1")
    assert [(r.path.rsplit("/")[-1], r.length) for r in files.list_files(spark, str(tmp_path), ".hrc").collect()] == [("r.hrc", 1)]
    with pytest.raises(Exception):
        files.delete(spark, f"{tmp_path}/d")
    assert files.delete(spark, f"{tmp_path}/d", recursive=True) and not files.exists(spark, path)


def test_interim_records(spark, tmp_path):
    from octavo.sources import files

    (tmp_path / "a.bin").write_bytes(struct.pack("<3d3B", 1.5, -2.0, 3.25, 255, 0, 7) * 2)
    assert [tuple(r) for r in files.read_interim(spark, str(tmp_path)).collect()] == [(1.5, -2.0, 3.25, 255, 0, 7)] * 2
