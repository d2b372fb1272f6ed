"""Queries that write something and read it back, and the same results in SQL from the tables alone.

What they write goes to the shared folder and is deleted when the session ends.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octavo.functions import boxes, encoding, frames, keys
from octavo.operators import cloud, hierarchy, neighbors, octree
from octavo.plans import catalog, oracle
from octavo.plans.catalog import _keyed, _points, _table, _tree
from octavo.plans.tables import materialize, new_path
from octavo.sources import files, las, points, store
from octavo.streaming import ingest

#: Steps and origin of the LAS files; variable records of each; points of one file.
LAS_SCALE, LAS_OFFSET = (0.01, 0.0005, 0.02), (0.0, 0.0, 0.0)
LAS_RECORDS = (("octavo", 7, "note", b"abc"), ("octavo", 8, "empty", b""))
LAS_POINTS = 1 << 16
#: Partitions sought by the sampled tree and the share of points in its sample; tasks and parts of points.
PARTITIONS, SHARE = 16, 0.2
TASKS, PARTS = 8, 5


def _text_folder(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "text-points")
    rows = _points(spark, sf_dir).select("x", "y", "z", F.lit(0).alias("intensity"), "r", "g", "b")
    rows.write.option("sep", " ").csv(path)
    return path


def text_points(spark, sf_dir):
    return points.read_text(spark, _text_folder(spark, sf_dir))


def _las_folder(spark: SparkSession, sf_dir: str) -> str:
    """Points as LAS files, their line numbers as intensities."""
    folder = files.fresh_folder(spark, new_path(spark, "las-points"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = files.open_fs(folder)
        number = 0
        for batch in batches:
            for part in (batch.slice(i, LAS_POINTS) for i in range(0, batch.num_rows, LAS_POINTS)):
                q = np.column_stack([np.floor(part.column(i).to_numpy() / s + 0.5) for i, s in enumerate(LAS_SCALE)]).astype(np.int64)
                data = las.encode_file(q, part.column(3).to_numpy(), LAS_SCALE, LAS_OFFSET, LAS_RECORDS)
                name = f"{at}/{TaskContext.get().partitionId():05d}-{number:05d}.las"
                with fs.open_output_stream(name, compression=None) as out:
                    out.write(data)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    _points(spark, sf_dir).select("x", "y", "z", "r").mapInArrow(written, "name string").count()
    return folder


def las_points(spark, sf_dir):
    return las.read_las(spark, _las_folder(spark, sf_dir), records=10_000)


def las_headers(spark, sf_dir):
    heads = las.las_headers(spark, _las_folder(spark, sf_dir))
    numbers = [f"{p}{a}" for p in "so" for a in "xyz"]
    bounds = [F.min(f"l{a}").alias(f"l{a}") for a in "xyz"] + [F.max(f"u{a}").alias(f"u{a}") for a in "xyz"]
    return heads.groupBy("version", "format", *numbers).agg(F.sum("points").alias("points"), *bounds)


def las_merged(spark, sf_dir):
    return cloud.merge_headers(las.las_headers(spark, _las_folder(spark, sf_dir)))


def las_records(spark, sf_dir):
    found = las.las_vlrs(spark, _las_folder(spark, sf_dir))
    return found.select("user", "record_id", "description", F.hex("content").alias("content")).distinct()


def interim_points(spark, sf_dir):
    folder = files.fresh_folder(spark, new_path(spark, "interim"))
    files.write_interim(_points(spark, sf_dir), folder)
    return files.read_interim(spark, folder)


def _node_folder(spark: SparkSession, sf_dir: str) -> str:
    folder = files.fresh_folder(spark, new_path(spark, "node-files"))
    store.write_node_files(_table(spark, sf_dir).rows(), folder)
    return folder


def node_files(spark, sf_dir):
    """Node files of a folder, imported as rows of a table."""
    found = store.import_files(spark, _node_folder(spark, sf_dir))
    return found.select("row_key", "qualifier", "level", "node_key", F.hex("value").alias("value"))


def listed_index(spark, sf_dir):
    """Child masks from the names of node files alone."""
    return hierarchy.index_of_files(files.list_files(spark, _node_folder(spark, sf_dir), ".bin"))


def table_changes(spark, sf_dir):
    """A table after a row, a qualifier and a put; of two tables one is deleted."""
    folder = files.fresh_folder(spark, new_path(spark, "tables"))
    store.write_table(_table(spark, sf_dir).rows(), f"{folder}/cloud")
    table, other = store.BlobTable(spark, f"{folder}/cloud"), store.BlobTable(spark, f"{folder}/other")
    other.create()
    made = store.list_tables(spark, folder)
    table.delete_row("1r5")
    table.delete_qualifier("2r12", "bin")
    table.put(spark.createDataFrame([("r", "", 0, None, bytearray(b"\x01\x02"), "hrc", 0)], store.SCHEMA))
    other.delete()
    left = store.list_tables(spark, folder)
    return table.rows().select(
        "row_key", "qualifier", "n", F.length("value").cast("long").alias("size"), F.lit(",".join(made)).alias("made"), F.lit(",".join(left)).alias("left")
    )


def table_order(spark, sf_dir):
    """Rows of a written table, and whether each file has them by key."""
    rows = _table(spark, sf_dir).rows().select("row_key", "part", "_metadata.file_path", "_metadata.row_index")
    before = F.lag(F.struct("row_key", "part")).over(Window.partitionBy("file_path").orderBy("row_index"))
    return rows.select("row_key", "part", F.coalesce(before < F.struct("row_key", "part"), F.lit(True)).alias("ascends"))


def cloud_document(spark, sf_dir):
    """cloud.js as written and read again."""
    path = f"{files.fresh_folder(spark, new_path(spark, 'document'))}/cloud.js"
    files.write_bytes(spark, path, cloud.cloud_js(cloud.metadata(_points(spark, sf_dir))).first().json.encode())
    doc = json.loads(files.read_bytes(spark, path))
    row = {"points": doc["points"], "attributes": ",".join(doc["pointAttributes"]), "scale": doc["scale"][0]}
    row |= {f"tight_{k}": doc["tightBoundingBox"][k] for k in boxes.FIELDS} | {f"cube_{k}": doc["boundingBox"][k] for k in boxes.FIELDS}
    kinds = {"points": "long", "attributes": "string"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in row))


def serve_requests(spark, sf_dir):
    """Answers to requests of all three kinds for nodes that are there and nodes that are not."""
    table = _table(spark, sf_dir)
    known = table.rows().select("row_key", "node_key").union(spark.createDataFrame([("9r7", "r77777777")], "row_key string, node_key string")).distinct()
    http = known.select(F.concat(F.lit("/pointCloudData/PointCloud?binName="), "row_key").alias("request"))
    one = known.select(F.concat(F.lit('{"dataType":"bin","tableName":"PointCloud","dataName":"'), "row_key", F.lit('"}')).alias("request"))
    many = known.where(F.length("node_key") <= 2).select(
        F.concat(F.lit('{"dataType":"bin","tableName":"PointCloud","parentNodeKey":"'), "node_key", F.lit('","childNodeFilterStr":"135"}')).alias("request")
    )
    answers = frames.answer(table.rows(), http.union(one).union(many))
    return answers.select("request", "name", "part", F.hex("payload").alias("payload"), "framed", F.hex(F.substring("frame", 1, 2)).alias("head"))


def little_endian(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    number = (F.col("l_orderkey") * F.col("l_partkey") - 1_000_000) * F.col("l_linenumber")
    coded = lines.select(number.alias("number"), *[encoding.to_little_endian(number, n).alias(f"code{n}") for n in (2, 4, 8)])
    read = [encoding.from_little_endian(F.col(f"code{n}"), n).alias(f"read{n}") for n in (2, 4, 8)]
    return coded.select("*", *read, encoding.from_little_endian(F.col("code2"), 2, signed=False).alias("unsigned2"))


def clod_within(spark, sf_dir):
    """Levels of detail drawn within a given level, in thousandths."""
    leveled = _points(spark, sf_dir).where("u > 0").select("u", F.explode(F.array(*map(F.lit, range(4)))).alias("level"))
    found = [F.when(F.col("level") == k, keys.clod_within(F.col("u"), k, 3, 3)) for k in range(4)]
    detail = F.coalesce(*found)
    return leveled.select("u", "level", F.floor(detail * 1000 + F.lit(0.1234567)).cast("long").alias("detail"), F.floor(detail).cast("int").alias("at"))


def box_constructors(spark, sf_dir):
    x, y, z, s = F.col("x"), F.col("y"), F.col("z"), F.col("supplier").cast("double")
    built = _points(spark, sf_dir).select(
        boxes.from_min_sides(x, y, z, s, s + 1, s + 2).alias("a"),
        boxes.from_centre_sides(x, y, z, s, s + 1, s + 2).alias("b"),
        boxes.of_point(x, y, z).alias("c"),
    )
    return built.select(*[F.col(f"{b}.{f}").alias(f"{b}_{f}") for b in "abc" for f in boxes.FIELDS])


def normal_records(spark, sf_dir):
    """Point records that end with a normal, here made of the uniform number."""
    keyed, c = _keyed(spark, sf_dir)
    normal = {"nx": F.col("u") - 0.5, "ny": 0.5 - F.col("u"), "nz": F.col("u")}
    return store.encode_points(keyed.withColumns(normal), c.corner, c.side, cloud.SCALE, normal=tuple(normal))


def sampled_partitions(spark, sf_dir):
    p = _points(spark, sf_dir)
    corner, side = cloud.measure(p).grown()
    found = octree.sampled_leaves(p, corner, side, PARTITIONS, SHARE, u="u")
    return found.select("partition_id", "node_key", "level", "n")


def dispatched_points(spark, sf_dir):
    """Points of each partition and the tasks that they are dealt to."""
    p = _points(spark, sf_dir)
    tree = _tree(cloud.measure(p))
    assigned = octree.assign_partitions(p, materialize(octree.leaves(p, tree), "leaves"), tree)
    dealt = octree.repartition_points(assigned, TASKS).withColumn("task", F.spark_partition_id())
    return dealt.groupBy("partition_id").agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks"))


def sorted_load_order(spark, sf_dir):
    """Points of each part with their place in it, and whether they come in load order."""
    p = _points(spark, sf_dir)
    c = cloud.measure(p)
    ordered = neighbors.load_order(p, (c.lx, c.ly, c.lz, c.ux, c.uy, c.uz), catalog.GRID).withColumn("part", F.col("supplier") % PARTS)
    seen = neighbors.in_load_order(ordered, "part").select("part", "load_order", F.monotonically_increasing_id().alias("place"))
    seen = materialize(seen, "load-order")
    before = F.lag("load_order").over(Window.partitionBy("part").orderBy("place"))
    checked = seen.withColumn("falls", F.when(before > F.col("load_order"), 1).otherwise(0))
    return checked.groupBy("part").agg(F.count("*").alias("n"), F.sum("falls").alias("falls"), F.min("load_order").alias("first"), F.max("load_order").alias("last"))


def stream_ingest(spark, sf_dir):
    """Text points taken in by a stream, all at the root; run twice, as after a crash."""
    c = cloud.measure(_points(spark, sf_dir))
    source, target, mark = _text_folder(spark, sf_dir), new_path(spark, "ingested"), new_path(spark, "ingest-mark")
    for _ in range(2):
        ingest.ingest(spark, source, target, mark, c, 0).awaitTermination()
    found = ingest.ingested(spark, target)
    return found.groupBy("node_key", "level").agg(F.sum("n").alias("points"), F.sum(F.length("value")).alias("bytes"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    text_points, las_points, las_headers, las_merged, las_records, interim_points, node_files, listed_index, table_changes, table_order,
    cloud_document, serve_requests, little_endian, clod_within, box_constructors, normal_records, sampled_partitions, dispatched_points,
    sorted_load_order, stream_ingest,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    w, d = oracle.with_, oracle.D
    step = {a: d(repr(s)) for a, s in zip("xyz", LAS_SCALE, strict=True)}
    on_grid = {a: f"floor({a} / {step[a]} + {d(0.5)}) * {step[a]}" for a in "xyz"}
    grid = "SELECT " + ", ".join(f"{v} AS {a}" for a, v in on_grid.items()) + ", r FROM p"
    bounds = ", ".join([f"min({a}) AS l{a}" for a in "xyz"] + [f"max({a}) AS u{a}" for a in "xyz"])
    signed = lambda v: f"CASE WHEN {v} < 0 THEN -2 * ({v}) - 1 ELSE 2 * ({v}) END"
    cut = lambda v: f"CAST(trunc(({v}) / CAST('0.001' AS DOUBLE)) AS BIGINT)"
    normal = " || ".join(f"({oracle._varint(f'({signed(cut(v))})')})" for v in ("u - 0.5::DOUBLE", "0.5::DOUBLE - u", "u"))
    code = lambda n: " || ".join(f"lpad(hex((number >> {8 * k}) & 255), 2, '0')" for k in range(n))
    low = lambda n: f"(number & {(1 << 8 * n) - 1})"
    wrapped = lambda n: f"CASE WHEN {low(n)} >= {1 << 8 * n - 1} THEN {low(n)} - {1 << 8 * n} ELSE {low(n)} END"
    scale = float(2 ** (3 * 3 + 3) - 1)
    ends = lambda k: ((2.0 ** (3 * k) - 1) / scale, (2.0 ** (3 * (k + 1)) - 1) / scale)
    between = " ".join(f"WHEN {k} THEN u * {d(repr(ends(k)[1] - ends(k)[0]))} + {d(repr(ends(k)[0]))}" for k in range(4))
    detail = f"ln({d(scale)} * (CASE level {between} END) + 1) / {d(repr(3 * math.log(2)))}"
    side = {"x": "s", "y": "(s + 1)", "z": "(s + 2)"}
    made = {"a": ("{a}", "{a} + {s}"), "b": ("{a} - {s} / 2", "{a} + {s} / 2"), "c": ("{a}", "{a}")}
    constructed = ", ".join(
        f"{made[b][f[0] == 'u'].format(a=f[1], s=side[f[1]])} AS {b}_{f}" for b in "abc" for f in boxes.FIELDS
    )
    deep = min(PARTITIONS, 20)
    root = [oracle._low_index(f"p.{a}", g, "g.side", deep) for a, g in zip("xyz", oracle.G, strict=True)]
    lx = ", ".join(f"CAST(floor(({a} - m.l{a}) / CAST('0.001' AS DOUBLE)) AS BIGINT) AS q{a}" for a in "xyz")
    count = {a: f"CAST(floor((m.u{a} + {d(catalog.GRID)} - (m.l{a} - {d(catalog.GRID)})) / {d(catalog.GRID)} + 0.5) AS BIGINT)" for a in "xyz"}
    order = {a: f"CAST(floor((p.{a} - (m.l{a} - {d(catalog.GRID)})) / {d(catalog.GRID)}) AS BIGINT)" for a in "xyz"}
    one = """'{"dataType":"bin","tableName":"PointCloud","dataName":"'"""
    many = """'{"dataType":"bin","tableName":"PointCloud","parentNodeKey":"'"""
    return {
        "text_points": w("p") + " SELECT x, y, z, r, g, b FROM p",
        "las_points": f"{w('p')} SELECT x, y, z, r AS intensity, 0 AS r, 0 AS g, 0 AS b FROM ({grid})",
        "las_headers": f"""{w('p')} SELECT '1.2' AS version, 0 AS format, {', '.join(f'{step[a]} AS s{a}' for a in 'xyz')},
            {', '.join(f'{d(0)} AS o{a}' for a in 'xyz')}, count(*) AS points, {bounds} FROM ({grid})""",
        "las_merged": f"{w('p')} SELECT count(*) AS points, {bounds}, {step['y']} AS scale FROM ({grid})",
        "las_records": "SELECT * FROM (VALUES "
        + ", ".join(f"('{u}', {n}, '{t}', '{c.hex().upper()}')" for u, n, t, c in LAS_RECORDS)
        + ') v("user", record_id, description, content)',
        "interim_points": w("p") + " SELECT x, y, z, r, g, b FROM p",
        "node_files": w("blobs") + " SELECT row_key, 'bin' AS qualifier, level, node_key, payload AS value FROM blobs",
        "listed_index": w("counts")
        + """, masks AS (SELECT left(node_key, length(node_key) - 1) AS node_key, bit_or(1 << CAST(right(node_key, 1) AS INTEGER)) AS mask
            FROM counts WHERE length(node_key) > 1 GROUP BY 1)
        SELECT node_key, coalesce(mask, 0) AS mask FROM counts LEFT JOIN masks USING (node_key)""",
        "table_changes": w("blobs")
        + """ SELECT *, 'cloud,other' AS made, 'cloud' AS "left" FROM (SELECT row_key, 'bin' AS qualifier, n, length(payload) // 2 AS size
            FROM blobs WHERE row_key NOT IN ('1r5', '2r12') UNION ALL SELECT 'r', 'hrc', NULL, 2)""",
        "table_order": w("blobs") + " SELECT row_key, part, TRUE AS ascends FROM blobs",
        "cloud_document": w("m")
        + f" SELECT points, '{','.join(cloud.ATTRIBUTES)}' AS attributes, CAST('0.001' AS DOUBLE) AS scale, "
        + ", ".join([f"{f} AS tight_{f}, " + (f"{f} AS cube_{f}" if f[0] == "l" else f"l{f[1]} + side AS cube_{f}") for f in boxes.FIELDS])
        + " FROM m",
        "serve_requests": w("blobs")
        + f""", asked AS (
            SELECT '/pointCloudData/PointCloud?binName=' || row_key AS request, row_key, FALSE AS framed FROM blobs
            UNION ALL SELECT {one} || row_key || '"}}', row_key, TRUE FROM blobs
            UNION ALL SELECT {many} || node_key || '","childNodeFilterStr":"135"}}', length(node_key) || node_key || digit, TRUE
                FROM (SELECT DISTINCT node_key FROM blobs WHERE length(node_key) <= 2), (SELECT unnest(['1', '3', '5']) AS digit))
        SELECT request, row_key || '.bin' AS name, part, payload, framed, CASE WHEN framed THEN '01' || lpad(hex(length(row_key) + 4), 2, '0') END AS head
        FROM asked JOIN blobs USING (row_key)""",
        "little_endian": f"""SELECT number, {code(2)} AS code2, {code(4)} AS code4, {code(8)} AS code8, {wrapped(2)} AS read2, {wrapped(4)} AS read4,
            number AS read8, {low(2)} AS unsigned2 FROM (SELECT (l_orderkey * l_partkey - 1000000) * l_linenumber AS number FROM lineitem)""",
        "clod_within": f"""{w('p')} SELECT u, level, CAST(floor(detail * 1000 + {d(0.1234567)}) AS BIGINT) AS detail, level AS at
            FROM (SELECT u, level, {detail} AS detail FROM p, (SELECT CAST(unnest(range(4)) AS INTEGER) AS level) WHERE u > 0)""",
        "box_constructors": f"{w('p')} SELECT {constructed} FROM (SELECT x, y, z, CAST(supplier AS DOUBLE) AS s FROM p)",
        "normal_records": w("placed")
        + f""" SELECT node_key, ({oracle._varint('qx')}) || ({oracle._varint('qy')}) || ({oracle._varint('qz')})
            || lpad(hex(r), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(b), 2, '0') || {normal} AS record
        FROM (SELECT *, {', '.join(f"CAST(floor(({a} - o{a}) / CAST('0.001' AS DOUBLE)) AS BIGINT) AS q{a}" for a in 'xyz')} FROM placed)""",
        "sampled_partitions": w("g")
        + f""", sample AS (SELECT {oracle._key(*root, deep)} AS deep_key FROM p, g WHERE u < {d(SHARE)}),
        most AS (SELECT greatest(count(*) // {PARTITIONS}, 1) AS most FROM sample),
        nodes AS ({' UNION ALL '.join(f'SELECT substr(deep_key, 1, {k + 1}) AS node_key, count(*) AS n FROM sample GROUP BY 1' for k in range(deep + 1))}),
        children AS (SELECT node_key || digit AS node_key FROM nodes, most, (SELECT CAST(unnest(range(8)) AS VARCHAR) AS digit)
            WHERE n > most AND length(node_key) - 1 < {deep} UNION ALL SELECT 'r')
        SELECT CAST(row_number() OVER (ORDER BY node_key) - 1 AS INTEGER) AS partition_id, node_key, length(node_key) - 1 AS level, n
        FROM (SELECT c.node_key, coalesce(n, 0) AS n FROM children c LEFT JOIN nodes USING (node_key)), most
        WHERE NOT (n > most AND length(node_key) - 1 < {deep})""",
        "dispatched_points": w("parts") + " SELECT partition_id, n, 1 AS tasks FROM parts WHERE n > 0",
        "sorted_load_order": w("m")
        + f""" SELECT supplier % {PARTS} AS part, count(*) AS n, 0 AS falls, min(o) AS first, max(o) AS last
        FROM (SELECT supplier, {order['z']} * ({count['x']} * {count['y']}) + {order['y']} * {count['x']} + {order['x']} AS o FROM p, m) GROUP BY 1""",
        "stream_ingest": w("m")
        + f""" SELECT 'r' AS node_key, 0 AS level, count(*) AS points, CAST(sum(length(record) // 2) AS BIGINT) AS bytes
        FROM (SELECT ({oracle._varint('qx')}) || ({oracle._varint('qy')}) || ({oracle._varint('qz')}) || '000000' AS record FROM (SELECT {lx} FROM p, m))""",
    }
