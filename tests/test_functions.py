import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from octavo.functions import boxes, encoding, frames, keys


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_varint_goldens(spark):
    cases = {0: "00", 1: "01", 127: "7F", 128: "8001", 300: "AC02", 16383: "FF7F", 16384: "808001", 1000000: "C0843D"}
    row = one(spark, *[encoding.varint_hex(F.lit(n)) for n in cases], encoding.varint_hex(F.lit(-1)))
    assert list(row) == [*cases.values(), None]


def test_varint_large(spark):
    for n in (2**35, 2**62, 2**63 - 1):
        text = bytes.fromhex(one(spark, encoding.varint_hex(F.lit(n)))[0])
        assert sum((b & 127) << 7 * i for i, b in enumerate(text)) == n


def test_count_codes(spark):
    cases = {0: 0, 1: 1, 9: 9, 10: 0x11, 14: 0x11, 15: 0x12, 95: 0x1A, 30000: 0x43, 32768: 0x43, 99999999: 0x7A, 100000000: 0x81}
    assert list(one(spark, *[encoding.count_code(F.lit(n)) for n in cases])) == list(cases.values())


def test_max_level_goldens(spark):
    cases = {1000: (0, 0), 30000: (0, 0), 60000: (1, 0), 120000: (1, 1), 240000: (2, 1), 6000000: (4, 3), 600000000: (7, 5)}
    for n, want in cases.items():
        assert tuple(one(spark, *[keys.max_level(F.lit(n), 30000, d) for d in (2, 3)])) == want


def test_midpoints_go_high_in_keys_and_low_in_partitions(spark):
    four = F.lit(4.0)
    high = keys.node_key(four, four, four, (0.0, 0.0, 0.0), 8.0, 1)
    low = keys.key_of_index(*[keys.low_index(four, 0.0, 8.0, 1)] * 3, 1)
    assert tuple(one(spark, high, low)) == ("r7", "r0")


def test_clod_within_its_level(spark):
    for level in range(4):
        rows = spark.range(100).select(F.floor(keys.clod_within((F.col("id") + 0.5) / 100, level, 3, 3)).alias("l")).distinct().collect()
        assert [r.l for r in rows] == [level]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 1023)] * 3), min_size=1, max_size=20))
def test_keys_by_arithmetic_and_by_halving_agree(spark, cells):
    points = spark.createDataFrame([tuple(c / 128 for c in p) for p in cells], "x double, y double, z double")
    args = (F.col("x"), F.col("y"), F.col("z"), (0.0, 0.0, 0.0), 8.0, 5)
    rows = points.select(keys.node_key(*args).alias("a"), keys.node_key_bisected(*args).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_node_box_holds_its_points(spark):
    points = spark.range(200).select(*[(F.rand(i) * 8).alias(c) for i, c in enumerate("xyz")])
    keyed = points.withColumn("key", keys.node_key(F.col("x"), F.col("y"), F.col("z"), (0.0, 0.0, 0.0), 8.0, 4))
    held = boxes.contains(keys.node_box(F.col("key"), (0.0, 0.0, 0.0), 8.0), F.col("x"), F.col("y"), F.col("z"))
    assert keyed.where(~held).count() == 0


def test_root_key(spark):
    r = F.lit("r")
    row = one(spark, keys.key_index(r, 0), keys.row_key(r), keys.file_name(F.lit("r01")), keys.key_of_file(F.lit("/a/b/2r01.bin")), keys.key_of_file(F.lit("r.hrc")))
    assert tuple(row) == (0, "0r", "2r01.bin", "r01", "")


def test_box_rules(spark):
    a, b, c = boxes.box(0, 0, 0, 2, 2, 2), boxes.box(2, 0, 0, 3, 1, 1), boxes.box(2.5, 0, 0, 3, 1, 1)
    row = one(
        spark, boxes.intersects(a, b), boxes.intersects(a, c), boxes.disjoint(a, c), boxes.intersection(a, c),
        boxes.volume(boxes.merge(a, c)), boxes.covers(a, boxes.of_point(F.lit(2.0), F.lit(0.0), F.lit(1.0))),
        boxes.expand_little(a)["lx"], boxes.volume(boxes.to_cube(b)), boxes.is_valid(boxes.box(1, 0, 0, 0, 1, 1)),
    )
    assert tuple(row) == (True, False, True, None, 12.0, True, -0.0002, 1.0, False)


def test_octants_fill_the_box(spark):
    cube = boxes.box(0, 0, 0, 4, 2, 2)
    rows = spark.range(8).select(boxes.octant(cube, F.col("id").cast("int")).alias("b")).select(F.sum(boxes.volume(F.col("b")))).first()
    assert rows[0] == 16.0


def test_frames():
    data = frames.frame("1r2", "bin", b"abc")
    assert data[:2] == bytes([1, 7]) and frames.unframe(data) == ("1r2.bin", b"abc")
    assert frames.parse_request("/pointCloudData/t?hrcName=r&binName=1r2") == ("t", "bin", "1r2")
    for bad in ("/other/t?binName=1r", "/pointCloudData/t?x=1"):
        with pytest.raises(ValueError):
            frames.parse_request(bad)


def test_messages(spark):
    assert frames.parse_message('{"dataType":"bin","tableName":"t","dataName":"1r2"}') == ("t", "bin", "1r2", "")
    assert frames.parse_message('{"dataType":"bin","tableName":"t","parentNodeKey":"r0","childNodeFilterStr":"12345"}') == ("t", "bin", "r0", "12345")


def test_answers(spark):
    """Gets, messages for a row and for children; what is unknown, null or not there has no answer."""
    rows = spark.createDataFrame(
        [("0r", "bin", 0, bytearray(b"root")), ("1r0", "bin", 0, bytearray(b"a")), ("1r0", "bin", 1, bytearray(b"b")), ("1r5", "bin", 0, bytearray(b"c")), ("r", "hrc", 0, bytearray(b"h"))],
        "row_key string, qualifier string, part int, value binary",
    )
    asked = [
        "/pointCloudData/t?hrcName=r&binName=0r", "/pointCloudData/t?binName=0r", "/pointCloudData/t?binName=7r", "/other/t?binName=0r", "/pointCloudData/t?x=1",
        '{"dataType":"bin","tableName":"t","dataName":"1r0"}', '{"dataType":"bin","tableName":"t","parentNodeKey":"r","childNodeFilterStr":"0559"}', "{broken", None,
    ]
    found = frames.answer(rows, spark.createDataFrame([(a,) for a in asked], "request string")).collect()
    got = sorted((asked.index(r.request), r.name, r.part, bytes(r.payload)) for r in found)
    assert got == [
        (0, "0r.bin", 0, b"root"), (1, "0r.bin", 0, b"root"), (5, "1r0.bin", 0, b"a"), (5, "1r0.bin", 1, b"b"),
        (6, "1r0.bin", 0, b"a"), (6, "1r0.bin", 1, b"b"), (6, "1r5.bin", 0, b"c"),
    ]
    assert all(frames.unframe(bytes(r.frame)) == (r.name, bytes(r.payload)) if r.framed else r.frame is None for r in found)


def test_little_endian(spark):
    import struct

    golden = bytes([111, 123, 256 - 4, 256 - 98]).hex()
    numbers = [0, 1, -1, 255, -32768, 2**31 - 1, -(2**31), 2**63 - 1, -(2**63)]
    row = one(spark, encoding.from_little_endian(F.lit(golden), 4), *[encoding.to_little_endian(F.lit(n), 8) for n in numbers])
    assert row[0] == -1627620497 and [bytes.fromhex(x) for x in row[1:]] == [struct.pack("<q", n) for n in numbers]
    back = one(spark, *[encoding.from_little_endian(F.lit(struct.pack("<q", n).hex()), 8) for n in numbers], encoding.from_little_endian(F.lit("ff80"), 2, signed=False))
    assert list(back) == [*numbers, 0x80FF]
    doubles = [0.0, 1.5, -2.25, 1e300, -1e-300, 5e-324, 0.1, 2.0**1023, -1.7976931348623157e308]
    assert list(one(spark, *[encoding.double_from_little_endian(F.lit(struct.pack("<d", x).hex())) for x in doubles])) == doubles
    assert one(spark, encoding.double_from_little_endian(F.lit(struct.pack("<d", float("inf")).hex())))[0] is None


def test_split_dimension(spark):
    s = lambda *v: [F.lit(float(x)) for x in v]
    row = one(spark, keys.split_dimension(*s(9, 9, 2), 3), keys.split_dimension(*s(9, 9, 3), 3), keys.split_dimension(*s(9, 9, 0.8), 10))
    assert tuple(row) == (2, 3, 2)


def test_clod_ends(spark):
    low, high = one(spark, keys.clod(F.lit(0.0), 3, 3), keys.clod(F.lit(1 - 1e-12), 3, 3))
    assert low == 0 and math.floor(high) == 3
