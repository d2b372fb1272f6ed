"""Space partitions from an octree of counts, lookups in them, and a k-d tree.

Lookups are joins on node keys, never of every element with every leaf: a leaf is entered under its own
key and its ancestors', and an element asks under the keys of the nodes that it touches at the level of
its own size, and of their ancestors.

Cases: elements with a null or NaN coordinate (or a null box) are in no partition and are left out;
elements outside the tree's cube count and are placed by the nearest node; no elements give one empty
leaf, the root; columns of the input pass through, except that node_key, partition_id and is_local are
written anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octavo.functions import boxes, keys
from octavo.plans.tables import discard, materialize

#: Rows of a table of leaves that are still broadcast; larger ones are joined by shuffle.
BROADCAST_LEAVES = 200_000
#: Leaves of a k-d tree, whose nodes are on the driver.
MOST_LEAVES = 200_000
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Split:
    """Cube of a partition tree, the most elements of a leaf and the deepest level."""

    corner: tuple[float, float, float]
    side: float
    max_elements: int
    max_level: int


def placed(points: DataFrame) -> DataFrame:
    """points without those that have no place: a null or NaN coordinate."""
    ok = F.lit(True)
    for a in AXES:
        ok = ok & F.col(a).isNotNull() & ~F.isnan(a)
    return points.where(ok)


def _deep_key(tree: Split):
    """Key of the deepest node that holds a point; midpoints go low here."""
    index = [keys.low_index(F.col(a), low, tree.side, tree.max_level) for a, low in zip(AXES, tree.corner, strict=True)]
    return keys.key_of_index(*index, tree.max_level)


def _numbered(rows: DataFrame, key: str, number: str) -> DataFrame:
    """rows with a number from 0 on in the order of the key, by ranges of keys and their sizes."""
    ranged = rows.repartitionByRange(key).withColumn("octavo_range", F.spark_partition_id())
    kept = materialize(ranged, "numbered")
    sizes = kept.groupBy("octavo_range").agg(F.count("*").alias("octavo_held"))
    before = Window.orderBy("octavo_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("octavo_range", F.coalesce(F.sum("octavo_held").over(before), F.lit(0)).alias("octavo_start"))
    place = F.row_number().over(Window.partitionBy("octavo_range").orderBy(key)) - 1
    return kept.join(F.broadcast(starts), "octavo_range").withColumn(number, (place + F.col("octavo_start")).cast("int")).drop("octavo_range", "octavo_start")


def leaves(elements: DataFrame, tree: Split) -> DataFrame:
    """partition_id (depth first), node_key, level, n, region: leaves of the tree, empty ones too.

    Counts of the deepest nodes are aggregated once and summed upward; a node splits where it has more
    than max_elements, and every child of a split node exists.
    """
    deep = placed(elements).groupBy(_deep_key(tree).alias("deep_key")).agg(F.count("*").alias("n"))
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(tree.max_level)), lambda k: F.substring(F.col("deep_key"), F.lit(1), k + 1))
    nodes = deep.select(F.explode(prefixes).alias("node_key"), "n").groupBy("node_key").agg(F.sum("n").alias("n"))
    split = (F.col("n") > tree.max_elements) & (keys.key_level(F.col("node_key")) < tree.max_level)
    children = nodes.where(split).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: F.concat(F.col("node_key"), d.cast("string")))).alias("node_key")
    )
    root = elements.sparkSession.createDataFrame([("r",)], "node_key string")
    every = children.union(root).join(nodes, "node_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = every.where(~split).withColumn("level", keys.key_level(F.col("node_key")))
    region = keys.node_box(F.col("node_key"), tree.corner, tree.side).alias("region")
    return _numbered(found, "node_key", "partition_id").select("partition_id", "node_key", "level", "n", region)


def sampled_split(points: DataFrame, corner, side: float, partitions: int, fraction: float = 0.01, seed: int = 0, u: str | None = None):
    """The sample without replacement, and the Split that cuts it in about so many partitions, as deep as partitions at most.

    u names a column of uniform numbers in [0, 1) that decides which rows are in the sample; without it Spark draws.
    """
    sample = placed(points).where(F.col(u) < fraction) if u else placed(points).sample(False, fraction, seed)
    return sample, Split(corner, side, max(1, sample.count() // partitions), min(partitions, 20))


def sampled_leaves(points: DataFrame, corner, side: float, partitions: int, fraction: float = 0.01, seed: int = 0, u: str | None = None) -> DataFrame:
    """Leaves of sampled_split(); n counts the sample."""
    return leaves(*sampled_split(points, corner, side, partitions, fraction, seed, u))


def _small(rows: DataFrame) -> DataFrame:
    """rows, marked for broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_LEAVES else rows


def _levels(parts: DataFrame) -> list[int]:
    return [r.level for r in parts.select("level").distinct().orderBy("level").collect()]


def assign_partitions(points: DataFrame, parts: DataFrame, tree: Split) -> DataFrame:
    """points with node_key and partition_id of the leaf that holds them: the one prefix that is a leaf, tried at the
    levels that have leaves."""
    prefixes = [F.substring(F.col("octavo_key"), 1, k + 1) for k in _levels(parts)]
    asked = placed(points).drop("node_key", "partition_id").withColumn("octavo_key", _deep_key(tree))
    exploded = asked.withColumn("node_key", F.explode(F.array(*prefixes))).drop("octavo_key")
    return exploded.join(_small(parts.select("node_key", "partition_id")), "node_key")


def _touching(objects: DataFrame, box, parts: DataFrame, tree: Split) -> DataFrame:
    """objects with octavo_box joined to partition_id and octavo_region of every leaf that the box touches.

    A box asks at the level whose nodes are as wide as it is, so it touches few of them (8, or 27 where it
    ends on their faces).
    """
    deepest = max(_levels(parts), default=0)
    known = objects.withColumn("octavo_box", box)
    known = known.where(boxes.is_valid(F.col("octavo_box")))
    b, last = F.col("octavo_box"), F.lit(deepest)
    width = F.greatest(*[boxes.side(b, a) for a in AXES])
    fitting = F.coalesce(F.floor(F.log2(F.try_divide(F.lit(float(tree.side)), width))), last)
    level = F.greatest(F.least(fitting, last), F.lit(0)).cast("int")
    cell = F.lit(tree.side) / F.pow(F.lit(2.0), F.col("octavo_level").cast("double"))
    most = F.pow(F.lit(2.0), F.col("octavo_level").cast("double")) - 1

    def indices(a: str, low: float):
        """Nodes along an axis that the box touches, a little more for rounding."""
        if not tree.side:
            return F.array(F.lit(0).cast("long"))
        index = lambda c, by: F.least(F.greatest(F.floor((c - F.lit(low)) / cell + F.lit(by)), F.lit(0)), most).cast("long")
        return F.sequence(index(b[f"l{a}"], -1e-9), index(b[f"u{a}"], 1e-9))

    asked = known.withColumn("octavo_level", level)
    for a, low in zip(AXES, tree.corner, strict=True):
        asked = asked.withColumn(f"octavo_{a}", indices(a, low))
    bit = lambda i, k: F.call_function("shiftright", i, k).bitwiseAND(F.lit(1))
    steps = F.when(F.col("octavo_level") > 0, F.sequence(F.col("octavo_level") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def key(x, y, z):
        digits = F.transform(steps, lambda k: (bit(x, k) * 4 + bit(y, k) * 2 + bit(z, k)).cast("string"))
        return F.concat(F.lit("r"), F.array_join(digits, ""))

    nodes = F.flatten(F.transform("octavo_x", lambda x: F.flatten(F.transform("octavo_y", lambda y: F.transform("octavo_z", lambda z: key(x, y, z))))))
    asked = asked.withColumn("octavo_nodes", nodes)
    # Ancestors of the nodes, where leaves of that level are; only a leaf itself is found under these.
    above = [
        F.when(F.col("octavo_level") > k, F.array_distinct(_cut("octavo_nodes", k))).otherwise(F.array().cast("array<string>"))
        for k in _levels(parts)
    ]
    entry = lambda strict: (lambda n: F.struct(n.alias("key"), F.lit(strict).alias("strict")))
    asks = F.concat(F.transform("octavo_nodes", entry(False)), F.transform(F.concat(*above), entry(True)))
    asked = asked.withColumn("octavo_ask", F.explode(asks)).withColumns({"octavo_key": F.col("octavo_ask.key"), "octavo_strict": F.col("octavo_ask.strict")})
    entered = parts.select(
        F.col("partition_id").alias("octavo_partition"),
        F.col("region").alias("octavo_region"),
        F.col("node_key").alias("octavo_leaf"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("level")), lambda k: F.substring(F.col("node_key"), F.lit(1), k + 1))).alias("octavo_key"),
    )
    met = asked.join(_small(entered), "octavo_key").where("NOT octavo_strict OR octavo_leaf = octavo_key")
    met = met.where(boxes.intersects(F.col("octavo_region"), F.col("octavo_box")))
    own = ["octavo_level", "octavo_x", "octavo_y", "octavo_z", "octavo_nodes", "octavo_ask", "octavo_key", "octavo_strict", "octavo_leaf"]
    return met.drop("partition_id").withColumnRenamed("octavo_partition", "partition_id").drop(*own)


def _cut(nodes: str, level: int):
    return F.transform(nodes, lambda n: F.substring(n, 1, level + 1))


def lookup_partitions(objects: DataFrame, parts: DataFrame, tree: Split, region: str = "box") -> DataFrame:
    """objects joined to every partition that their box touches."""
    return _touching(objects, F.col(region), parts, tree).drop("octavo_box", "octavo_region")


def replicate_halo(points: DataFrame, parts: DataFrame, tree: Split, length: float) -> DataFrame:
    """points in every partition that their search cube touches, is_local where the partition holds them."""
    search = boxes.from_centre_sides(F.col("x"), F.col("y"), F.col("z"), F.lit(length), F.lit(length), F.lit(length))
    found = _touching(placed(points), search, parts, tree)
    local = boxes.contains(F.col("octavo_region"), F.col("x"), F.col("y"), F.col("z"))
    return found.withColumn("is_local", local).drop("octavo_box", "octavo_region")


def repartition_points(assigned: DataFrame, partitions: int) -> DataFrame:
    """Rows of one partition_id in one task, ids dealt over so many tasks."""
    return assigned.repartition(partitions, "partition_id")


def tree_stats(parts: DataFrame) -> DataFrame:
    return parts.agg(
        F.sum("n").alias("elements"),
        F.count("*").alias("leaves"),
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("filled_leaves"),
        F.max("level").alias("tree_level"),
        F.max("n").alias("largest_leaf"),
    )


def _medians(rows: DataFrame, axes: DataFrame) -> DataFrame:
    """node, cut, below: for each node of axes (node, axis, half) the value of its element number half on the
    axis, and how many elements are not above it.

    Counts per value are sorted by range, so a task has a range of values, not a node; the ranges' sums say
    which one holds the element.
    """
    value = F.when(F.col("axis") == 0, F.col("x")).when(F.col("axis") == 1, F.col("y")).otherwise(F.col("z"))
    counts = rows.join(F.broadcast(axes), "node").groupBy("node", value.alias("v")).agg(F.sum("m").alias("c"))
    placed = materialize(counts.repartitionByRange("node", "v").withColumn("part", F.spark_partition_id()), "kdb-values")
    ranges = placed.groupBy("node", "part").agg(F.min("v").alias("first"), F.sum("c").alias("held"))
    before = Window.partitionBy("node").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    started = ranges.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).join(F.broadcast(axes), "node")
    holding = started.where("start <= half AND half < start + held").select("node", "part", "start", "half")
    upto = Window.partitionBy("node").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.join(F.broadcast(holding), ["node", "part"]).withColumn("below", F.col("start") + F.sum("c").over(upto))
    found = materialize(summed.where("below > half").groupBy("node").agg(F.min("v").alias("cut"), F.min("below").alias("below")), "kdb-cuts")
    discard(placed)
    return found


def kdb_leaves(points: DataFrame, region, max_elements: int, max_level: int) -> DataFrame:
    """Leaves (lx..uz, level, n) of a k-d tree that halves the longest axis at the median element.

    It grows level by level over all points: equal points are one row with a multiplicity, a level's table
    holds the points of nodes that split, and only nodes are on the driver. Elements equal to the median go
    low. Of equal axes the later one is halved, but x before y where z is shorter than both.
    """
    spark = points.sparkSession
    rows = placed(points).groupBy("x", "y", "z").agg(F.count("*").alias("m"))
    rows = materialize(rows.withColumn("node", F.lit(0).cast("long")), "kdb-points")
    out: list[tuple] = []
    nodes = [("", tuple(map(float, region[:3])), tuple(map(float, region[3:])), rows.agg(F.sum("m")).first()[0] or 0)]
    for level in range(max_level + 1):
        splits = []
        for k, (path, low, high, n) in enumerate(nodes):
            if n <= max_elements or level >= max_level:
                out.append((path, *low, *high, level, n))
                continue
            sides = [h - m for m, h in zip(low, high, strict=True)]
            axis = 0 if sides[0] > sides[1] and sides[0] > sides[2] else 1 if sides[0] <= sides[1] and sides[1] > sides[2] else 2
            splits.append((k, axis, n // 2))
        if not splits:
            break
        if len(out) + 2 * len(splits) > MOST_LEAVES:
            raise ValueError(f"more than {MOST_LEAVES} leaves")
        found = _medians(rows, spark.createDataFrame(splits, "node long, axis int, half long"))
        cuts = {r.node: (r.cut, r.below) for r in found.collect()}
        discard(found)
        children, moves = [], []
        for k, axis, _ in splits:
            path, low, high, n = nodes[k]
            cut, below = cuts[k]
            moves.append((k, axis, cut, len(children)))
            children.append((path + "0", low, tuple(cut if i == axis else h for i, h in enumerate(high)), below))
            children.append((path + "1", tuple(cut if i == axis else m for i, m in enumerate(low)), high, n - below))
        nodes = children
        growing = [(k,) for k, c in enumerate(nodes) if c[3] > max_elements]
        if growing and level + 1 < max_level:
            value = F.when(F.col("axis") == 0, F.col("x")).when(F.col("axis") == 1, F.col("y")).otherwise(F.col("z"))
            side = F.when(value > F.col("cut"), 1).otherwise(0)
            moved = rows.join(F.broadcast(spark.createDataFrame(moves, "node long, axis int, cut double, child long")), "node")
            moved = moved.select("x", "y", "z", "m", (F.col("child") + side).alias("node"))
            kept = materialize(moved.join(F.broadcast(spark.createDataFrame(growing, "node long")), "node"), "kdb-points")
            discard(rows)
            rows = kept
    discard(rows)
    schema = ", ".join(f"{f} double" for f in boxes.FIELDS) + ", level int, n long"
    return spark.createDataFrame([x[1:] for x in sorted(out)], schema)
