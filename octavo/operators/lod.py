"""Levels of detail: by a continuous random level, or by a grid filter that keeps points near cell centres.

Cases: the grid filter leaves out points with a null or NaN coordinate; a null colour is a colour like others;
equal points all stay, at the levels that have room for them; no points give no rows; columns other than
the point's are not read by the grid filter and pass through elsewhere, but for level, node_key and the cells'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octavo.functions import keys
from octavo.operators.octree import placed as with_place
from octavo.plans.tables import discard, materialize, repeat_rows

POINT = ("x", "y", "z", "r", "g", "b")


def clod_levels(points: DataFrame, levels: int, dimension: int = 3, u: str | None = None, seed: int = 0) -> DataFrame:
    """points with level: the floor of a continuous level of detail, of column u or of random numbers."""
    detail = keys.clod(F.col(u), levels, dimension) if u else keys.random_clod(levels, dimension, seed)
    return points.withColumn("level", keys.level_of(detail, levels))


def with_node_keys(points: DataFrame, corner, side: float, levels: int) -> DataFrame:
    """points with node_key: the node of each point at its own level (column level, at most levels).

    The key at the deepest level is cut to the point's level, since an ancestor's key is a prefix.
    """
    deep = keys.node_key(F.col("x"), F.col("y"), F.col("z"), corner, side, levels)
    return points.withColumn("node_key", F.substring(deep, F.lit(1), F.col("level") + 1))


def node_counts(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("node_key").agg(F.count("*").alias("n"))


def grid_cells(points: DataFrame, corner, side: float, level: int, cells: int = 32) -> DataFrame:
    """points with cell indices cx, cy, cz at a level, the packed cell number and the distance to its centre."""
    width = side / cells / 2**level
    out = points
    for a, low in zip("xyz", corner, strict=True):
        index = F.floor((F.col(a) - F.lit(low)) / F.lit(width)) if width else F.when(F.col(a).isNotNull(), 0)
        out = out.withColumn(f"c{a}", index.cast("long"))
    off = [F.col(a) - ((F.col(f"c{a}") + F.lit(0.5)) * F.lit(width) + F.lit(low)) for a, low in zip("xyz", corner, strict=True)]
    packed = F.shiftleft(F.col("cx"), 42).bitwiseOR(F.shiftleft(F.col("cy"), 21)).bitwiseOR(F.col("cz"))
    return out.withColumn("cell", packed).withColumn("dist", F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]))


def grid_lod(
    points: DataFrame, corner, side: float, cells: int = 32, max_level: int = 15, capacity: int | None = None
) -> DataFrame:
    """x, y, z, r, g, b, level, node_key: every point at the first level that has room for it.

    At each level a node with no more points than its cells keeps all; of a fuller node each cell keeps
    the point nearest its centre (ties by x, y, z, r, g, b) and the others sink. Points at max_level
    stay. Equal points are one row with a multiplicity until the end, so a cell's best point is a
    pre-aggregated minimum; a node's count is a sum over its cells, of which there are at most
    cells**3, and no task ever gathers a node's or a cell's points. Each level's cells and the points met with
    them are written, which also bounds the plan; the next level reads what sinks from there. A table of
    cells that is small meets the points by broadcast.
    """
    room = cells**3 if capacity is None else capacity
    rest = materialize(with_place(points).groupBy(*POINT).agg(F.count("*").alias("n")), "lod-points")
    first = rest
    kept: list[DataFrame] = []
    for level in range(max_level + 1):
        placed = grid_cells(rest, corner, side, level, cells).drop("cell")
        node = keys.key_of_index(*[_parent(f"c{a}", cells) for a in "xyz"], level)
        placed = placed.withColumn("node_key", node)
        stay = [*POINT, F.lit(level).alias("level"), "node_key"]
        if level == max_level:
            kept.append(placed.select(*stay, "n"))
            break
        cell = ["node_key", "cx", "cy", "cz"]
        best = placed.groupBy(*cell).agg(
            F.sum("n").alias("cell_n"), F.min(F.struct("dist", *POINT)).alias("best")
        )
        full = F.sum("cell_n").over(Window.partitionBy("node_key")) > room
        marked = materialize(best.withColumn("full", full).select(*cell, "best", "full"), "lod-cells")
        met = placed.join(marked, cell)
        is_best = F.struct("dist", *POINT).eqNullSafe(F.col("best"))
        stays = F.when(~F.col("full"), F.col("n")).when(is_best, F.lit(1)).otherwise(F.lit(0))
        split = materialize(met.select(*stay, "n", stays.cast("long").alias("stays")), "lod-split")
        kept.append(split.where("stays > 0").select(*POINT, "level", "node_key", F.col("stays").alias("n")))
        discard(marked)
        rest = split.where("n > stays").select(*POINT, (F.col("n") - F.col("stays")).alias("n"))
        if first is not None:
            discard(first)
            first = None
        if not rest.limit(1).count():
            break
    out = kept[0]
    for part in kept[1:]:
        out = out.union(part)
    return repeat_rows(out, "n")


def _parent(cell: str, cells: int):
    return F.floor(F.col(cell) / F.lit(cells)).cast("long")
