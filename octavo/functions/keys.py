"""Octree levels and node keys.

A node key is 'r' and one digit 0-7 for each level, 4 * xbit + 2 * ybit + zbit, so the key of an
ancestor is a prefix. A storage row key puts the level in front.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def max_level(points: Column, per_node: int, dimension) -> Column:
    """Levels that a cloud needs: log of its whole nodes to base 2**dimension, up from a fraction of 0.4."""
    d = dimension if isinstance(dimension, Column) else F.lit(dimension)
    blocks = F.floor(points / F.lit(per_node))
    v = F.log(blocks.cast("double")) / F.log(F.pow(F.lit(2.0), d.cast("double")))
    whole = F.floor(v)
    level = F.when(v >= whole + F.lit(0.4), F.ceil(v)).otherwise(F.floor(v + F.lit(0.5)))
    return F.when(blocks < 1, F.lit(0)).otherwise(level).cast("int")


def clod(u: Column, levels: int, dimension: int) -> Column:
    """Continuous level of detail for a uniform u in [0, 1); its floor is a level from 0 to levels."""
    scale = float(2 ** (dimension * levels + dimension) - 1)
    return F.log(F.lit(scale) * u + F.lit(1.0)) / F.lit(dimension * math.log(2))


def clod_within(u: Column, level: int, levels: int, dimension: int) -> Column:
    """clod() on condition that its floor is level."""
    scale = float(2 ** (dimension * levels + dimension) - 1)
    low, high = (2.0 ** (dimension * level) - 1) / scale, (2.0 ** (dimension * (level + 1)) - 1) / scale
    return clod(u * F.lit(high - low) + F.lit(low), levels, dimension)


def random_clod(levels: int, dimension: int, seed: int) -> Column:
    """clod() of Spark's own random numbers, which Catalyst knows to be nondeterministic."""
    return clod(F.rand(seed), levels, dimension)


def level_of(detail: Column, levels: int) -> Column:
    return F.least(F.floor(detail), F.lit(levels)).cast("int")


def cell_index(c: Column, low: float, side: float, level: int) -> Column:
    """Index of a coordinate among 2**level halves of halves; a midpoint goes high, the far face is the last.

    In a cube without extent all is in cell 0."""
    n = 2**level
    if not side:
        return F.when(c.isNotNull(), F.lit(0).cast("long"))
    i = F.floor((c - F.lit(low)) / F.lit(side / n))
    return F.greatest(F.least(i, F.lit(n - 1)), F.lit(0)).cast("long")


def low_index(c: Column, low: float, side: float, level: int) -> Column:
    """The same with midpoints going low, as in the partition tree."""
    n = 2**level
    if not side:
        return F.when(c.isNotNull(), F.lit(0).cast("long"))
    i = F.ceil((c - F.lit(low)) / F.lit(side / n)) - F.lit(1)
    return F.greatest(F.least(i, F.lit(n - 1)), F.lit(0)).cast("long")


def key_of_index(ix: Column, iy: Column, iz: Column, level: int) -> Column:
    """Node key of cell indices at a level."""
    bit = lambda i, k: F.shiftright(i, k).bitwiseAND(F.lit(1))
    digits = [
        (bit(ix, k) * 4 + bit(iy, k) * 2 + bit(iz, k)).cast("string") for k in range(level - 1, -1, -1)
    ]
    return F.concat(F.lit("r"), *digits)


def node_key(x: Column, y: Column, z: Column, corner: tuple[float, float, float], side: float, level: int) -> Column:
    """Key of the node at a level that holds a point of the cube."""
    return key_of_index(*[cell_index(c, low, side, level) for c, low in zip((x, y, z), corner, strict=True)], level)


def node_key_bisected(x: Column, y: Column, z: Column, corner, side: float, level: int) -> Column:
    """node_key() by halving intervals one level after the other; equal but for the last bit of a midpoint."""
    state = F.struct(
        F.lit("r").alias("key"),
        *[F.lit(float(low)).alias(f"l{a}") for a, low in zip("xyz", corner, strict=True)],
        *[F.lit(float(low + side)).alias(f"u{a}") for a, low in zip("xyz", corner, strict=True)],
    )

    def halve(s, _):
        mid = {a: (s[f"l{a}"] + s[f"u{a}"]) / 2 for a in "xyz"}
        high = {a: c >= mid[a] for a, c in zip("xyz", (x, y, z), strict=True)}
        digit = high["x"].cast("int") * 4 + high["y"].cast("int") * 2 + high["z"].cast("int")
        return F.struct(
            F.concat(s["key"], digit.cast("string")).alias("key"),
            *[F.when(high[a], mid[a]).otherwise(s[f"l{a}"]).alias(f"l{a}") for a in "xyz"],
            *[F.when(high[a], s[f"u{a}"]).otherwise(mid[a]).alias(f"u{a}") for a in "xyz"],
        )

    return F.aggregate(F.array(*[F.lit(i) for i in range(level)]), state, halve, lambda s: s["key"]) if level else F.lit("r")


def key_level(key: Column) -> Column:
    return F.length(key) - 1


def key_index(key: Column, axis: int) -> Column:
    """Cell index of a key along axis 0, 1 or 2 at the key's level."""
    digits = F.split(F.substring(key, 2, 1 << 20), "")
    return F.when(key == "r", F.lit(0).cast("long")).otherwise(
        F.aggregate(
            digits,
            F.lit(0).cast("long"),
            lambda s, d: s * 2 + F.shiftright(F.when(d == "", F.lit(0)).otherwise(d.cast("int")), 2 - axis).bitwiseAND(F.lit(1)),
        )
    )


def node_box(key: Column, corner: tuple[float, float, float], side: float) -> Column:
    """Box of a node: its lower corner is the cube's and the key's offset."""
    from octavo.functions import boxes

    width = F.lit(side) / F.pow(F.lit(2.0), key_level(key).cast("double"))
    lower = [F.lit(low) + key_index(key, i) * width for i, low in enumerate(corner)]
    return boxes.box(*lower, *[c + width for c in lower])


def row_key(key: Column) -> Column:
    return F.concat(key_level(key).cast("string"), key)


def file_name(key: Column) -> Column:
    return F.concat(row_key(key), F.lit(".bin"))


def key_of_file(path: Column) -> Column:
    """Node key of a path that ends in <level><key>.bin; empty where it does not."""
    return F.regexp_extract(path, r"(?:^|/)\d+(r[0-7]*)\.bin$", 1)


def parent_key(key: Column) -> Column:
    return F.substring(key, F.lit(1), F.length(key) - 1)


def last_digit(key: Column) -> Column:
    return F.substring(key, -1, 1).cast("int")


def split_dimension(sx: Column, sy: Column, sz: Column, ratio: float) -> Column:
    """2 where a side is under the largest over ratio, else 3."""
    return F.when(F.least(sx, sy, sz) < F.greatest(sx, sy, sz) / F.lit(float(ratio)), 2).otherwise(3)
