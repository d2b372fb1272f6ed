"""Axis-aligned boxes as structs (lx, ly, lz, ux, uy, uz); all intervals are closed.

Every function builds a Catalyst expression. A null box gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
FIELDS = ("lx", "ly", "lz", "ux", "uy", "uz")
TYPE = "struct<lx:double,ly:double,lz:double,ux:double,uy:double,uz:double>"


def box(lx, ly, lz, ux, uy, uz) -> Column:
    values = [v if isinstance(v, Column) else F.lit(float(v)) for v in (lx, ly, lz, ux, uy, uz)]
    return F.struct(*[v.cast("double").alias(n) for v, n in zip(values, FIELDS, strict=True)])


def from_min_sides(lx, ly, lz, sx, sy, sz) -> Column:
    return box(lx, ly, lz, lx + sx, ly + sy, lz + sz)


def from_centre_sides(x: Column, y: Column, z: Column, sx, sy, sz) -> Column:
    return box(x - sx / 2, y - sy / 2, z - sz / 2, x + sx / 2, y + sy / 2, z + sz / 2)


def of_point(x: Column, y: Column, z: Column) -> Column:
    return box(x, y, z, x, y, z)


def is_valid(b: Column) -> Column:
    """No lower bound lies above its upper bound."""
    return _all(b[f"l{a}"] <= b[f"u{a}"] for a in AXES)


def contains(b: Column, x: Column, y: Column, z: Column) -> Column:
    return _all((c >= b[f"l{a}"]) & (c <= b[f"u{a}"]) for a, c in zip(AXES, (x, y, z), strict=True))


def covers(a: Column, b: Column) -> Column:
    return _all((a[f"l{c}"] <= b[f"l{c}"]) & (a[f"u{c}"] >= b[f"u{c}"]) for c in AXES)


def intersects(a: Column, b: Column) -> Column:
    """Touching counts."""
    return _all((a[f"l{c}"] <= b[f"u{c}"]) & (a[f"u{c}"] >= b[f"l{c}"]) for c in AXES)


def disjoint(a: Column, b: Column) -> Column:
    return ~intersects(a, b)


def intersection(a: Column, b: Column) -> Column:
    """Null where the boxes are disjoint."""
    lower = [F.greatest(a[f"l{c}"], b[f"l{c}"]) for c in AXES]
    upper = [F.least(a[f"u{c}"], b[f"u{c}"]) for c in AXES]
    return F.when(intersects(a, b), box(*lower, *upper))


def merge(a: Column, b: Column) -> Column:
    lower = [F.least(a[f"l{c}"], b[f"l{c}"]) for c in AXES]
    upper = [F.greatest(a[f"u{c}"], b[f"u{c}"]) for c in AXES]
    return box(*lower, *upper)


def side(b: Column, axis: str) -> Column:
    return b[f"u{axis}"] - b[f"l{axis}"]


def volume(b: Column) -> Column:
    return side(b, "x") * side(b, "y") * side(b, "z")


def centre(b: Column) -> Column:
    return F.struct(*[((b[f"l{a}"] + b[f"u{a}"]) / 2).alias(a) for a in AXES])


def expand(b: Column, by) -> Column:
    return box(*[b[f"l{a}"] - by for a in AXES], *[b[f"u{a}"] + by for a in AXES])


def expand_little(b: Column) -> Column:
    """Grows every side by a ten-thousandth of the x extent."""
    return expand(b, side(b, "x") / 10000)


def to_cube(b: Column) -> Column:
    """Anchored at the lower corner, with the largest side."""
    s = F.greatest(*[side(b, a) for a in AXES])
    return from_min_sides(b["lx"], b["ly"], b["lz"], s, s, s)


def octant(b: Column, i: Column) -> Column:
    """Child i of a box cut in eight; bit 2 of i is x, bit 1 is y, bit 0 is z."""
    half = {a: side(b, a) / 2 for a in AXES}
    lower = [
        b[f"l{a}"] + half[a] * F.shiftright(i, 2 - k).bitwiseAND(1) for k, a in enumerate(AXES)
    ]
    return box(*lower, *[low + half[a] for low, a in zip(lower, AXES, strict=True)])


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out
