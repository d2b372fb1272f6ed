"""Neighbourhoods of points in cubes, by a join on grid cells or sums over tiles, and what is computed from them.

Cases: points with a null or NaN coordinate have no place and are left out, here and as neighbours; points of
one place are one row with a multiplicity; a search cube without extent is refused; no points give no
rows; columns other than the coordinates are not read, but by load_order, which passes them through.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.operators import boxsums
from octavo.operators.octree import placed
from octavo.plans.tables import repeat_rows, tidy

AXES = ("x", "y", "z")
#: Pairs that the join would look at for each point, on average, from which sums over tiles take its place.
DENSE = 256
#: Sides of a tile in search cubes, and places of a tile and its rim that a task may hold; the first side that fits is taken.
TILES, GROUP = (5.0, 3.0, 1.0, 0.25), 2_000_000
#: One of so many places is looked at for how often points share a place, and the number from which equal points are counted first.
LOOKED, SHARED = 1024, 1.5
#: Points, or places where equal points are counted first, for each of the partitions that tiles are dealt to.
DEALT = 500_000


def neighbour_pairs(points: DataFrame, side: float) -> DataFrame:
    """x, y, z, m and nx, ny, nz, nm: each place with each place in the closed cube of that side round it.

    Points of one place are one row with a multiplicity (m, nm), so a place that many points share
    does not pair with itself over and over. Cells are as wide as the cube, so a place asks in the two cells
    of each axis that its cube touches: at most 8 copies of it are shuffled, and cells where places are dense
    are split by Spark's skew join.
    """
    if side <= 0:
        raise ValueError("the search cube has no extent")
    half = side / 2
    width = F.lit(side * (1 + 1e-9))
    cell = lambda c: F.floor(c / width).cast("long")
    places = placed(points).groupBy(*AXES).agg(F.count("*").alias("m"))
    there = places.select(*[F.col(a).alias(f"n{a}") for a in AXES], F.col("m").alias("nm"), *[cell(F.col(a)).alias(f"c{a}") for a in AXES])
    # A hair more than half, since the rounded edge may lie in the next cell.
    reach = half * (1 + 1e-12)
    here = places
    for a in AXES:
        slack = F.abs(F.col(a)) * 1e-15 + reach
        here = here.withColumn(f"c{a}", F.explode(F.sequence(cell(F.col(a) - slack), cell(F.col(a) + slack))))
    within = None
    for a in AXES:
        c = F.abs(F.col(f"n{a}") - F.col(a)) <= F.lit(half)
        within = c if within is None else within & c
    return here.join(there, ["cx", "cy", "cz"]).where(within).drop("cx", "cy", "cz")


class Tiling(NamedTuple):
    """Width of the tiles for sums without pairs, partitions that they are dealt to, whether a tile's task counts equal points,
    and the first tile and number of tiles of each axis where one number of 63 bits tells all tiles apart."""

    width: float
    parts: int
    few: bool
    grid: list[tuple[int, int]] | None


def tiling(points: DataFrame, side: float) -> Tiling | None:
    """How to deal points to tiles; None where the points are so thin that the join is cheap."""
    if side <= 0:
        raise ValueError("the search cube has no extent")
    hashed = F.xxhash64(*[F.col(a) + F.lit(0.0) for a in AXES])
    looked = F.when(F.pmod(hashed, F.lit(LOOKED)) == 0, hashed).alias("place")
    cells = placed(points).groupBy(*[F.floor(F.col(a) / F.lit(side)).alias(f"c{a}") for a in AXES], looked).agg(F.count("*").cast("double").alias("n"))
    shared = F.sum(F.when(F.col("place").isNotNull(), F.col("n"))).alias("of"), F.count("place").alias("places")
    cells = cells.groupBy(*[f"c{a}" for a in AXES]).agg(F.sum("n").alias("n"), *shared)
    ends = [f(f"c{a}").alias(f"{n}{a}") for a in AXES for f, n in ((F.min, "low"), (F.max, "high"))]
    held = cells.agg(
        F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("n"), F.max("n").alias("most"),
        F.sum("of").alias("of"), F.sum("places").alias("places"), *ends,
    ).first()
    if not held.n or 8 * held.pairs / held.n < DENSE:
        return None
    width = next((k for k in TILES if (k + 1) ** 3 * held.most <= GROUP), None)
    shared = held.of / held.places if held.places else 1.0  # points of a place
    few = width is not None and shared <= SHARED
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(held.n / (1.0 if few else shared) / DEALT))
    width = width or TILES[-1]
    # Tiles that the fullest reach of the outermost cells touches, and one more for what rounding may do.
    grid = [(math.floor((held[f"low{a}"] - 1) / width) - 1, math.floor((held[f"high{a}"] + 2) / width) + 1) for a in AXES]
    grid = [(low, high - low + 1) for low, high in grid]
    return Tiling(side * width, parts, few, grid if math.prod(n for _, n in grid) < 1 << 62 else None)


def _tiled(points: DataFrame, side: float, tiles: Tiling, asks: Callable[[np.ndarray, np.ndarray, np.ndarray, float], list[np.ndarray]], columns: str) -> DataFrame:
    """x, y, z, m and the columns that asks gives for places, multiplicities, the rows asked for and half the side, a tile a task.

    A tile has copies of the places within half a search cube of it. Work is in proportion to the places times
    the square of the logarithm of a tile's places, whatever the number of neighbours. Equal points are counted before they
    are dealt, or where a tile's points are few and mostly unlike, once its task has them, which saves a shuffle of all points.
    """
    half, few = side / 2, tiles.few
    tile = lambda c: F.floor(c / F.lit(tiles.width)).cast("long")
    finite = [F.abs(F.col(a)) < F.lit(math.inf) for a in AXES]  # an infinite coordinate is near nothing, itself included
    rows = placed(points).where(finite[0] & finite[1] & finite[2]).select(*[(F.col(a) + F.lit(0.0)).alias(a) for a in AXES])  # no negative zeros
    if not few:
        rows = rows.groupBy(*AXES).agg(F.count("*").alias("m"))
    for a in AXES:
        slack = F.abs(F.col(a)) * 1e-15 + half * (1 + 1e-12)
        rows = rows.withColumn(f"t{a}", F.explode(F.sequence(tile(F.col(a) - slack), tile(F.col(a) + slack))))
    own = [F.col(f"t{a}") == tile(F.col(a)) for a in AXES]
    keys = {f"t{a}": F.col(f"t{a}") for a in AXES}
    if tiles.grid:  # one number sorts without comparing rows
        at = [F.col(f"t{a}") - F.lit(low) for a, (low, _) in zip(AXES, tiles.grid, strict=True)]
        keys = {"tile": (at[0] * F.lit(tiles.grid[1][1]) + at[1]) * F.lit(tiles.grid[2][1]) + at[2]}
    kept = [*AXES] if few else [*AXES, "m"]
    rows = rows.select(*kept, (own[0] & own[1] & own[2]).alias("own"), *[k.alias(n) for n, k in keys.items()])
    rows, keys = rows.repartition(tiles.parts, *keys), list(keys)
    schema = f"x double, y double, z double, m long, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]

    def tile_of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        places, own = np.column_stack([table.column(a).to_numpy() for a in AXES]), table.column("own").to_numpy()
        if few:
            places, m, at = boxsums.counted(places)
            own = own[at]
        else:
            m = table.column("m").to_numpy()
        asked = np.flatnonzero(own)
        if len(asked):
            out = [*places[asked].T, m[asked], *asks(places, m, asked, half)]
            out = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out], names=names)
            yield from (out.slice(i, 1 << 16) for i in range(0, len(out), 1 << 16))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            if not len(batch):
                continue
            number = [batch.column(k).to_numpy() for k in keys]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in number], axis=0)) + 1
            for begin, end in itertools.pairwise([0, *cuts.tolist(), len(batch)]):
                now = [k[begin] for k in number]
                if held and now != at:
                    yield from tile_of(held)
                    held = []
                held.append(batch.slice(begin, end - begin))
                at = now
        if held:
            yield from tile_of(held)
        tidy()

    return rows.sortWithinPartitions(*keys).mapInArrow(summed, schema)


def neighbour_counts(points: DataFrame, side: float) -> DataFrame:
    """x, y, z, m, n_neighbors for each place, itself included."""
    tiles = tiling(points, side)
    if tiles:
        return _tiled(points, side, tiles, lambda *asked: [boxsums.counts(*asked)], "n_neighbors long")
    return neighbour_pairs(points, side).groupBy(*AXES, "m").agg(F.sum("nm").alias("n_neighbors"))


def covariances(points: DataFrame, side: float) -> DataFrame:
    """x, y, z, m, n and the sample covariances cxx..czz of each place's neighbourhood; null below two points.

    Sums are taken relative to the place, which keeps digits where coordinates are large.
    """
    return _covariances(points, side, tiling(points, side))


def _covariances(points: DataFrame, side: float, tiles: Tiling | None) -> DataFrame:
    d = {a: F.col(f"n{a}") - F.col(a) for a in AXES}
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    if tiles:
        named = [f"s{a}" for a in AXES] + [f"s{a}{b}" for a, b in pairs]

        def asked(places, m, asked, half):
            n, sums = boxsums.moments(places, m, asked, half)
            return [n, *sums.T]

        sums = _tiled(points, side, tiles, asked, ", ".join(["n long", *[f"{c} double" for c in named]]))
    else:
        sums = neighbour_pairs(points, side).groupBy(*AXES, "m").agg(
            F.sum("nm").alias("n"),
            *[F.sum(F.col("nm") * d[a]).alias(f"s{a}") for a in AXES],
            *[F.sum(F.col("nm") * d[a] * d[b]).alias(f"s{a}{b}") for a, b in pairs],
        )
    n = F.col("n")
    cov = lambda a, b: F.when(n > 1, (F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / n) / (n - 1))
    return sums.select(*AXES, "m", "n", *[cov(a, b).alias(f"c{a}{b}") for a, b in pairs])


#: Components that differ by less are alike when the sign is chosen.
ALIKE = 1e-6


def normals(points: DataFrame, side: float, least_gap: float = 1e-9) -> DataFrame:
    """x, y, z, m, n, normal_x, normal_y, normal_z, spread_gap: direction of the least spread of each neighbourhood.

    All neighbours count. The first of the largest components is positive. spread_gap is how far the least
    eigenvalue lies below the next, as a share of the largest: the smaller it is, the less certain is the
    direction. Below three points, or where the gap is not over least_gap (places on a line, or as wide in
    two directions), the normal is (0, 0, 0). Eigenvalues come in closed form, a batch of rows at a time: as one Spark
    expression the code is too long for the JVM to compile.
    """
    spreads = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
    schema = "x double, y double, z double, m long, n long, normal_x double, normal_y double, normal_z double, spread_gap double"
    names = [c.split()[0] for c in schema.split(", ")]
    if tiles := tiling(points, side):

        def asked(places, m, asked, half):
            n, sums = boxsums.moments(places, m, asked, half)
            below = np.where(n > 1, n - 1, np.inf)  # no spread of a single point
            sums = sums.T
            return [n, *_least_spread([(sums[3 + i] - sums[a] * sums[b] / n) / below for i, (a, b) in enumerate(boxsums.PAIRS)], n, least_gap)]

        return _tiled(points, side, tiles, asked, schema.split(", ", 4)[4])

    def directed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(c) for c in (*AXES, "m", "n")]
            found = _least_spread([batch.column(c).to_numpy() for c in spreads], kept[-1].to_numpy(), least_gap)
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], names=names)

    found = _covariances(points, side, None).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in spreads})
    return found.select(*AXES, "m", "n", *spreads).mapInArrow(directed, schema)


def _least_spread(spreads: list[np.ndarray], n: np.ndarray, least_gap: float) -> list[np.ndarray]:
    """normal_x, normal_y, normal_z and spread_gap of covariances xx, xy, xz, yy, yz, zz of n points."""
    a, b, c, d, e, f = spreads
    with np.errstate(all="ignore"):
        q = (a + d + f) / 3
        off = b * b + c * c + e * e
        p = np.sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + 2 * off) / 6)
        det = (a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)
        cube = 2 * p * p * p
        ratio = np.fmax(np.fmin(np.where(cube != 0, det / cube, 1.0), 1.0), -1.0)
        angle = np.where(p > 0, np.arccos(ratio) / 3, 0.0)
        high, root = q + 2 * p * np.cos(angle), q + 2 * p * np.cos(angle + 2 * math.pi / 3)
        gap = np.where(high != 0, (3 * q - high - 2 * root) / high, 0.0)
        rows = ((a - root, b, c), (b, d - root, e), (c, e, f - root))
        cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        best = None
        for i, j in ((0, 1), (0, 2), (1, 2)):
            v = cross(rows[i], rows[j])
            v = (v[0] * v[0] + v[1] * v[1] + v[2] * v[2], *v)
            if best is None:
                best = v
                continue
            more = v[3] > best[3]  # of equal lengths the greater by x, y and z
            for now, then in zip(v[2::-1], best[2::-1], strict=True):
                more = (now > then) | ((now == then) & more)
            best = tuple(np.where(more, now, then) for now, then in zip(v, best, strict=True))
        u = [k / np.sqrt(best[0]) for k in best[1:]]
        most = np.maximum(np.maximum(np.abs(u[0]), np.abs(u[1])), np.abs(u[2])) - ALIKE
        lead = np.where(np.abs(u[0]) >= most, u[0], np.where(np.abs(u[1]) >= most, u[1], u[2]))
        known = (n >= 3) & (gap > least_gap) & (best[0] > 0)
        return [*[np.where(known, np.where(lead < 0, -k, k), 0.0) for k in u], gap]


def normal_lines(found: DataFrame, digits: int | None = None) -> DataFrame:
    """value: "x y z[nx, ny, nz]", once for each point, as the text sink writes it; normals to so many digits."""
    shown = lambda c: c if digits is None else F.floor(c * 10**digits + F.lit(0.5)) / F.lit(10.0**digits)
    line = F.concat(
        F.concat_ws(" ", *[F.col(a).cast("string") for a in AXES]),
        F.lit("["),
        F.concat_ws(", ", *[shown(F.col(f"normal_{a}")).cast("string") for a in AXES]),
        F.lit("]"),
    )
    return repeat_rows(found.select(line.alias("value"), "m"), "m")


def load_order(points: DataFrame, region: tuple[float, ...], width: float) -> DataFrame:
    """points with load_order: z-major number of the grid cell in the region grown by one cell."""
    low = [v - width for v in region[:3]]
    high = [v + width for v in region[3:]]
    index = [F.floor((F.col(a) - F.lit(m)) / F.lit(width)).cast("long") for a, m in zip(AXES, low, strict=True)]
    count = [int((h - m) / width + 0.5) for m, h in zip(low, high, strict=True)]
    return points.withColumn(
        "load_order", index[2] * F.lit(count[0] * count[1]) + index[1] * F.lit(count[0]) + index[0]
    )


def in_load_order(ordered: DataFrame, partition: str) -> DataFrame:
    """Rows of one partition together, sorted by load order within."""
    return ordered.repartition(partition).sortWithinPartitions(partition, "load_order")
