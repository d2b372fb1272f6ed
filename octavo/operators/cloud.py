"""Metadata of a cloud: counts, boxes, density, and the JSON document that describes it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octavo.functions import boxes, keys

#: Coordinate step of text clouds, points of a node, neighbours sought, attributes written.
SCALE = 0.001
PER_NODE = 30_000
NEIGHBOURS = 20
ATTRIBUTES = ("POSITION_CARTESIAN", "RGB_PACKED")


@dataclass(frozen=True)
class Cloud:
    """What a cloud's one metadata row says: tight bounds, and the cube anchored at the lower corner."""

    points: int
    lx: float
    ly: float
    lz: float
    ux: float
    uy: float
    uz: float

    @property
    def corner(self) -> tuple[float, float, float]:
        return self.lx, self.ly, self.lz

    @property
    def side(self) -> float:
        return max(self.ux - self.lx, self.uy - self.ly, self.uz - self.lz)

    def grown(self) -> tuple[tuple[float, float, float], float]:
        """Lower corner and side of the cube, grown by a ten-thousandth on every side."""
        e = self.side / 10000
        return (self.lx - e, self.ly - e, self.lz - e), (self.lx + self.side + e) - (self.lx - e)


def metadata(points: DataFrame) -> DataFrame:
    """One row: points (rows with x), tight bounds, and the cube's side and upper corner."""
    tight = points.agg(
        F.count("x").alias("points"),
        *[F.min(a).alias(f"l{a}") for a in boxes.AXES],
        *[F.max(a).alias(f"u{a}") for a in boxes.AXES],
    )
    side = F.greatest(*[F.col(f"u{a}") - F.col(f"l{a}") for a in boxes.AXES])
    return tight.withColumn("side", side).withColumns({f"cube_u{a}": F.col(f"l{a}") + F.col("side") for a in boxes.AXES})


def measure(points: DataFrame) -> Cloud:
    """The metadata row on the driver. A cloud without points is refused."""
    row = metadata(points).first()
    if not row.points:
        raise ValueError("the cloud has no points")
    return Cloud(*[row[c] for c in ("points", *boxes.FIELDS)])


def cloud_js(meta: DataFrame, scale: float = SCALE) -> DataFrame:
    """One row with column json: the document that viewers read."""
    whole = lambda u: F.struct(
        *[F.col(f"{u}{a}" if u != "l" else f"l{a}").alias(f"u{a}") for a in boxes.AXES],
        *[F.col(f"l{a}").alias(f"l{a}") for a in boxes.AXES],
    )
    return meta.select(
        F.to_json(
            F.struct(
                "points",
                whole("u").alias("tightBoundingBox"),
                whole("cube_u").alias("boundingBox"),
                F.array(*[F.lit(scale)] * 3).alias("scale"),
                F.array(*[F.lit(a) for a in ATTRIBUTES]).alias("pointAttributes"),
            )
        ).alias("json")
    )


def merge_headers(headers: DataFrame) -> DataFrame:
    """Metadata of many files' headers: points summed, boxes merged, the least of 1 and all scales."""
    return headers.agg(
        F.sum("points").alias("points"),
        *[F.min(f"l{a}").alias(f"l{a}") for a in boxes.AXES],
        *[F.max(f"u{a}").alias(f"u{a}") for a in boxes.AXES],
        F.least(F.lit(1.0), *[F.min(f"s{a}") for a in boxes.AXES]).alias("scale"),
    )


def density(points: Column, volume: Column) -> Column:
    """Points in a unit of volume; null for a cloud without volume."""
    return F.try_divide(points.cast("double"), volume)


def search_length(points: Column, volume: Column, k: int = NEIGHBOURS) -> Column:
    """Side of a cube that holds k points at the mean density; null for a cloud without volume."""
    return F.pow(F.try_divide(F.lit(float(k)), density(points, volume)), F.lit(1 / 3.0))


def search_summary(points: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    meta = metadata(points)
    volume = (F.col("ux") - F.col("lx")) * (F.col("uy") - F.col("ly")) * (F.col("uz") - F.col("lz"))
    return meta.select(
        "points",
        F.round(volume, 6).alias("volume"),
        F.round(density(F.col("points"), volume), 6).alias("density"),
        F.round(search_length(F.col("points"), volume, k), 6).alias("search_length"),
    )


def level_summary(points: DataFrame, per_node: int = PER_NODE) -> DataFrame:
    """max_level for two and three dimensions."""
    meta = metadata(points).select("points", F.explode(F.array(F.lit(2), F.lit(3))).alias("dimension"))
    return meta.withColumn("max_level", keys.max_level(F.col("points"), per_node, F.col("dimension")))


def dimension_summary(points: DataFrame, ratios=(3.0, 10.0)) -> DataFrame:
    """Split dimension of the cloud and of the cloud with z flattened a hundredfold, for each ratio."""
    meta = metadata(points)
    sides = [F.col(f"u{a}") - F.col(f"l{a}") for a in boxes.AXES]
    out = None
    for ratio in ratios:
        row = meta.select(
            F.lit(float(ratio)).alias("ratio"),
            keys.split_dimension(*sides, ratio).alias("dimension"),
            keys.split_dimension(sides[0], sides[1], sides[2] / 100, ratio).alias("flat_dimension"),
        )
        out = row if out is None else out.union(row)
    return out
