"""Rasters as sparse relations of set cells (scan_id, row, col) with a one-row transform per scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config
from .points import axes, floor_ceiling

MAX_CELLS = 150_000_000


def grid_of(points: DataFrame, pixel: float, up_axis: int = 2) -> DataFrame:
    """transform per scan: a_min, b_min, pixel_size, width, height. Raises if the dense grid would pass MAX_CELLS."""
    a, b, _ = axes(up_axis)
    ends = points.groupBy("scan_id").agg(F.min(a).alias("a_min"), F.min(b).alias("b_min"), F.max(a).alias("a1"), F.max(b).alias("b1"))
    cells = lambda top, low: ((F.col(top) - F.col(low)) / pixel).cast("long") + 1
    out = ends.select("scan_id", "a_min", "b_min", F.lit(float(pixel)).alias("pixel_size"), cells("a1", "a_min").alias("width"), cells("b1", "b_min").alias("height"))
    guarded = F.when(F.col("width") * F.col("height") > MAX_CELLS, F.raise_error(F.lit("grid too large"))).otherwise(F.col("width"))
    return out.withColumn("width", guarded)


def cells(points: DataFrame, transform: DataFrame, up_axis: int = 2) -> DataFrame:
    """Points with row, col and in_bounds; indices truncate toward zero and rows count from the top."""
    a, b, _ = axes(up_axis)
    px = ((F.col(a) - F.col("a_min")) / F.col("pixel_size")).cast("long")
    py = ((F.col(b) - F.col("b_min")) / F.col("pixel_size")).cast("long")
    joined = points.join(F.broadcast(transform), "scan_id").withColumns({"col": px, "row": F.col("height") - 1 - py})
    inside: Column = F.col("col").between(0, F.col("width") - 1) & F.col("row").between(0, F.col("height") - 1)
    return joined.withColumn("in_bounds", inside).drop("a_min", "b_min", "pixel_size", "width", "height")


def occupancy(slab: DataFrame, transform: DataFrame, *, min_points: int = 1, up_axis: int = 2) -> DataFrame:
    """Cells with at least min_points points, with their count n."""
    return cells(slab, transform, up_axis).where("in_bounds").groupBy("scan_id", "row", "col").agg(F.count("*").alias("n")).where(F.col("n") >= min_points)


def wallness(points: DataFrame, transform: DataFrame, config: Config, ends: DataFrame | None = None) -> DataFrame:
    """Cells whose points span at least wallness_min_span_frac of the height from floor to ceiling, with span."""
    h = axes(config.up_axis)[2]
    ends = floor_ceiling(points, ["scan_id"], h) if ends is None else ends
    span = cells(points, transform, config.up_axis).where("in_bounds").groupBy("scan_id", "row", "col").agg((F.max(h) - F.min(h)).alias("span"))
    return span.join(F.broadcast(ends), "scan_id").where(F.col("span") >= config.wallness_min_span_frac * (F.col("ceiling_h") - F.col("floor_h"))).drop("floor_h", "ceiling_h")


def coverage(points: DataFrame, transform: DataFrame, config: Config, ends: DataFrame | None = None) -> DataFrame:
    """Cells with at least coverage_min_pts points from 0.2 below the floor to the margin below the ceiling."""
    h = axes(config.up_axis)[2]
    ends = floor_ceiling(points, ["scan_id"], h) if ends is None else ends
    band = points.join(F.broadcast(ends), "scan_id").where(F.col(h).between(F.col("floor_h") - 0.2, F.col("ceiling_h") - config.coverage_ceiling_margin_m))
    return occupancy(band.drop("floor_h", "ceiling_h"), transform, min_points=config.coverage_min_pts, up_axis=config.up_axis)


def label_points(points: DataFrame, labels: DataFrame, transform: DataFrame, up_axis: int = 2) -> DataFrame:
    """Points with the label of their cell: 0 where the label relation has none, -2 out of the grid."""
    found = cells(points, transform, up_axis).join(labels.select("scan_id", "row", "col", "label"), ["scan_id", "row", "col"], "left")
    return found.withColumn("label", F.when(~F.col("in_bounds"), F.lit(-2)).otherwise(F.coalesce("label", F.lit(0))))


def world_box(transform: DataFrame) -> DataFrame:
    return transform.select("scan_id", "a_min", "b_min", (F.col("a_min") + F.col("width") * F.col("pixel_size")).alias("a_max"), (F.col("b_min") + F.col("height") * F.col("pixel_size")).alias("b_max"))


def in_grid(points: DataFrame, transform: DataFrame, up_axis: int = 2) -> DataFrame:
    """Share of each scan's points inside its grid."""
    return cells(points, transform, up_axis).groupBy("scan_id").agg(F.avg(F.col("in_bounds").cast("double")).alias("frac"))


def check_in_grid(points: DataFrame, transform: DataFrame, least: float = 0.5, up_axis: int = 2) -> DataFrame:
    """in_grid, but raises for a scan below `least`: the cloud and the grid do not belong together."""
    return in_grid(points, transform, up_axis).withColumn("frac", F.when(F.col("frac") < least, F.raise_error(F.lit("points lie outside the grid"))).otherwise(F.col("frac")))


def covered_share(interior: DataFrame, covered: DataFrame) -> DataFrame:
    """Share of each scan's interior cells that are covered; see regions.interior for the interior."""
    hit = covered.select("scan_id", "row", "col").distinct().withColumn("hit", F.lit(1.0))
    return interior.join(hit, ["scan_id", "row", "col"], "left").groupBy("scan_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("frac"))
