"""Point-cloud operators. A cloud is (scan_id, x, y, z, ...); every operator works on all scans at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config

BINS, KEEP = 256, 0.02


def axes(up_axis: int) -> tuple[str, str, str]:
    """Names of the two in-plane coordinates, ascending, and of the upward one."""
    flat = [c for k, c in enumerate("xyz") if k != up_axis]
    return flat[0], flat[1], "xyz"[up_axis]


def scaled(points: DataFrame, units_per_meter: float) -> DataFrame:
    return points.withColumns({c: F.col(c) / F.lit(float(units_per_meter)) for c in "xyz"}) if units_per_meter != 1 else points


def voxel_means(points: DataFrame, voxel: float) -> DataFrame:
    """One mean point per occupied voxel; voxel cells are counted from half a voxel below each scan's least corner."""
    if voxel <= 0:
        return points.select("scan_id", "x", "y", "z")
    low = points.groupBy("scan_id").agg(*[F.min(c).alias(f"{c}0") for c in "xyz"])
    cell = [F.floor((F.col(c) - (F.col(f"{c}0") - voxel / 2)) / voxel).alias(f"v{c}") for c in "xyz"]
    return points.join(F.broadcast(low), "scan_id").groupBy("scan_id", *cell).agg(*[F.avg(c).alias(c) for c in "xyz"])


def height_histogram(points: DataFrame, keys: list[str], h: str = "z", bins: int = BINS) -> DataFrame:
    """keys, bin, n, low, width: counts of equal bins over each group's range; the last bin holds its upper end.

    A group whose heights are all equal is binned over half a unit to either side.
    """
    ends = points.groupBy(*keys).agg(F.min(h).alias("h0"), F.max(h).alias("h1"))
    flat = F.col("h0") == F.col("h1")
    ends = ends.select(*keys, (F.col("h0") - F.when(flat, 0.5).otherwise(0.0)).alias("low"), ((F.col("h1") - F.col("h0") + F.when(flat, 1.0).otherwise(0.0)) / bins).alias("width"))
    place = F.least(F.floor((F.col(h) - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int")
    return points.join(ends, keys).groupBy(*keys, place.alias("bin"), "low", "width").agg(F.count("*").alias("n"))


def floor_ceiling(points: DataFrame, keys: list[str] | None = None, h: str = "z", bins: int = BINS, keep: float = KEEP) -> DataFrame:
    """keys, floor_h, ceiling_h: centres of the first and last bin that hold at least `keep` of the fullest bin's count."""
    keys = keys or ["scan_id"]
    bars = height_histogram(points, keys, h, bins)
    top = bars.groupBy(*keys).agg(F.max("n").alias("top"))
    centre = F.col("low") + (F.col("bin") + 0.5) * F.col("width")
    return bars.join(top, keys).where(F.col("n") >= keep * F.col("top")).groupBy(*keys).agg(F.min(centre).alias("floor_h"), F.max(centre).alias("ceiling_h"))


def local_ceiling(points: DataFrame, *, up_axis: int = 2, cell: float = 1.0, min_pts: int = 20, smooth: int = 1) -> DataFrame:
    """The points with `local`: the ceiling of their cell, or the scan's where the cell has fewer than min_pts points.

    With smooth > 1 the ceiling grid is median-filtered over smooth x smooth cells, mirrored at its borders.
    """
    a, b, h = axes(up_axis)
    low = points.groupBy("scan_id").agg(F.min(a).alias("a0"), F.min(b).alias("b0"))
    celled = points.join(F.broadcast(low), "scan_id").withColumns({"ca": F.floor((F.col(a) - F.col("a0")) / cell).cast("long"), "cb": F.floor((F.col(b) - F.col("b0")) / cell).cast("long")}).drop("a0", "b0")
    keys = ["scan_id", "ca", "cb"]
    whole = floor_ceiling(points, ["scan_id"], h).select("scan_id", F.col("ceiling_h").alias("whole"))
    full = celled.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_pts).drop("n")
    own = floor_ceiling(celled.join(full, keys, "left_semi"), keys, h).select(*keys, F.col("ceiling_h").alias("own"))
    if smooth <= 1:
        out = celled.join(own, keys, "left").join(F.broadcast(whole), "scan_id")
        return out.withColumn("local", F.coalesce("own", "whole")).drop("own", "whole", "ca", "cb")
    size = celled.groupBy("scan_id").agg(F.max("ca").alias("ma"), F.max("cb").alias("mb"))
    grid = size.select("scan_id", "ma", "mb", F.explode(F.sequence(F.lit(0).cast("long"), "ma")).alias("ca")).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), "mb")))
    grid = grid.join(own, keys, "left").join(F.broadcast(whole), "scan_id").withColumn("c", F.coalesce("own", "whole"))
    r = smooth // 2
    near = grid.select("scan_id", "ca", "cb", "ma", "mb", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-r, smooth - r) for j in range(-r, smooth - r)])).alias("o"))
    mirror = lambda v, top: F.when(v < 0, -v - 1).when(v > top, 2 * top + 1 - v).otherwise(v)
    near = near.select("scan_id", "ca", "cb", mirror(F.col("ca") + F.col("o.i"), F.col("ma")).alias("na"), mirror(F.col("cb") + F.col("o.j"), F.col("mb")).alias("nb"))
    values = grid.select("scan_id", F.col("ca").alias("na"), F.col("cb").alias("nb"), "c")
    median = near.join(values, ["scan_id", "na", "nb"]).groupBy(*keys).agg(F.percentile("c", F.lit(0.5)).alias("local"))
    return celled.join(median, keys).drop("ca", "cb")


def crop_slab(points: DataFrame, config: Config) -> DataFrame:
    """Points in the horizontal band of the configuration, both ends included.

    'absolute': heights in [lo, hi]. 'floor': that band above the floor. 'ceiling': from hi below to lo below the
    ceiling, the scan's or (local modes) that of the point's cell.
    """
    h = axes(config.up_axis)[2]
    lo, hi = config.slab_lo_m, config.slab_hi_m
    if config.slab_relative_to == "absolute":
        return points.where(F.col(h).between(lo, hi))
    if config.slab_relative_to == "floor":
        ends = floor_ceiling(points, ["scan_id"], h).select("scan_id", F.col("floor_h").alias("ref"))
        low, high = F.col("ref") + lo, F.col("ref") + hi
    elif config.slab_relative_to == "ceiling" and config.ceiling_mode == "global":
        ends = floor_ceiling(points, ["scan_id"], h).select("scan_id", F.col("ceiling_h").alias("ref"))
        low, high = F.col("ref") - hi, F.col("ref") - lo
    elif config.slab_relative_to == "ceiling" and config.ceiling_mode in ("local_perpoint", "local_smoothed"):
        smooth = config.ceiling_smooth_cells if config.ceiling_mode == "local_smoothed" else 1
        local = local_ceiling(points, up_axis=config.up_axis, cell=config.ceiling_cell_size_m, min_pts=config.ceiling_min_pts_per_cell, smooth=smooth)
        return local.where(F.col(h).between(F.col("local") - hi, F.col("local") - lo)).drop("local")
    else:
        raise ValueError(f"no slab for {config.slab_relative_to!r}, {config.ceiling_mode!r}")
    return points.join(F.broadcast(ends), "scan_id").where(F.col(h).between(low, high)).drop("ref")


def height_band(points: DataFrame, config: Config, ends: DataFrame | None = None) -> DataFrame:
    """Points between the floor and the ceiling, less the wall margins, both ends included."""
    h = axes(config.up_axis)[2]
    ends = floor_ceiling(points, ["scan_id"], h) if ends is None else ends
    inside: Column = F.col(h).between(F.col("floor_h") + config.wall_floor_margin_m, F.col("ceiling_h") - config.wall_ceiling_margin_m)
    return points.join(F.broadcast(ends), "scan_id").where(inside).drop("floor_h", "ceiling_h")
