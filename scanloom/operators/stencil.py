"""Neighbourhood operators on sparse cell relations: offsets are exploded, never joined by inequality.

`keys` are the columns that tell rasters apart (scan_id, or scan_id and room_id); `grid` has keys' scan_id with width
and height. A cell that is not in the relation is unset.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CROSS = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets of the elliptic kernel of a radius: per row the half width is round(sqrt(r^2 - dy^2))."""
    half = {dy: round(math.sqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1)}
    return [(dy, dx) for dy, w in half.items() for dx in range(-w, w + 1)]


def box(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def _table(offsets: list[tuple[int, int]]):
    """The offsets as one constant array of structs."""
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])


def shifted(cells: DataFrame, offsets: list[tuple[int, int]], keys: list[str]) -> DataFrame:
    """Every cell moved by every offset; one row each."""
    moves = F.explode(_table(offsets))
    return cells.select(*keys, "row", "col", moves.alias("o")).select(*keys, (F.col("row") + F.col("o.dy")).alias("row"), (F.col("col") + F.col("o.dx")).alias("col"))


def clipped(cells: DataFrame, grid: DataFrame) -> DataFrame:
    inside = F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1)
    return cells.join(F.broadcast(grid.select("scan_id", "width", "height")), "scan_id").where(inside).drop("width", "height")


def dilate(cells: DataFrame, offsets: list[tuple[int, int]], grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["scan_id"]
    return clipped(shifted(cells, offsets, keys), grid).distinct()


def erode(cells: DataFrame, offsets: list[tuple[int, int]], grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cells whose neighbours inside the grid are all set: outside the grid nothing erodes."""
    keys = keys or ["scan_id"]
    hits = clipped(shifted(cells.select(*keys, "row", "col").distinct(), [(-dy, -dx) for dy, dx in offsets], keys), grid).groupBy(*keys, "row", "col").agg(F.count("*").alias("hits"))
    inside = F.size(F.filter(_table(offsets), lambda o: (F.col("row") + o["dy"]).between(0, F.col("height") - 1) & (F.col("col") + o["dx"]).between(0, F.col("width") - 1)))
    return hits.join(F.broadcast(grid.select("scan_id", "width", "height")), "scan_id").where(F.col("hits") == inside).select(*keys, "row", "col")


def closed(cells: DataFrame, offsets, grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return erode(dilate(cells, offsets, grid, keys), offsets, grid, keys)


def opened(cells: DataFrame, offsets, grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return dilate(erode(cells, offsets, grid, keys), offsets, grid, keys)


def thicken(cells: DataFrame, rounds: int, grid: DataFrame) -> DataFrame:
    """`rounds` dilations by the four neighbours."""
    out = cells.select("scan_id", "row", "col").distinct()
    for _ in range(rounds):
        out = dilate(out, CROSS, grid)
    return out


def dense_only(cells: DataFrame, radius: int, threshold: int, keys: list[str] | None = None) -> DataFrame:
    """Cells with at least `threshold` set cells in the square around them, themselves included."""
    keys = keys or ["scan_id"]
    near = shifted(cells, box(radius), keys).groupBy(*keys, "row", "col").agg(F.count("*").alias("near"))
    return cells.select(*keys, "row", "col").join(near, [*keys, "row", "col"]).where(F.col("near") >= threshold).drop("near")


def free_cells(walls: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells of the grid that are no wall."""
    every = grid.select("scan_id", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("row"))
    every = every.select("scan_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("col"))
    return every.join(walls.select("scan_id", "row", "col"), ["scan_id", "row", "col"], "left_anti")


def distance(walls: DataFrame, grid: DataFrame) -> DataFrame:
    """Free cells with d2, the exact squared distance to the nearest wall cell of their scan.

    Separable: first the distance within the column by two running windows, then per row the least of
    (col difference)^2 + that squared. A row of the grid is the largest thing held at once.
    """
    every = free_cells(walls.limit(0), grid).join(walls.select("scan_id", "row", "col").distinct().withColumn("wall", F.lit(True)), ["scan_id", "row", "col"], "left")
    column = Window.partitionBy("scan_id", "col").orderBy("row")
    mark = F.when(F.col("wall"), F.col("row"))
    above = F.last(mark, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(mark, ignorenulls=True).over(column.rowsBetween(0, Window.unboundedFollowing))
    g = F.least(F.col("row") - above, below - F.col("row"))
    lines = every.withColumn("g", g).groupBy("scan_id", "row").agg(F.collect_list(F.struct("col", "g")).alias("line"))
    far = F.filter("line", lambda p: p["g"].isNotNull())
    best = F.transform("line", lambda p: F.struct(p["col"].alias("col"), p["g"].alias("g"), F.array_min(F.transform(F.col("far"), lambda q: (p["col"] - q["col"]) * (p["col"] - q["col"]) + q["g"] * q["g"])).alias("d2")))
    return lines.withColumn("far", far).select("scan_id", "row", F.explode(best).alias("b")).where("b.d2 > 0").select("scan_id", "row", F.col("b.col").alias("col"), F.col("b.d2").alias("d2"))


def wall_thickness(walls: DataFrame, grid: DataFrame) -> DataFrame:
    """Per scan round(2 * median distance of wall cells to the free cells), at least 1."""
    inside = distance(free_cells(walls, grid), grid)
    return inside.groupBy("scan_id").agg(F.greatest(F.bround(2 * F.percentile(F.sqrt("d2"), F.lit(0.5))), F.lit(1.0)).cast("int").alias("px"))
