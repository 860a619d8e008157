"""Regions of sparse rasters: components, filled footprints, watershed rooms and their filters.

Only flooding and component labelling run as grouped maps, one scan per group; all else is joins and aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import Config
from . import kernels as K
from .lineage import settle
from .stencil import closed, dilate, disc, distance, erode, free_cells

CELL = ["scan_id", "row", "col"]


def components(cells: DataFrame, *, eight: bool = True, keys: list[str] | None = None) -> DataFrame:
    """keys, row, col, label: connected components numbered 1..k by their first cell, row by row."""
    keys = keys or ["scan_id"]
    around = K.EIGHT if eight else K.FOUR
    names = [*keys, "row", "col", "label"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        mask = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1), bool)
        mask[r - r.min(), c - c.min()] = True
        return pdf.assign(label=K.component_labels(mask, around)[r - r.min(), c - c.min()])[names]

    kinds = dict(cells.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "row long, col long, label long"])
    return cells.select(*keys, F.col("row").cast("long"), F.col("col").cast("long")).distinct().groupBy(*keys).applyInPandas(run, schema)


def clean_walls(walls: DataFrame, min_area: int) -> DataFrame:
    """Wall cells of 8-connected components of at least min_area cells."""
    found = components(walls)
    large = found.groupBy("scan_id", "label").count().where(F.col("count") >= min_area)
    return found.join(large, ["scan_id", "label"], "left_semi").select(*CELL)


def filled(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """The cells and the holes in them: 4-connected background that does not touch the border of the grid."""
    back = components(free_cells(cells, grid), eight=False).join(F.broadcast(grid.select("scan_id", "width", "height")), "scan_id")
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("height") - 1) | (F.col("col") == F.col("width") - 1)
    open_air = back.where(edge).select("scan_id", "label").distinct()
    return cells.select(*CELL).union(back.join(open_air, ["scan_id", "label"], "left_anti").select(*CELL)).distinct()


def footprint(walls: DataFrame, grid: DataFrame, radius: int) -> DataFrame:
    """The building's outline: walls dilated, filled and eroded again."""
    return erode(filled(dilate(walls, disc(radius), grid), grid), disc(radius), grid)


def interior(walls: DataFrame, grid: DataFrame, close_px: int = 0) -> DataFrame:
    """Cells enclosed by the (closed) walls, the walls left out."""
    shell = closed(walls, disc(close_px), grid) if close_px > 0 else walls.select(*CELL)
    return filled(shell, grid).join(walls.select(*CELL), CELL, "left_anti")


def relabel(labels: DataFrame) -> DataFrame:
    """Room ids 1..k in their order; walls and exterior stay."""
    ids = labels.where("label >= 1").select("scan_id", "label").distinct().withColumn("new", F.dense_rank().over(Window.partitionBy("scan_id").orderBy("label")))
    return labels.join(F.broadcast(ids), ["scan_id", "label"], "left").withColumn("label", F.coalesce("new", "label")).select(*CELL, F.col("label").cast("long").alias("label"))


def seeds(dt: DataFrame, h: float) -> DataFrame:
    """Cells of the h-maxima of the distance field, with the number of their 4-connected component as seed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        field = K.dense(r, c, np.sqrt(pdf["d2"].to_numpy(float)), (r.max() + 1, c.max() + 1), 0.0)
        found = K.component_labels(K.h_maxima(field, h) & (field > 0), K.FOUR)
        rows, cols = np.nonzero(found)
        return pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "row": rows, "col": cols, "seed": found[rows, cols]})

    return dt.groupBy("scan_id").applyInPandas(run, "scan_id int, row long, col long, seed long")


def basins(dt: DataFrame, marks: DataFrame) -> DataFrame:
    """Every free cell with the seed whose basin it lies in, flooding from the most open places (-distance) up."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        shape = (r.max() + 1, c.max() + 1)
        mask = K.dense(r, c, True, shape, False)
        cost = K.dense(r, c, -np.sqrt(pdf["d2"].to_numpy(float)), shape, 0.0)
        found = K.flood(cost, K.dense(r, c, pdf["seed"].to_numpy(np.int64), shape, 0), mask)
        return pdf.assign(label=found[r, c])[["scan_id", "row", "col", "label"]]

    both = dt.join(marks, CELL, "left").select(*CELL, F.col("d2").cast("double").alias("d2"), F.coalesce("seed", F.lit(0).cast("long")).alias("seed"))
    return both.groupBy("scan_id").applyInPandas(run, "scan_id int, row long, col long, label long")


def contact(labels: DataFrame, dt: DataFrame) -> DataFrame:
    """Per pair of rooms a < b with neighbouring cells the ridge: the largest distance field at their contact."""
    rooms = labels.where("label >= 1").join(dt.select(*CELL, F.sqrt("d2").alias("d")), CELL).select(*CELL, "label", "d")
    moved = rooms.select("scan_id", F.explode(F.array(F.struct(F.col("row").alias("row"), (F.col("col") + 1).alias("col")), F.struct((F.col("row") + 1).alias("row"), F.col("col").alias("col")))).alias("p"), F.col("label").alias("other"), F.col("d").alias("e"))
    moved = moved.select("scan_id", "p.row", "p.col", "other", "e")
    met = rooms.join(moved, CELL).where("label <> other")
    return met.groupBy("scan_id", F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).agg(F.max(F.greatest("d", "e")).alias("ridge"))


def merge_open(labels: DataFrame, dt: DataFrame, ridge_px: float) -> DataFrame:
    """Rooms joined over contacts at least ridge_px wide, numbered 1..k by the least id joined."""
    edges = contact(labels, dt).where(F.col("ridge") >= ridge_px).select("scan_id", "a", "b")
    ids = labels.where("label >= 1").select("scan_id", F.col("label").alias("a")).distinct().withColumn("b", F.col("a"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        roots = K.graph_roots(pd.unique(pdf[["a", "b"]].to_numpy().ravel()).tolist(), pdf[["a", "b"]].to_numpy().tolist())
        return pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "label": list(roots), "root": list(roots.values())})

    roots = ids.unionByName(edges).groupBy("scan_id").applyInPandas(run, "scan_id int, label long, root long")
    joined = labels.join(F.broadcast(roots), ["scan_id", "label"], "left")
    return relabel(joined.select(*CELL, F.coalesce("root", "label").alias("label")))


def drop_uncovered(labels: DataFrame, covered: DataFrame, least: float) -> DataFrame:
    """Rooms of which less than `least` of the cells are covered become exterior; then rooms are renumbered."""
    hit = labels.join(covered.select(*CELL).distinct().withColumn("hit", F.lit(1.0)), CELL, "left")
    poor = hit.where("label >= 1").groupBy("scan_id", "label").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share")).where(F.col("share") < least).select("scan_id", "label", F.lit(True).alias("poor"))
    return relabel(labels.join(F.broadcast(poor), ["scan_id", "label"], "left").select(*CELL, F.when(F.col("poor"), F.lit(0)).otherwise(F.col("label")).alias("label")))


def watershed_rooms(walls: DataFrame, grid: DataFrame, config: Config, covered: DataFrame | None = None, *, min_room_area_m2: float | None = None) -> DataFrame:
    """Label map of a wall raster: -1 walls, 0 exterior, rooms from 1.

    Small wall pieces go; seeds are the h-maxima of the exact distance to the walls, and the free cells outside the
    closed footprint are one seed more; basins of -distance become rooms if large enough and mostly inside the
    footprint; rooms over wide contacts are joined; rooms over unscanned floor go.
    """
    px = config.pixel_m
    area = round((config.min_room_area_m2 if min_room_area_m2 is None else min_room_area_m2) / px**2)
    grid = settle(grid)
    kept = settle(clean_walls(walls, config.min_wall_area_px))
    dt = settle(distance(kept, grid))
    marks = seeds(dt, max(1.0, config.marker_h_m / px))
    inside = settle(footprint(kept, grid, max(1, round(config.footprint_close_m / px)))).withColumn("inside", F.lit(1.0))
    outdoors = dt.join(inside, CELL, "left_anti").select(*CELL)
    outer = outdoors.withColumn("seed", F.lit(1 << 40).cast("long"))
    marks = marks.join(outdoors, CELL, "left_anti").unionByName(outer)
    found = settle(basins(dt, marks)).join(inside, CELL, "left")
    good = found.where(f"label >= 1 and label < {1 << 40}").groupBy("scan_id", "label").agg(F.count("*").alias("n"), F.avg(F.coalesce("inside", F.lit(0.0))).alias("share")).where((F.col("n") >= area) & (F.col("share") >= 0.5)).select("scan_id", "label", F.lit(True).alias("good"))
    rooms = found.join(F.broadcast(good), ["scan_id", "label"], "left").select(*CELL, F.when(F.col("good"), F.col("label")).otherwise(F.lit(0)).cast("long").alias("label"))
    rooms = merge_open(settle(relabel(rooms)), dt, config.merge_ridge_m / px)
    if covered is not None:
        rooms = drop_uncovered(rooms, covered, config.min_coverage_frac)
    return rooms.unionByName(kept.select(*CELL, F.lit(-1).cast("long").alias("label")))


def detections(labels: DataFrame) -> DataFrame:
    """Per room its bounding box, area and centroid, with confidence 1."""
    return labels.where("label >= 1").groupBy("scan_id", "label").agg(F.min("col").alias("x0"), F.min("row").alias("y0"), F.max("col").alias("x1"), F.max("row").alias("y1"), F.count("*").alias("area"), F.avg("col").alias("cx"), F.avg("row").alias("cy"), F.lit(1.0).alias("confidence"))


def interior_point(dt: DataFrame) -> DataFrame:
    """Per scan the cell of the largest distance, the first row by row among equals."""
    return dt.groupBy("scan_id").agg(F.min_by(F.struct("row", "col"), F.struct(-F.col("d2"), F.col("row"), F.col("col"))).alias("p")).select("scan_id", "p.row", "p.col")
