"""Rooms on label maps: wall rings, back-projection, adjacency evidence and mask-driven relabelling.

A room mask relation is (scan_id, room_id, row, col); masks of different rooms may overlap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import Config
from . import kernels as K
from .lineage import settle
from .regions import CELL, basins, contact, relabel
from .stencil import dilate, disc, erode, wall_thickness

ROOM = ["scan_id", "room_id"]


def room_masks(labels: DataFrame) -> DataFrame:
    return labels.where("label >= 1").select("scan_id", F.col("label").alias("room_id"), "row", "col")


def ring_radii(config: Config, thickness_px: int = 1) -> tuple[int, int]:
    """Erosion and dilation radii in pixels, from the settings' metres or else from the wall thickness."""
    inner = round(config.room_erode_m / config.pixel_m) if config.room_erode_m is not None else thickness_px // 2
    outer = round(config.wall_dilate_m / config.pixel_m) if config.wall_dilate_m is not None else thickness_px + config.do_buffer_px
    return max(1, inner), max(1, outer)


def boundary_ring(labels: DataFrame, wall_cells: DataFrame, grid: DataFrame, erode_px: int, dilate_px: int) -> DataFrame:
    """Wall cells near each room's edge: (room - eroded room), dilated, and wall. Rooms may share cells."""
    rooms = room_masks(labels)
    core = erode(rooms, disc(erode_px), grid, ROOM)
    band = rooms.join(core, [*ROOM, "row", "col"], "left_anti")
    return dilate(band, disc(dilate_px), grid, ROOM).join(wall_cells.select(*CELL).distinct(), CELL, "left_semi").select(*ROOM, "row", "col")


def footprints(labels: DataFrame, grid: DataFrame, radius: int, *, walls_only: bool = False) -> DataFrame:
    """Wall cells within reach of a room, with the room itself unless walls_only."""
    rooms = room_masks(labels)
    walls = labels.where("label = -1").select(*CELL)
    near = dilate(rooms, disc(radius), grid, ROOM).join(walls, CELL, "left_semi").select(*ROOM, "row", "col")
    return near if walls_only else near.union(rooms.select(*ROOM, "row", "col")).distinct()


def backproject(points: DataFrame, masks: DataFrame, transform: DataFrame, up_axis: int = 2) -> DataFrame:
    """Points of each room's mask; a point in masks of several rooms appears for each."""
    from .raster import cells

    return cells(points, transform, up_axis).where("in_bounds").join(masks.select(*ROOM, "row", "col").distinct(), CELL)


def adjacent(labels: DataFrame, grid: DataFrame, reach: int) -> DataFrame:
    """Pairs a < b of rooms whose dilations meet."""
    grown = dilate(room_masks(labels), disc(reach), grid, ROOM)
    met = grown.withColumnRenamed("room_id", "a").join(grown.withColumnRenamed("room_id", "b"), CELL).where("a < b")
    return met.select("scan_id", "a", "b").distinct()


def interface(labels: DataFrame, walls: DataFrame, dt: DataFrame, grid: DataFrame, reach: int) -> DataFrame:
    """Per adjacent pair: cells of the zone both dilations cover, the share of walls there, the ridge of direct contact."""
    grown = dilate(room_masks(labels), disc(reach), grid, ROOM)
    zone = grown.withColumnRenamed("room_id", "a").join(grown.withColumnRenamed("room_id", "b"), CELL).where("a < b")
    wall = walls.select(*CELL).distinct().withColumn("wall", F.lit(1.0))
    share = zone.join(wall, CELL, "left").groupBy("scan_id", "a", "b").agg(F.count("*").alias("zone"), F.avg(F.coalesce("wall", F.lit(0.0))).alias("wall_frac"))
    return share.join(contact(labels, dt), ["scan_id", "a", "b"], "left").withColumn("ridge", F.coalesce("ridge", F.lit(0.0)))


def sanity(masks: DataFrame, covered: DataFrame | None, walls: DataFrame) -> DataFrame:
    """Per mask: covered share * filled share of the bounding box * (1 - wall share)."""
    flag = lambda c, name: c.select(*CELL).distinct().withColumn(name, F.lit(1.0))
    rows = masks.join(flag(walls, "w"), CELL, "left")
    rows = rows.join(flag(covered, "c"), CELL, "left") if covered is not None else rows.withColumn("c", F.lit(1.0))
    share = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    extent = (F.max("row") - F.min("row") + 1) * (F.max("col") - F.min("col") + 1)
    return rows.groupBy(*ROOM).agg((share("c") * (F.count("*") / extent) * (1 - share("w"))).alias("score"))


def sample_interior(masks: DataFrame, dt: DataFrame, k: int) -> DataFrame:
    """Per room the most interior cell and k - 1 cells at evenly spaced ranks in row order, without repeats."""
    rows = masks.join(dt.select(*CELL, "d2"), CELL, "left").withColumn("d2", F.coalesce("d2", F.lit(0)))
    by_place = Window.partitionBy(*ROOM).orderBy("row", "col")
    ranked = rows.withColumns({"rank": F.row_number().over(by_place) - 1, "n": F.count("*").over(Window.partitionBy(*ROOM)), "top": F.row_number().over(Window.partitionBy(*ROOM).orderBy(F.desc("d2"), "row", "col"))})
    if k <= 1:
        return ranked.where("top = 1").select(*ROOM, "row", "col")
    last = F.greatest(F.lit(k - 2), F.lit(1))
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(max(k - 2, 0))), lambda i: F.floor(i * (F.col("n") - 1) / last)))
    return ranked.where((F.col("top") == 1) | F.array_contains(picks, F.col("rank").cast("long"))).select(*ROOM, "row", "col")


def resolve_masks(masks: DataFrame, scores: DataFrame, walls: DataFrame, covered: DataFrame | None, config: Config) -> DataFrame:
    """Label map of overlapping masks (scan_id, mask_id, row, col): per cell the best by score, area, least id wins.

    Masks lose their wall cells first; then small masks and those mostly over unscanned floor go.
    """
    free = masks.distinct().join(walls.select(*CELL), CELL, "left_anti")
    keys = ["scan_id", "mask_id"]
    rows = free if covered is None else free.join(covered.select(*CELL).distinct().withColumn("c", F.lit(1.0)), CELL, "left")
    share = F.lit(1.0) if covered is None else F.avg(F.coalesce("c", F.lit(0.0)))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("area"), share.alias("share")).where((F.col("area") >= config.sam_min_mask_region_area) & (F.col("share") >= config.sam_auto_min_coverage_frac))
    ranked = free.join(stats, keys).join(scores, keys)
    best = ranked.groupBy(*CELL).agg(F.max_by("mask_id", F.struct("score", "area", -F.col("mask_id"))).alias("mask_id"))
    order = best.join(ranked.select(*keys, "score", "area").distinct(), keys)
    ids = order.select(*keys, "score", "area").distinct().withColumn("label", F.row_number().over(Window.partitionBy("scan_id").orderBy("score", "area", F.desc("mask_id"))))
    return relabel(best.join(ids.select(*keys, "label"), keys).select(*CELL, "label"))


def drop_small(labels: DataFrame, min_cells: int) -> DataFrame:
    """Rooms of fewer cells become exterior; the rest are renumbered."""
    small = labels.where("label >= 1").groupBy("scan_id", "label").count().where(F.col("count") < min_cells).select("scan_id", "label", F.lit(True).alias("small"))
    return relabel(labels.join(F.broadcast(small), ["scan_id", "label"], "left").select(*CELL, F.when(F.col("small"), F.lit(0)).otherwise(F.col("label")).alias("label")))


def residual(free: DataFrame, labels: DataFrame) -> DataFrame:
    """Free cells that no room claims."""
    return free.join(labels.where("label >= 1").select(*CELL), CELL, "left_anti")


def grown_rooms(labels: DataFrame, free: DataFrame, grid: DataFrame, px: int) -> DataFrame:
    """Rooms grown into unclaimed free cells within px, walls in the way; nearest room along free cells first."""
    if px <= 0:
        return labels
    near = dilate(room_masks(labels).select(*CELL), disc(px), grid).join(residual(free, labels), CELL, "left_semi")
    field = room_masks(labels).select(*CELL).union(near.select(*CELL)).withColumn("d2", F.lit(0.0))
    grown = basins(field, labels.where("label >= 1").select(*CELL, F.col("label").cast("long").alias("seed")))
    return grown.where("label >= 1").unionByName(labels.where("label < 1").join(grown.where("label >= 1").select(*CELL), CELL, "left_anti").select(*CELL, F.col("label").cast("long").alias("label")))


def add_residual(labels: DataFrame, extra: DataFrame) -> DataFrame:
    """Further rooms found on residual cells, with fresh ids above the present ones; cells already claimed stay."""
    top = labels.groupBy("scan_id").agg(F.greatest(F.max("label"), F.lit(0)).alias("top"))
    claimed = labels.where("label <> 0").select(*CELL)
    fresh = relabel(extra.where("label >= 1").join(claimed, CELL, "left_anti")).join(F.broadcast(top), "scan_id").select(*CELL, (F.col("label") + F.col("top")).alias("label"))
    return relabel(labels.join(fresh.select(*CELL), CELL, "left_anti").select(*CELL, F.col("label").cast("long").alias("label")).unionByName(fresh))


def split_by_distance(labels: DataFrame, parts: DataFrame, dt: DataFrame) -> DataFrame:
    """Rooms cut in two along the distance ridge between two seed parts (scan_id, row, col, seed 1 or 2 per room)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        shape = (r.max() + 1, c.max() + 1)
        mask = K.dense(r, c, True, shape, False)
        found = K.flood(K.dense(r, c, -np.sqrt(pdf["d2"].to_numpy(float)), shape, 0.0), K.dense(r, c, pdf["seed"].to_numpy(np.int64), shape, 0), mask)
        return pdf.assign(part=np.where(found[r, c] == 1, 1, 2))[["scan_id", "label", "row", "col", "part"]]

    rooms = labels.where("label >= 1").join(dt.select(*CELL, F.col("d2").cast("double").alias("d2")), CELL).join(parts, CELL, "left")
    rooms = rooms.select("scan_id", "label", "row", "col", "d2", F.coalesce(F.col("seed").cast("long"), F.lit(0).cast("long")).alias("seed"))
    return rooms.groupBy("scan_id", "label").applyInPandas(run, "scan_id int, label long, row long, col long, part int")


def relabel_by_masks(labels: DataFrame, walls: DataFrame, dt: DataFrame, grid: DataFrame, masks: DataFrame, scores: DataFrame, config: Config, covered: DataFrame | None = None) -> DataFrame:
    """One pass of splits and merges of rooms by their prompted masks (scan_id, room_id, row, col) and scores.

    A room splits if its confident mask and the rest are both large enough, a cut along the distance ridge exists,
    and the parts are as sane as the room. Two rooms merge if a confident mask of either covers enough of both, no
    more than a little of their interface is wall, the opening is wide, and the union is as sane; split rooms do
    not merge. No room keeps a wall cell.
    """
    reach = max(2, (wall_thickness(walls, grid).agg(F.max("px")).first()[0] or 1) + 1)
    labels, walls, dt, grid = settle(labels), settle(walls), settle(dt), settle(grid)
    clean = masks.distinct().join(walls.select(*CELL), CELL, "left_anti")
    sure = scores.where(F.col("score") >= config.sam_conf_thresh)
    rooms = room_masks(labels)
    area = rooms.groupBy(*ROOM).agg(F.count("*").alias("area"))
    own = rooms.join(clean.withColumn("m", F.lit(1)), [*ROOM, "row", "col"], "left").join(sure.select(*ROOM), ROOM, "left_semi")
    halves = own.groupBy(*ROOM).agg(F.count("m").alias("hit"), F.count("*").alias("area"))
    least = config.sam_split_min_frac * F.col("area")
    wanted = halves.where((F.col("hit") >= least) & (F.col("area") - F.col("hit") >= least)).select(*ROOM)
    pieces = own.join(wanted, ROOM, "left_semi").select(*ROOM, "row", "col", F.when(F.col("m").isNotNull(), 1).otherwise(2).alias("seed"))
    cores = [erode(pieces.where(F.col("seed") == s).select(*ROOM, "row", "col"), disc(1), grid, ROOM).withColumn("seed", F.lit(s)) for s in (1, 2)]
    some = cores[0].unionByName(cores[1])
    kept = pieces.join(some.select(*ROOM, "seed").distinct(), [*ROOM, "seed"], "left_anti").select(*ROOM, "row", "col", "seed").unionByName(some)
    cut = settle(split_by_distance(labels.join(wanted.withColumnRenamed("room_id", "label"), ["scan_id", "label"], "left_semi"), kept.select(*CELL, "seed"), dt)).withColumnRenamed("label", "room_id")
    before = sanity(rooms, covered, walls).withColumnRenamed("score", "before")
    by_part = sanity(cut.withColumn("room_id", F.col("room_id") * 2 + F.col("part") - 1).select(*ROOM, "row", "col"), covered, walls).select("scan_id", F.floor(F.col("room_id") / 2).alias("room_id"), "score")
    good = by_part.groupBy(*ROOM).agg(F.avg("score").alias("after"), F.count("*").alias("parts")).join(before, ROOM).where((F.col("parts") == 2) & (F.col("after") >= F.col("before") + config.sam_min_sanity_margin)).select(*ROOM)
    good = settle(good)

    pairs = adjacent(labels, grid, reach)
    held = clean.withColumnRenamed("room_id", "mask").join(rooms, CELL).groupBy("scan_id", "mask", "room_id").agg(F.count("*").alias("hit")).join(area, ROOM).where(F.col("hit") >= config.sam_merge_cover_frac * F.col("area")).select("scan_id", "mask", "room_id")
    spans = held.withColumnRenamed("room_id", "a").join(held.withColumnRenamed("room_id", "b"), ["scan_id", "mask"]).where("a < b and (mask = a or mask = b)")
    spans = spans.join(sure.select("scan_id", F.col("room_id").alias("mask")), ["scan_id", "mask"], "left_semi").select("scan_id", "a", "b").distinct()
    weak = interface(labels, walls, dt, grid, reach).where((F.col("wall_frac") < config.sam_wall_frac_max) & (F.col("ridge") >= config.sam_open_ridge_m / config.pixel_m))
    votes = pairs.join(spans, ["scan_id", "a", "b"], "left_semi").join(weak, ["scan_id", "a", "b"], "left_semi")
    for end in ("a", "b"):
        votes = votes.join(good.withColumnRenamed("room_id", end), ["scan_id", end], "left_anti")
    votes = settle(votes)
    both = votes.withColumn("pair", F.col("a") * (1 << 20) + F.col("b"))
    union = both.select("scan_id", F.col("pair"), F.explode(F.array("a", "b")).alias("room_id")).join(rooms, ROOM).select("scan_id", F.col("pair").alias("room_id"), "row", "col")
    after = sanity(union, covered, walls).select("scan_id", F.col("room_id").alias("pair"), F.col("score").alias("after"))
    mean = both.join(before.select("scan_id", F.col("room_id").alias("a"), F.col("before").alias("x")), ["scan_id", "a"]).join(before.select("scan_id", F.col("room_id").alias("b"), F.col("before").alias("y")), ["scan_id", "b"])
    edges = mean.join(after, ["scan_id", "pair"]).where(F.col("after") >= (F.col("x") + F.col("y")) / 2 + config.sam_min_sanity_margin).select("scan_id", "a", "b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs_of = pdf[["a", "b"]].to_numpy().tolist()
        roots = K.graph_roots(pd.unique(pdf[["a", "b"]].to_numpy().ravel()).tolist(), pairs_of)
        return pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "room_id": list(roots), "root": list(roots.values())})

    roots = edges.unionByName(area.select("scan_id", F.col("room_id").alias("a"), F.col("room_id").alias("b"))).groupBy("scan_id").applyInPandas(run, "scan_id int, room_id long, root long")
    split = cut.join(good, ROOM, "left_semi").select(*ROOM, "row", "col", "part")
    named = rooms.join(split, [*ROOM, "row", "col"], "left").join(F.broadcast(roots), ROOM).select(*CELL, (F.col("root") * 2 + F.coalesce(F.col("part") - 1, F.lit(0))).cast("long").alias("label"))
    named = named.join(walls.select(*CELL), CELL, "left_anti")
    wall = walls.select(*CELL).distinct().withColumn("label", F.lit(-1).cast("long"))
    rest = labels.where("label = 0").join(walls.select(*CELL), CELL, "left_anti").select(*CELL, F.lit(0).cast("long").alias("label"))
    return relabel(named.unionByName(rest)).unionByName(wall)
