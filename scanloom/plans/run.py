"""The pipeline from a scan to a building: python -m scanloom.plans.run --cloud FILE --out FOLDER [--from-stage N]."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import backends
from ..operators import building as B
from ..operators import metrics as M
from ..operators import openings as O
from ..operators import points as P
from ..operators import raster as R
from ..operators import regions as G
from ..operators import rooms as Q
from ..operators import stencil as S
from ..operators import walls as W
from ..operators.segmenters import automatic_rooms, image_cells, refine_rooms
from ..sources import clouds, sinks, stages
from . import ifc
from .config import Config, check_upstream, load_config


def _cloud(spark: SparkSession, config: Config) -> DataFrame:
    read = clouds.read_ply if config.file_path.endswith(".ply") else clouds.read_xyz
    return P.voxel_means(P.scaled(read(spark, config.file_path), config.units_per_meter), config.voxel_m).select("scan_id", "x", "y", "z")


def occupancy(spark: SparkSession, config: Config, out: str) -> None:
    """Stage 1: the rasters of the slab and of the whole cloud, and their grid."""
    points = _cloud(spark, config)
    stages.save_table(points, out, stages.STAGES[0], "points")
    points = stages.load_table(spark, out, stages.STAGES[0], "points")
    slab = P.crop_slab(points, config)
    grid = R.grid_of(slab, config.pixel_m, config.up_axis)
    cells = R.occupancy(slab, grid, min_points=config.min_points_per_cell, up_axis=config.up_axis)
    stages.save_table(grid, out, stages.STAGES[0], "transform")
    grid = stages.load_table(spark, out, stages.STAGES[0], "transform")
    for name, table in {"occupancy": S.thicken(cells, config.thicken_px, grid), "wallness": R.wallness(points, grid, config), "coverage": S.closed(R.coverage(points, grid, config), S.disc(config.coverage_close_px), grid)}.items():
        stages.save_table(table, out, stages.STAGES[0], name)


def rooms(spark: SparkSession, config: Config, out: str) -> None:
    """Stage 2: watershed rooms of the occupancy raster (or of wallness)."""
    check_upstream(config, stages.stage_config(out, stages.STAGES[0]))
    load = lambda n: stages.load_table(spark, out, stages.STAGES[0], n)
    walls = load("wallness" if config.use_wallness else "occupancy")
    stages.save_table(G.watershed_rooms(walls, load("transform"), config, load("coverage")), out, stages.STAGES[1], "labels")


def refined(spark: SparkSession, config: Config, out: str, segmenter=None) -> None:
    """Stage 3: rooms refined by a prompted segmenter; as they are without one."""
    labels, grid = stages.load_table(spark, out, stages.STAGES[1], "labels"), stages.load_table(spark, out, stages.STAGES[0], "transform")
    covered = stages.load_table(spark, out, stages.STAGES[0], "coverage")
    walls = labels.where("label = -1").select("scan_id", "row", "col")
    image = image_cells(S.free_cells(walls, grid), walls, covered, config.sam_image_mode)
    stages.save_table(refine_rooms(labels, image, walls, S.distance(walls, grid), grid, config, segmenter, covered), out, stages.STAGES[3], "labels")


def room_clouds(spark: SparkSession, config: Config, out: str, refined_labels: bool = True) -> None:
    """Stage 4: the wall points around each room, by room_id. Raises if a cloud does not lie in its grid."""
    labels = stages.load_table(spark, out, stages.STAGES[3 if refined_labels else 1], "labels")
    load = lambda n: stages.load_table(spark, out, stages.STAGES[0], n)
    grid, points = load("transform"), load("points")
    R.check_in_grid(points, grid, up_axis=config.up_axis).agg(F.min("frac")).collect()
    # Every scan has its own wall thickness; few whole numbers of pixels occur.
    thickness = S.wall_thickness(labels.where("label = -1"), grid)
    ring = None
    for px in sorted(r.px for r in thickness.select("px").distinct().collect()) or [1]:
        of_px = labels.join(thickness.where(F.col("px") == px), "scan_id", "left_semi")
        part = Q.boundary_ring(of_px, load("wallness"), grid, *Q.ring_radii(config, px))
        ring = part if ring is None else ring.unionByName(part)
    inside = Q.backproject(P.height_band(points, config), ring, grid, config.up_axis)
    stages.save_table(inside.select("scan_id", "room_id", "x", "y", "z"), out, stages.STAGES[4], "points", partition_by="room_id")
    sinks.save_room_clouds(stages.load_table(spark, out, stages.STAGES[4], "points").withColumn("room_id", F.col("room_id").cast("long")), stages.stage_dir(out, stages.STAGES[4])).count()


def _segments(spark: SparkSession, config: Config, out: str) -> DataFrame:
    p = stages.load_table(spark, out, stages.STAGES[4], "points").withColumn("room_id", F.col("room_id").cast("long"))
    # The number follows from the point, so a task that runs again gives the same one.
    number = F.row_number().over(Window.partitionBy("scan_id", "room_id").orderBy("x", "y", "z"))
    return W.wall_segments(p.withColumn("pid", F.col("room_id") * (1 << 40) + number), config)


def wall_images(spark: SparkSession, config: Config, out: str) -> None:
    """Stage 5: wall segments and their front views."""
    stages.save_table(_segments(spark, config, out), out, stages.STAGES[7], "segments")
    segments = stages.load_table(spark, out, stages.STAGES[7], "segments")
    clean = W.without_outliers(segments, W.WALL, config.sor_neighbours, config.sor_std_ratio)
    stages.save_table(W.flattened(clean, config), out, stages.STAGES[7], "images")
    images = stages.load_table(spark, out, stages.STAGES[7], "images")
    sinks.save_wall_images(images, segments, stages.stage_dir(out, stages.STAGES[7]), config).count()


def found_openings(spark: SparkSession, config: Config, out: str) -> None:
    """Stage 6: doors and windows in the front views."""
    images = stages.load_table(spark, out, stages.STAGES[7], "images")
    grid = images.select(*W.WALL, "width", "height", "u_min").distinct()
    voids = O.voids(images, grid, min_px=config.min_void_px, keys=W.WALL)
    joined = O.merged(voids, W.WALL, config.door_floor_margin_px).join(grid.withColumnRenamed("height", "img_h"), W.WALL)
    stages.save_table(O.classified(joined, config), out, stages.STAGES[8], "openings")
    openings = stages.load_table(spark, out, stages.STAGES[8], "openings")
    sinks.save_openings(openings, stages.stage_dir(out, stages.STAGES[8])).count()
    sinks.save_annotated_walls(images, openings, stages.stage_dir(out, stages.STAGES[8])).count()


def model(spark: SparkSession, config: Config, out: str) -> None:
    """Stage 7: the building document and its IFC text of every scan; in folders scan_<id> if there are several."""
    segments = stages.load_table(spark, out, stages.STAGES[7], "segments")
    enough = segments.groupBy("scan_id", "room_id").agg(F.countDistinct("peak").alias("n")).where(F.col("n") >= config.ifc_min_directions)
    walls = B.usable(B.wall_geometry(segments.join(enough, ["scan_id", "room_id"], "left_semi")), config)
    keep = lambda table, n: (stages.save_table(table, out, stages.STAGES[9], n), stages.load_table(spark, out, stages.STAGES[9], n))[1]
    faces = keep(B.merged_faces(walls, config), "faces")
    doors = keep(O.wall_doors(keep(O.face_images(segments, faces, config), "images"), faces, config), "doors")
    # From here on a wall's number is unique in its scan, not only in its room.
    number = F.row_number().over(Window.partitionBy("scan_id").orderBy("room_id", "wall_id")).cast("long")
    numbers = keep(faces.select("scan_id", "room_id", "wall_id", number.alias("number")), "numbers")
    renumbered = lambda t: t.join(numbers, ["scan_id", "room_id", "wall_id"]).withColumn("wall_id", F.col("number")).drop("number")
    doors, faces = renumbered(doors), renumbered(faces)
    faces = B.grouped(B.snapped_angles(faces, B.dominant_angles(faces, config.wseg_angle_tol_deg), config.wseg_angle_tol_deg), config)
    unique = B.snapped_ends(B.deduplicated(faces, config).drop("rooms", "sources"), config.ifc_snap_tolerance_m)
    doc = B.document(unique, B.carried(doors, faces, config), faces, config)
    doc = keep(doc, "documents")
    several, folder = doc.count() > 1, stages.stage_dir(out, stages.STAGES[9])

    def write(batches):
        for pdf in batches:
            for scan, text in zip(pdf["scan_id"], pdf["text"], strict=True):
                place = os.path.join(folder, f"scan_{scan}") if several else folder
                rows, report = ifc.build_with_report(json.loads(text), config)
                sinks.put(os.path.join(place, stages.MODEL), ifc.step_text(rows))
                sinks.put(os.path.join(place, stages.BUILDING_JSON), text)
                yield pd.DataFrame([{"scan_id": scan, **dataclasses.asdict(report)}])

    texts = doc.select("scan_id", F.to_json(F.struct("project", "storeys", "walls", "doors", "windows", "rooms")).alias("text"))
    stages.save_table(texts.mapInPandas(write, REPORT), out, stages.STAGES[9], "report")


REPORT = "scan_id int, elements_enriched long, classification_refs_added long, property_sets_added long, quantity_sets_added long, validation_warnings array<string>"


def automatic(spark: SparkSession, config: Config, out: str, segmenter=None, residual_segmenter=None) -> bool:
    """Rooms by a segmenter that needs no prompts, and their pictures; False, and all exterior, without one."""
    load = lambda n: stages.load_table(spark, out, stages.STAGES[0], n)
    grid, walls, covered = load("transform"), load("wallness" if config.use_wallness else "occupancy"), load("coverage")
    free = S.free_cells(walls, grid)
    image = image_cells(free, walls, covered, config.sam_image_mode)
    labels, ran = automatic_rooms(image, free, walls, covered, grid, config, segmenter, residual_segmenter)
    stages.save_table(labels, out, stages.STAGES[5], "labels")
    saved = stages.load_table(spark, out, stages.STAGES[5], "labels")
    sinks.save_label_pictures(saved, grid, stages.stage_dir(out, stages.STAGES[5])).count()
    return ran


#: Names of the methods that are compared, and the stage each one's label map comes from.
METHODS = {"Geometry": stages.STAGES[1], "SAM": stages.STAGES[5], "Geometry + SAM": stages.STAGES[3]}


def method_labels(spark: SparkSession, out: str) -> dict[str, DataFrame | None]:
    """The label map of every method; None where its stage has not run."""
    found = {}
    for method, stage in METHODS.items():
        try:
            folder = stages.find_stage(out, stage)
        except FileNotFoundError:
            folder = None
        there = folder is not None and os.path.isdir(os.path.join(folder, "labels"))
        found[method] = stages.load_table(spark, out, stage, "labels") if there else None
    return found


def evaluated(spark: SparkSession, config: Config, out: str, annotations: DataFrame, *, least_inside: float = 0.98, skip_walls: bool = True) -> DataFrame:
    """Scores of every method that has run against annotated rooms: method, and the columns of scores and of quality.

    Raises if less than least_inside of a scan's annotated points lie in its grid: they belong to another scan.
    """
    grid, walls = stages.load_table(spark, out, stages.STAGES[0], "transform"), stages.load_table(spark, out, stages.STAGES[0], "wallness")
    R.check_in_grid(annotations, grid, least_inside, config.up_axis).agg(F.min("frac")).collect()
    truth = M.truth_labels(annotations, grid, clouds.NOT_INTERIOR)
    scores = None
    for method, labels in method_labels(spark, out).items():
        if labels is None:
            continue
        cells = M.compared(labels, truth, walls if skip_walls else None)
        one = M.room_scores(cells).join(M.panoptic(cells), "scan_id").withColumn("method", F.lit(method))
        scores = one if scores is None else scores.unionByName(one)
    if scores is None:
        raise FileNotFoundError(f"no method has run in {out}")
    return scores


STEPS = [(stages.STAGES[0], occupancy), (stages.STAGES[1], rooms), (stages.STAGES[3], refined), (stages.STAGES[4], room_clouds), (stages.STAGES[7], wall_images), (stages.STAGES[8], found_openings), (stages.STAGES[9], model)]


def run(spark: SparkSession, config: Config, out: str, first: int = 1, last: int = 7, skip_refinement: bool = False, segmenter=None) -> None:
    """Stages first to last; stage 3 with the segmenter given, and without one it keeps the rooms as they are."""
    for k, (name, step) in enumerate(STEPS, 1):
        if not first <= k <= last or (k == 3 and skip_refinement):
            continue
        if step is room_clouds:
            step(spark, config, out, not skip_refinement)
        elif step is refined:
            step(spark, config, out, segmenter)
        else:
            step(spark, config, out)
        stages.save_config(out, name, config)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--params", default="params.yaml")
    parser.add_argument("--cloud")
    parser.add_argument("--out")
    parser.add_argument("--skip-sam", action="store_true", help="leave out stage 3")
    parser.add_argument("--from-stage", type=int, default=1, choices=range(1, 8))
    parser.add_argument("--to-stage", type=int, default=7, choices=range(1, 8))
    a = parser.parse_args(argv)
    config = load_config(a.params, **({"file_path": os.path.abspath(a.cloud)} if a.cloud else {}))
    spark = SparkSession.builder.appName("scanloom").getOrCreate()
    segmenter = None
    if not a.skip_sam and config.use_sam_recall:
        try:
            segmenter = backends.prompted(config)
        except ModuleNotFoundError as e:
            print(f"{e}; stage 3 keeps the rooms as they are")
    run(spark, config, a.out or config.out_root, a.from_stage, a.to_stage, a.skip_sam, segmenter)


if __name__ == "__main__":
    main()
