"""Segmentation models as plug-ins: protocols, and the drivers that run without one.

No model weights come with this package; `backends` loads those that are installed. A back end is any object with the methods below; it is called once per
scan inside a grouped map, so it must be picklable or build itself on first use.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config
from .regions import CELL
from .rooms import add_residual, drop_small, grown_rooms, relabel_by_masks, residual, resolve_masks, room_masks, sample_interior


class PromptedSegmenter(Protocol):
    def set_image(self, image: np.ndarray) -> None: ...

    def predict(self, point_coords=None, point_labels=None, box=None, multimask_output=True) -> tuple[np.ndarray, np.ndarray]: ...


class AutomaticSegmenter(Protocol):
    def generate(self, image: np.ndarray) -> list[dict]: ...


def image_cells(free: DataFrame, wall_cells: DataFrame | None, covered: DataFrame | None, mode: str = "stack") -> DataFrame:
    """Cells with three channels: free, wall and covered (0 or 255), or free three times."""
    base = free.select(*CELL).withColumn("free", F.lit(255))
    if mode != "stack" or wall_cells is None or covered is None:
        return base.select(*CELL, F.array("free", "free", "free").alias("rgb"))
    other = lambda c, name: c.select(*CELL).distinct().withColumn(name, F.lit(255))
    full = base.join(other(wall_cells, "w"), CELL, "full").join(other(covered, "c"), CELL, "full")
    return full.select(*CELL, F.array(*[F.coalesce(c, F.lit(0)) for c in ("free", "w", "c")]).alias("rgb"))


def _picture(pdf: pd.DataFrame) -> np.ndarray:
    out = np.zeros((pdf["row"].max() + 1, pdf["col"].max() + 1, 3), np.uint8)
    out[pdf["row"], pdf["col"]] = np.stack(pdf["rgb"].to_numpy())
    return out


def automatic_masks(image: DataFrame, segmenter: AutomaticSegmenter) -> DataFrame:
    """scan_id, mask_id, score, row, col of the masks that a segmenter generates for each scan's picture."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for k, m in enumerate(segmenter.generate(_picture(pdf))):
            r, c = np.nonzero(np.asarray(m["segmentation"], bool))
            frames.append(pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "mask_id": k, "score": float(m.get("predicted_iou", 1.0)), "row": r, "col": c}))
        return pd.concat(frames) if frames else pd.DataFrame({"scan_id": [], "mask_id": [], "score": [], "row": [], "col": []})

    return image.groupBy("scan_id").applyInPandas(run, "scan_id int, mask_id long, score double, row long, col long")


def automatic_rooms(image: DataFrame, free: DataFrame, walls: DataFrame, covered: DataFrame | None, grid: DataFrame, config: Config, segmenter: AutomaticSegmenter | None = None, residual_segmenter: AutomaticSegmenter | None = None) -> tuple[DataFrame, bool]:
    """(label map, whether a segmenter ran). Without one all free cells are exterior."""
    wall = walls.select(*CELL).distinct().withColumn("label", F.lit(-1).cast("long"))
    if segmenter is None:
        return free.select(*CELL).withColumn("label", F.lit(0).cast("long")).unionByName(wall), False
    least = round(config.sam_auto_min_room_area_m2 / config.pixel_m**2)

    def labelled(picture: DataFrame, by: AutomaticSegmenter, within: DataFrame) -> DataFrame:
        masks = automatic_masks(picture, by)
        inside = masks.join(within.select(*CELL), CELL, "left_semi")
        return drop_small(resolve_masks(inside.select("scan_id", "mask_id", "row", "col"), masks.select("scan_id", "mask_id", "score").distinct(), walls, covered, config), least).where("label >= 1")

    rooms = labelled(image, segmenter, free)
    full = lambda r: r.unionByName(residual(free, r).select(*CELL, F.lit(0).cast("long").alias("label")))
    labels = full(rooms)
    if config.sam_reprocess_residual and residual_segmenter is not None:
        left = residual(free, labels)
        labels = add_residual(labels, labelled(image.join(left.select(*CELL), CELL, "left_semi"), residual_segmenter, left))
    if config.sam_auto_buffer_rooms:
        labels = grown_rooms(labels, free, grid, config.do_buffer_px)
    return labels.unionByName(wall), True


def prompted_masks(image: DataFrame, labels: DataFrame, dt: DataFrame, segmenter: PromptedSegmenter, config: Config) -> DataFrame:
    """scan_id, room_id, score, row, col: the best mask for each room, prompted with points inside and outside it."""
    inside = sample_interior(room_masks(labels), dt, config.sam_pos_points)
    marks = inside.groupBy("scan_id").agg(F.collect_list(F.struct("room_id", "row", "col")).alias("marks"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        segmenter.set_image(_picture(pdf))
        marks_of: dict[int, list] = {}
        for m in pdf["marks"].iloc[0]:
            marks_of.setdefault(int(m["room_id"]), []).append((int(m["col"]), int(m["row"])))
        frames = []
        for room, yes in sorted(marks_of.items()):
            no = [p for other, ps in sorted(marks_of.items()) if other != room for p in ps][: config.sam_neg_points] if config.sam_use_neg_points else []
            xs, ys = [x for x, _ in yes], [y for _, y in yes]
            masks, scores = segmenter.predict(np.array(yes + no, float), np.array([1] * len(yes) + [0] * len(no)), np.array([min(xs), min(ys), max(xs), max(ys)]), True)
            best = int(np.argmax(scores))
            r, c = np.nonzero(np.asarray(masks[best], bool))
            frames.append(pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "room_id": room, "score": float(scores[best]), "row": r, "col": c}))
        return pd.concat(frames) if frames else pd.DataFrame({"scan_id": [], "room_id": [], "score": [], "row": [], "col": []})

    return image.join(F.broadcast(marks), "scan_id").groupBy("scan_id").applyInPandas(run, "scan_id int, room_id long, score double, row long, col long")


def refine_rooms(labels: DataFrame, image: DataFrame, walls: DataFrame, dt: DataFrame, grid: DataFrame, config: Config, segmenter: PromptedSegmenter | None = None, covered: DataFrame | None = None) -> DataFrame:
    """Rooms relabelled by prompted masks; the labels as they are if refinement is off or there is no segmenter."""
    if not config.use_sam_recall or segmenter is None:
        return labels
    found = prompted_masks(image, labels, dt, segmenter, config)
    return relabel_by_masks(labels, walls, dt, grid, found.select("scan_id", "room_id", "row", "col"), found.select("scan_id", "room_id", "score").distinct(), config, covered)
