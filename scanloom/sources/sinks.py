"""Files for people and other programs, one per room, wall or scan; written by the tasks that hold the rows.

A group is a room's points, a wall's picture or a scan's document, each bounded by the building. Folders must be
reachable by all executors; a file is written beside its place and moved, so a retried task leaves one whole file.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.views import label_colours
from ..plans.config import Config
from .clouds import format_ply, png_bytes

_FILES = "scan_id int, file string"
WALL_META, OPENINGS, ALL_OPENINGS = "wall_meta.json", "openings.json", "all_openings.json"


def put(path: str, data: bytes | str) -> str:
    """Write a whole file, whatever was there before."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)
    os.replace(temporary, path)
    return path


def room_name(scan: int, room: int) -> str:
    """The folder or file name of a room; rooms of scans other than 0 carry the scan."""
    return f"room_{room:02d}" if scan == 0 else f"scan_{scan}_room_{room:02d}"


def _per_group(rows: DataFrame, keys: list[str], write) -> DataFrame:
    """scan_id and file of what write(rows of a group) has written; runs when the result is used."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        files = write(pdf)
        return pd.DataFrame({"scan_id": np.full(len(files), pdf["scan_id"].iloc[0], np.int32), "file": files})

    return rows.groupBy(*keys).applyInPandas(run, _FILES)


def save_room_clouds(points: DataFrame, folder: str) -> DataFrame:
    """A binary PLY file per room of (scan_id, room_id, x, y, z)."""
    return _per_group(points, ["scan_id", "room_id"], lambda p: [put(os.path.join(folder, room_name(int(p["scan_id"].iloc[0]), int(p["room_id"].iloc[0])) + ".ply"), format_ply(p.sort_values(["x", "y", "z"])))])


def wall_picture(cells: pd.DataFrame) -> np.ndarray:
    """Grey picture of a wall's set cells: white on black."""
    out = np.zeros((int(cells["height"].iloc[0]), int(cells["width"].iloc[0])), np.uint8)
    out[cells["row"], cells["col"]] = 255
    return out


def save_wall_images(images: DataFrame, segments: DataFrame, folder: str, config: Config) -> DataFrame:
    """Per room a PNG for each wall, numbered in the order of wall_id, and WALL_META with where each one stands."""
    plane = segments.groupBy("scan_id", "room_id", "wall_id").agg(F.first("wx").alias("wx"), F.first("wy").alias("wy"), F.first("offset").alias("offset"))

    def write(p: pd.DataFrame) -> list[str]:
        base = os.path.join(folder, room_name(int(p["scan_id"].iloc[0]), int(p["room_id"].iloc[0])))
        meta, files = [], []
        for k, (_, w) in enumerate(p.groupby("wall_id", sort=True), 1):
            one = w.iloc[0]
            files.append(put(os.path.join(base, f"wall_{k:02d}.png"), png_bytes(wall_picture(w))))
            size = {"width_m": float(one["u_max"] - one["u_min"]), "height_m": float(one["z_max"] - one["z_min"])}
            meta.append({"name": f"wall_{k:02d}", "normal_2d": [float(one["wx"]), float(one["wy"])], "offset": float(one["offset"]), "u_min": float(one["u_min"]), "u_max": float(one["u_max"]), **size})
        return [*files, put(os.path.join(base, WALL_META), json.dumps(meta, indent=2))]

    return _per_group(images.join(plane, ["scan_id", "room_id", "wall_id"]), ["scan_id", "room_id"], write)


def opening_records(openings: DataFrame) -> DataFrame:
    """scan_id, room_id, wall_id and the opening as a JSON text with rounded sizes."""
    rounded = lambda c, n: F.bround(F.col(c), n).alias(c)
    score = F.bround(F.col("sam_score"), 4) if "sam_score" in openings.columns else F.lit(0.0)
    fragments = F.col("n_fragments") if "n_fragments" in openings.columns else F.lit(1)
    record = F.struct("label", F.array("bx", "byy", "w", "h").alias("bbox_px"), rounded("width_m", 3), rounded("height_m", 3), rounded("sill_m", 3), "touches_floor", rounded("rectangularity", 3), score.alias("sam_score"), fragments.alias("n_fragments"), "reason")
    return openings.select("scan_id", "room_id", "wall_id", "bx", "byy", F.to_json(record).alias("record"))


def save_openings(openings: DataFrame, folder: str) -> DataFrame:
    """Per room OPENINGS, and per scan ALL_OPENINGS with those of all its rooms."""

    def walls(p: pd.DataFrame) -> list[dict]:
        return [{"wall": f"wall_{int(w):02d}", "openings": [json.loads(r) for r in g.sort_values(["bx", "byy"])["record"]]} for w, g in p.groupby("wall_id", sort=True)]

    def write(p: pd.DataFrame) -> list[str]:
        scan = int(p["scan_id"].iloc[0])
        rooms = {room_name(scan, int(r)): walls(g) for r, g in p.groupby("room_id", sort=True)}
        files = [put(os.path.join(folder, name, OPENINGS), json.dumps(found, indent=2)) for name, found in rooms.items()]
        return [*files, put(os.path.join(folder, ALL_OPENINGS if scan == 0 else f"scan_{scan}_{ALL_OPENINGS}"), json.dumps(rooms, indent=2))]

    return _per_group(opening_records(openings), ["scan_id"], write)


#: Colours of labels in annotated wall pictures.
OPENING_COLOURS = {"door": (0, 200, 0), "window": (0, 120, 255), "unknown": (200, 200, 0)}


def save_annotated_walls(images: DataFrame, openings: DataFrame, folder: str) -> DataFrame:
    """Per wall its picture with a frame around each opening, in the colour of its label."""
    keys = ["scan_id", "room_id", "wall_id"]
    boxes = openings.groupBy(*keys).agg(F.collect_list(F.struct("bx", "byy", "w", "h", "label")).alias("boxes"))

    def write(p: pd.DataFrame) -> list[str]:
        picture = np.repeat(wall_picture(p)[:, :, None], 3, axis=2)
        for x, y, w, h, label in [] if p["boxes"].iloc[0] is None else [tuple(b.values()) if isinstance(b, dict) else tuple(b) for b in p["boxes"].iloc[0]]:
            colour = OPENING_COLOURS.get(label, OPENING_COLOURS["unknown"])
            picture[y, x : x + w] = picture[min(y + h, len(picture)) - 1, x : x + w] = colour
            picture[y : y + h, x] = picture[y : y + h, min(x + w, picture.shape[1]) - 1] = colour
        name = f"wall_{int(p['wall_id'].iloc[0]):02d}_annotated.png"
        return [put(os.path.join(folder, room_name(int(p["scan_id"].iloc[0]), int(p["room_id"].iloc[0])), name), png_bytes(picture))]

    return _per_group(images.join(boxes, keys, "left"), keys, write)


def save_label_pictures(labels: DataFrame, grid: DataFrame, folder: str, name: str = "labels") -> DataFrame:
    """Per scan a PNG of its label map: walls black, exterior grey, rooms in the colours of `label_colours`."""
    import colorsys

    def write(p: pd.DataFrame) -> list[str]:
        out = np.full((int(p["height"].iloc[0]), int(p["width"].iloc[0]), 3), 128, np.uint8)
        hue = p["hue"].to_numpy(float)
        colours = {h: [round(255 * v) for v in colorsys.hsv_to_rgb(h / 360, 0.6, 0.95)] for h in set(hue[~np.isnan(hue)].tolist())}
        shade = [(0, 0, 0) if label == -1 else colours.get(h, (128, 128, 128)) for label, h in zip(p["label"], hue.tolist(), strict=True)]
        out[p["row"], p["col"]] = shade
        scan = int(p["scan_id"].iloc[0])
        return [put(os.path.join(folder, f"{name}.png" if scan == 0 else f"scan_{scan}_{name}.png"), png_bytes(out))]

    return _per_group(label_colours(labels).join(grid.select("scan_id", "width", "height"), "scan_id"), ["scan_id"], write)
