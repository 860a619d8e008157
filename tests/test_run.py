"""The whole run from a text cloud of two rooms to a model."""

import dataclasses
import json

import numpy as np
import pandas as pd

from scanloom.operators import openings as O
from scanloom.plans.config import Config
from scanloom.plans.run import model, run
from scanloom.sources import stages


def test_two_rooms_to_model(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 1500
    u = lambda top, k=n: rng.uniform(0, top, k)
    parts = [np.c_[u(8), u(5), np.zeros(n)], np.c_[u(8), u(5), np.full(n, 2.5)], np.c_[u(8), np.zeros(n), u(2.5)], np.c_[u(8), np.full(n, 5.0), u(2.5)], np.c_[np.zeros(n), u(5), u(2.5)], np.c_[np.full(n, 8.0), u(5), u(2.5)], np.c_[np.full(n, 4.0), u(5), u(2.5)]]
    np.savetxt(tmp_path / "two.xyz", np.concatenate(parts), fmt="%.4f")
    config = Config(file_path=str(tmp_path / "two.xyz"), voxel_m=0.0, pixel_m=0.1, min_points_per_cell=1, ceiling_mode="global", slab_lo_m=0.5, slab_hi_m=1.5, thicken_px=0, marker_h_m=0.5, normal_radius_m=0.4, min_wall_points=80, flat_pixel_m=0.2, morph_close_px=1, morph_open_px=0, use_sam_recall=False)
    out = str(tmp_path / "out")
    run(spark, config, out)
    labels = stages.load_table(spark, out, stages.STAGES[1], "labels")
    assert {r.label for r in labels.select("label").distinct().collect()} >= {-1, 1, 2}
    rooms = {r.room_id: r["count"] for r in stages.load_table(spark, out, stages.STAGES[4], "points").groupBy("room_id").count().collect()}
    assert set(rooms) == {1, 2} and min(rooms.values()) > 1000
    with open(f"{out}/{stages.STAGES[9]}/{stages.BUILDING_JSON}") as f:
        doc = json.load(f)
    assert len(doc["walls"]) >= 5 and len(doc["rooms"]) == 2
    with open(f"{out}/{stages.STAGES[9]}/{stages.MODEL}") as f:
        assert f.read().count("=IFCWALL(") == len(doc["walls"])


def test_a_doorway_becomes_a_door_of_the_kept_wall(spark, tmp_path):
    def wall(room, y, length, door):
        x, z = (v.ravel() for v in np.meshgrid(np.arange(0, length, 0.04), np.arange(0, 2.5, 0.04)))
        there = ~((x > 1.5) & (x < 2.5) & (z < 2.1)) if door else np.full(len(x), True)
        return pd.DataFrame({"scan_id": np.int32(0), "room_id": room, "wall_id": 1, "peak": 0, "x": x, "y": y, "z": z, "wx": 0.0, "wy": 1.0, "offset": y})[there]

    out, config = str(tmp_path), Config(ifc_min_directions=1, flat_pixel_m=0.1, morph_close_px=0, morph_open_px=0)
    segments = spark.createDataFrame(pd.concat([wall(1, 0.0, 4.0, True), wall(2, 0.1, 5.0, False)]))
    stages.save_table(segments, out, stages.STAGES[7], "segments")
    model(spark, config, out)
    images, faces, doors = (stages.load_table(spark, out, stages.STAGES[9], n) for n in ("images", "faces", "doors"))
    door = doors.collect()
    assert [(r.room_id, r.wall_id) for r in door] == [(1, 1)]
    assert abs(door[0].x - 2.5) < 0.15 and abs(door[0].y) < 1e-6 and abs(door[0].width - 1.0) < 0.15 and abs(door[0].height - 2.1) < 0.15
    assert O.wall_doors(images, faces, dataclasses.replace(config, door_max_wall_width_frac=0.2)).count() == 0
    with open(f"{out}/{stages.STAGES[9]}/{stages.BUILDING_JSON}") as f:
        doc = json.load(f)
    assert [w["id"] for w in doc["walls"]] == ["W1"] and [d["wall"] for d in doc["doors"]] == ["W1"]
    assert abs(doc["doors"][0]["width"] - 1.0) < 0.15
    with open(f"{out}/{stages.STAGES[9]}/{stages.MODEL}") as f:
        text = f.read()
    assert text.count("=IFCDOOR(") == 1 and text.count("=IFCOPENINGELEMENT(") == 1
