"""Files, enrichment, back ends and evaluation of a run."""

import json
import math
import sys
import types

import numpy as np
import pandas as pd
import pytest

from scanloom.operators import backends, metrics
from scanloom.plans import ifc
from scanloom.plans.config import Config
from scanloom.plans.run import automatic, evaluated, method_labels
from scanloom.sources import sinks, stages
from scanloom.sources.clouds import parse_ply, parse_png

DOC = {
    "project": {"name": "P"}, "storeys": [{"id": "L0", "name": "Ground", "elevation": 0.0}],
    "walls": [{"id": "W1", "storey": "L0", "start": [0.0, 0.0], "end": [4.0, 3.0], "height": 2.5, "thickness": 0.2}, {"id": "W2", "storey": "L0", "start": [0.0, 0.0], "end": [0.0, 0.1], "height": 2.5, "thickness": 0.2}],
    "doors": [{"id": "D1", "wall": "W1", "offset": 1.0, "width": 3.0, "height": 2.0}], "windows": [{"id": "N1", "wall": "W1", "offset": 4.0, "width": 0.5, "height": 1.0, "sill": 0.9}],
    "rooms": [{"id": "1", "storey": "L0", "name": "Room 01", "boundary": [[0, 0], [4, 0], [4, 3], [0, 3]], "height": 2.5}],
}


def test_enrichment_reaches_the_model():
    plain, nothing = ifc.build_with_report(DOC, Config())
    assert nothing == ifc.Report() and not [r for r in plain if r[1] == "IFCPROPERTYSET"]
    rows, report = ifc.build_with_report(DOC, Config(bsdd_enrich=True))
    kinds = pd.Series([r[1] for r in rows]).value_counts()
    # two walls, a door, a window, a space and its slab
    assert (report.elements_enriched, report.property_sets_added, report.quantity_sets_added, report.classification_refs_added) == (6, 6, 6, 6)
    assert kinds["IFCPROPERTYSET"] == kinds["IFCELEMENTQUANTITY"] == 6 and kinds["IFCDOOR"] == kinds["IFCWINDOW"] == 1
    text = ifc.step_text(rows)
    assert "IFCQUANTITYLENGTH('Length',$,$,5.,$)" in text and "IFCQUANTITYAREA('GrossFloorArea',$,$,12.,$)" in text
    assert "IFCPROPERTYSINGLEVALUE('IsExternal',$,IFCBOOLEAN(.F.),$)" in text
    assert report.validation_warnings == ["Wall-W2 length 0.10m outside typical range [0.2, 30.0]m", "Door-D1 width 3.00m outside typical range [0.5, 2.5]m"]
    assert ifc.build_with_report(DOC, Config(bsdd_enrich=True, bsdd_add_psets=False, bsdd_add_qtos=False, bsdd_add_classifications=False, bsdd_validate_geometry=False))[1] == ifc.Report(6)


def test_files_of_rooms_walls_openings_and_labels(spark, tmp_path):
    folder = str(tmp_path)
    points = spark.createDataFrame([(s, r, float(k), 1.0, 2.0) for s in (0, 1) for r in (1, 2) for k in range(r + 3)], "scan_id int, room_id long, x double, y double, z double")
    files = {r.file for r in sinks.save_room_clouds(points, folder).collect()}
    assert files == {f"{folder}/{n}.ply" for n in ("room_01", "room_02", "scan_1_room_01", "scan_1_room_02")}
    with open(f"{folder}/room_02.ply", "rb") as f:
        assert parse_ply(f.read())["x"].tolist() == [0.0, 1.0, 2.0, 3.0, 4.0]
    images = spark.createDataFrame([(0, 1, w, r, c, 6, 4, 0.5, 2.5, 0.0, 2.0) for w in (3, 5) for r in range(4) for c in range(6) if (r, c) != (1, 2)], "scan_id int, room_id long, wall_id long, row long, col long, width long, height long, u_min double, u_max double, z_min double, z_max double")
    segments = spark.createDataFrame([(0, 1, w, 0.0, 1.0, float(w)) for w in (3, 5)], "scan_id int, room_id long, wall_id long, wx double, wy double, offset double")
    sinks.save_wall_images(images, segments, folder, Config()).collect()
    with open(f"{folder}/room_01/{sinks.WALL_META}") as f:
        meta = json.load(f)
    assert [(m["name"], m["offset"], m["width_m"], m["height_m"], m["normal_2d"]) for m in meta] == [("wall_01", 3.0, 2.0, 2.0, [0.0, 1.0]), ("wall_02", 5.0, 2.0, 2.0, [0.0, 1.0])]
    with open(f"{folder}/room_01/wall_01.png", "rb") as f:
        picture = parse_png(f.read())
    assert picture.shape == (4, 6) and picture[1, 2] == 0 and (picture == 255).sum() == 23
    openings = spark.createDataFrame([(0, 1, 3, 2, 1, 1, 1, 0.12345, 0.5, 0.25, False, 0.98765, "window", "why")], "scan_id int, room_id long, wall_id long, bx long, byy long, w long, h long, width_m double, height_m double, sill_m double, touches_floor boolean, rectangularity double, label string, reason string")
    sinks.save_openings(openings, folder).collect()
    with open(f"{folder}/{sinks.ALL_OPENINGS}") as f:
        rooms = json.load(f)
    assert rooms == {"room_01": [{"wall": "wall_03", "openings": [{"label": "window", "bbox_px": [2, 1, 1, 1], "width_m": 0.123, "height_m": 0.5, "sill_m": 0.25, "touches_floor": False, "rectangularity": 0.988, "sam_score": 0.0, "n_fragments": 1, "reason": "why"}]}]}
    sinks.save_annotated_walls(images, openings, folder).collect()
    with open(f"{folder}/room_01/wall_03_annotated.png", "rb") as f:
        assert tuple(parse_png(f.read())[1, 2]) == sinks.OPENING_COLOURS["window"]
    labels = spark.createDataFrame([(0, 0, 0, -1), (0, 0, 1, 1), (0, 1, 0, 2)], "scan_id int, row long, col long, label long")
    grid = spark.createDataFrame([(0, 3, 2)], "scan_id int, width long, height long")
    (row,) = sinks.save_label_pictures(labels, grid, folder).collect()
    with open(row.file, "rb") as f:
        picture = parse_png(f.read())
    assert picture.shape == (2, 3, 3) and not picture[0, 0].any() and (picture[1, 2] == 128).all() and (picture[0, 1] != picture[1, 0]).any()


def test_back_ends(monkeypatch):
    with pytest.raises(ValueError, match="unknown segmenter"):
        backends.automatic(Config(sam_backend="other"))
    with pytest.raises(ModuleNotFoundError, match="needs the package 'sam2'"):
        backends.prompted(Config())
    assert backends.generator_settings(Config(sam_points_per_side=7))["points_per_side"] == 7

    class Predictor:
        def set_image(self, image):
            self.image = image

        def predict(self, **asked):
            self.asked = asked
            return np.ones((2, 3, 3)), [0.5, 0.75], None

    class Generator:
        def __init__(self, model, **settings):
            self.settings = settings

        def generate(self, image):
            return [{"segmentation": image[:, :, 0] > 0, "points": self.settings["points_per_side"]}]

    adapter = backends.PromptAdapter(Predictor())
    adapter.set_image([[1]])
    masks, scores = adapter.predict([[1, 2]], [1], multimask_output=False)
    assert masks.dtype == bool and scores.tolist() == [0.5, 0.75] and adapter.predictor.asked["point_coords"].dtype == float
    fake = types.ModuleType("segment_anything")
    fake.SamPredictor, fake.SamAutomaticMaskGenerator = lambda model: Predictor(), Generator
    monkeypatch.setitem(sys.modules, "segment_anything", fake)
    monkeypatch.setattr(backends, "package_of", lambda config: "segment_anything")
    monkeypatch.setattr(backends, "_weights", lambda *a: None)
    whole, residual = backends.automatic(Config(sam_backend="sam1"))
    image = np.ones((2, 2, 3), np.uint8)
    assert [s.generate(image)[0]["points"] for s in (whole, residual)] == [15, 5]
    prompted = backends.prompted(Config(sam_backend="sam1"))
    prompted.set_image(image)
    assert prompted.predict([[0, 0]], [1])[1].tolist() == [0.5, 0.75]


def test_truth_numbers_do_not_shift_and_walls_do_not_count(spark):
    rows = [(0, "a", "wall", 0.5, 0.5, 0.0), (0, "b", "floor", 1.5, 0.5, 0.0)]
    annotations = spark.createDataFrame(rows, "scan_id int, room string, class string, x double, y double, z double")
    grid = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 2, 1)], "scan_id int, a_min double, b_min double, pixel_size double, width long, height long")
    truth = metrics.truth_labels(annotations, grid, ("wall",))
    assert [(r.col, r.label) for r in truth.collect()] == [(1, 2)]
    pred = spark.createDataFrame([(0, 0, 0, 7), (0, 0, 1, 7)], "scan_id int, row long, col long, label long")
    assert sorted((r.col, r.pred, r.gt) for r in metrics.compared(pred, truth).collect()) == [(0, 7, 0), (1, 7, 2)]
    assert [r.col for r in metrics.compared(pred, truth, pred.where("col = 1")).collect()] == [0]


def test_automatic_rooms_and_evaluation(spark, tmp_path):
    """Two rooms divided by a wall, found by a segmenter that sees the free cells, and scored."""
    out = str(tmp_path)
    walls = [(0, r, c) for r in range(9) for c in range(17) if r in (0, 8) or c in (0, 8, 16)]
    save = lambda rows, schema, name: stages.save_table(spark.createDataFrame(rows, schema), out, stages.STAGES[0], name)
    save([(0, 0.0, 0.0, 1.0, 17, 9)], "scan_id int, a_min double, b_min double, pixel_size double, width long, height long", "transform")
    save(walls, "scan_id int, row long, col long", "occupancy")
    save(walls, "scan_id int, row long, col long", "wallness")
    save([(0, r, c) for r in range(9) for c in range(17)], "scan_id int, row long, col long", "coverage")

    class Halves:
        def generate(self, image):
            left = np.zeros(image.shape[:2], bool)
            left[1:8, 1:8] = True
            return [{"segmentation": left, "predicted_iou": 0.9}, {"segmentation": np.roll(left, 8, 1), "predicted_iou": 0.8}]

    config = Config(pixel_m=1.0, sam_image_mode="free", sam_min_mask_region_area=10)
    assert method_labels(spark, out) == {"Geometry": None, "SAM": None, "Geometry + SAM": None}
    assert automatic(spark, config, out, Halves()) is True
    assert stages.load_table(spark, out, stages.STAGES[5], "labels").where("label >= 1").groupBy("label").count().count() == 2
    inside = [(0, room, "floor", c + 0.5, 8 - r + 0.5, 0.0) for room, at in (("a", range(1, 8)), ("b", range(9, 16))) for r in range(1, 8) for c in at]
    annotations = spark.createDataFrame(inside, "scan_id int, room string, class string, x double, y double, z double")
    (score,) = evaluated(spark, config, out, annotations).collect()
    assert (score.method, score.n_gt, score.n_pred, score.tp) == ("SAM", 2, 2, 2) and math.isclose(score.mean_iou, 1.0) and math.isclose(score.pq, 1.0)
    with pytest.raises(Exception, match="outside the grid"):
        evaluated(spark, config, out, annotations.withColumn("x", annotations.x + 10)).collect()
    assert automatic(spark, config, out) is False
