"""The scan engine on hand-built grids and files, against brute force."""

import dataclasses
import heapq
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanloom.operators import building as B
from scanloom.operators import kernels as K
from scanloom.operators import metrics as M
from scanloom.operators import openings as O
from scanloom.operators import raster as R
from scanloom.operators import regions as G
from scanloom.operators import rooms as Q
from scanloom.operators import stencil as S
from scanloom.operators import walls as W
from scanloom.operators.sealing import bridge_segments, sealed
from scanloom.operators import backends
from scanloom.operators.segmenters import automatic_rooms, refine_rooms
from scanloom.plans import ifc
from scanloom.plans.catalog import QUERIES
from scanloom.plans.config import Config, check_upstream, flattened, load_config
from scanloom.sources import clouds, stages
from scanloom.sources.fixtures import fixture


def cells(spark, mask, name=None, values=None):
    r, c = np.nonzero(mask)
    pdf = pd.DataFrame({"scan_id": np.zeros(len(r), np.int32), "row": r, "col": c})
    if name:
        pdf[name] = np.asarray(values)[r, c].astype(np.int64)
    return spark.createDataFrame(pdf) if len(pdf) else spark.createDataFrame([], "scan_id int, row long, col long" + (f", {name} long" if name else ""))


def grid(spark, shape):
    return spark.createDataFrame([(0, shape[1], shape[0])], "scan_id int, width long, height long")


def as_mask(df, shape, value=None):
    out = np.zeros(shape, np.int64 if value else bool)
    for r in df.collect():
        out[r.row, r.col] = r[value] if value else True
    return out


def rand(seed, shape=(14, 17), p=0.25):
    return np.random.default_rng(seed).random(shape) < p


def test_morphology_matches_brute_force(spark):
    m = rand(1)
    df, g = cells(spark, m), grid(spark, m.shape)
    for radius in (1, 2, 3):
        k = S.disc(radius)
        at = lambda r, c: [(r + y, c + x) for y, x in k if 0 <= r + y < m.shape[0] and 0 <= c + x < m.shape[1]]  # noqa: E731, B023
        grown = np.array([[any(m[p] for p in at(r, c)) for c in range(m.shape[1])] for r in range(m.shape[0])])
        assert (as_mask(S.dilate(df, k, g), m.shape) == grown).all()
        full = ~rand(2, p=0.08)
        less = np.array([[all(full[p] for p in at(r, c)) for c in range(m.shape[1])] for r in range(m.shape[0])])
        assert (as_mask(S.erode(cells(spark, full), k, g), m.shape) == less).all()


def test_distance_components_and_holes(spark):
    m = rand(3, p=0.3)
    g, df = grid(spark, m.shape), cells(spark, m)
    wall = np.argwhere(m)
    want = np.array([[((wall - (r, c)) ** 2).sum(1).min() for c in range(m.shape[1])] for r in range(m.shape[0])])
    assert (as_mask(S.distance(df, g), m.shape, "d2") == want).all()
    label = as_mask(G.components(df), m.shape, "label")
    assert (label == K.component_labels(m)).all() and label.max() > 1
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[3:6, 3:6] = False
    inner = as_mask(G.interior(cells(spark, ring), grid(spark, ring.shape)), ring.shape)
    assert inner.sum() == 9 and inner[3:6, 3:6].all()
    assert R.covered_share(cells(spark, inner), cells(spark, inner)).first().frac == 1.0


def test_flood_takes_the_lowest_path():
    cost = np.random.default_rng(4).integers(0, 9, (8, 9)).astype(float)
    seeds = np.zeros((8, 9), int)
    seeds[0, 0], seeds[7, 8] = 1, 2
    got = K.flood(cost, seeds, np.ones((8, 9), bool))

    def pass_cost(start):  # least possible highest cost on the way
        best, heap = {start: cost[start]}, [(cost[start], start)]
        while heap:
            d, (r, c) = heapq.heappop(heap)
            for y, x in K.FOUR:
                p = (r + y, c + x)
                if 0 <= p[0] < 8 and 0 <= p[1] < 9 and max(d, cost[p]) < best.get(p, math.inf):
                    best[p] = max(d, cost[p])
                    heapq.heappush(heap, (best[p], p))
        return best

    a, b = pass_cost((0, 0)), pass_cost((7, 8))
    assert all(got[p] == (1 if a[p] < b[p] else 2) for p in a if a[p] != b[p])
    assert not K.thinned(np.ones((5, 9), bool))[0].any() and K.thinned(np.ones((5, 9), bool)).any()


def two_rooms(door=0):
    m = np.zeros((24, 48), bool)
    m[[0, -1]] = m[:, [0, -1]] = m[:, 24] = True
    if door:
        m[12 - door // 2 : 12 - door // 2 + door, 24] = False
    return m


def test_watershed_rooms(spark):
    config = Config(pixel_m=0.1, min_wall_area_px=20)
    m = two_rooms()
    labels = G.watershed_rooms(cells(spark, m), grid(spark, m.shape), config)
    got = as_mask(labels, m.shape, "label")
    assert sorted(np.unique(got)) == [-1, 1, 2] and ((got == -1) == m).all()
    assert (got[1:-1, 1:24] == got[1, 1]).all() and (got[1:-1, 25:-1] == got[1, 30]).all()
    left = np.zeros_like(m)
    left[:, :24] = True
    half = as_mask(G.watershed_rooms(cells(spark, m), grid(spark, m.shape), config, cells(spark, left)), m.shape, "label")
    assert set(np.unique(half[1:-1, 25:-1])) == {0} and set(np.unique(half[1:-1, 1:24])) == {1}


def test_label_points_bounds(spark):
    t = spark.createDataFrame([(0, 0.0, 0.0, 0.1, 10, 10)], "scan_id int, a_min double, b_min double, pixel_size double, width long, height long")
    pts = spark.createDataFrame([(0, 0.05, 0.05, 0.0), (0, -0.05, 0.05, 0.0), (0, 1.5, 0.5, 0.0)], "scan_id int, x double, y double, z double")
    labels = spark.createDataFrame([(0, 9, 0, 7)], "scan_id int, row long, col long, label int")
    assert sorted((r.x, r.label) for r in R.label_points(pts, labels, t).collect()) == [(-0.05, 7), (0.05, 7), (1.5, -2)]
    with pytest.raises(Exception, match="outside the grid"):
        R.check_in_grid(pts.where("x > 1"), t).collect()


def test_room_scores(spark):
    gt = np.ones((10, 10), int)
    gt[:, 5:] = 2
    split = gt.copy()
    split[:5, :5] = 3
    both = lambda pred: spark.createDataFrame([(0, r, c, int(pred[r, c]), int(gt[r, c])) for r in range(10) for c in range(10)], "scan_id int, row long, col long, pred int, gt int")
    perfect = M.room_scores(both(gt)).first()
    assert (perfect.mean_iou, perfect.over_seg, perfect.under_seg) == (1.0, 0, 0)
    s = M.room_scores(both(split)).first()
    assert (s.over_seg, s.under_seg, s.mean_iou) == (1, 0, 0.75)
    u = M.room_scores(both(np.ones((10, 10), int))).first()
    assert (u.under_seg, u.mean_iou) == (1, 0.5)
    assert M.room_scores(both(np.zeros((10, 10), int))).first().mean_iou == 0.0
    assert M.panoptic(both(gt)).first().pq == 1.0


class Fake:
    def __init__(self, masks):
        self.masks = masks

    def generate(self, image):
        return [{"segmentation": m, "predicted_iou": s} for m, s in self.masks]


def test_automatic_rooms(spark):
    m = np.zeros((30, 60), bool)
    m[:, 30] = True
    a, b, tiny = np.zeros_like(m), np.zeros_like(m), np.zeros_like(m)
    a[2:28, 2:40], b[2:28, 20:58], tiny[0, :5] = True, True, True
    config = Config(pixel_m=0.1, sam_min_mask_region_area=50)
    walls, free, g = cells(spark, m), cells(spark, ~m), grid(spark, m.shape)
    image = free.withColumn("rgb", F.array(F.lit(255), F.lit(255), F.lit(255)))
    for order in ([(a, 0.9), (b, 0.95), (tiny, 0.99)], [(tiny, 0.99), (b, 0.95), (a, 0.9)]):
        labels, ran = automatic_rooms(image, free, walls, None, g, config, Fake(order))
        got = as_mask(labels, m.shape, "label")
        assert ran and (got[b & ~m] == 2).all() and (got[a & ~b & ~m] == 1).all() and (got[m] == -1).all() and got[0, 0] == 0
    labels, ran = automatic_rooms(image, free, walls, None, g, config)
    assert not ran and set(np.unique(as_mask(labels, m.shape, "label"))) == {0, -1}
    with pytest.raises(ValueError):
        backends.prompted(dataclasses.replace(config, sam_backend="other"))


def test_relabel_by_masks_merges_open_rooms_only(spark):
    config = Config(pixel_m=0.1)
    for door, merged in ((20, True), (0, False)):
        m = two_rooms(door)
        rooms = np.where(m, -1, np.where(np.arange(48) < 24, 1, 2)[None, :])
        free = ~m
        labels = cells(spark, np.ones_like(m), "label", rooms)
        dt = S.distance(cells(spark, m), grid(spark, m.shape))
        masks = cells(spark, free).withColumn("room_id", F.lit(1).cast("long"))
        for score, want in ((0.95, 1 if merged else 2), (0.5, 2)):
            scores = spark.createDataFrame([(0, 1, score)], "scan_id int, room_id long, score double")
            got = as_mask(Q.relabel_by_masks(labels, cells(spark, m), dt, grid(spark, m.shape), masks, scores, config), m.shape, "label")
            assert got.max() == want and ((got == -1) == m).all(), (door, score)
        assert refine_rooms(labels, None, None, None, None, config) is labels


def test_walls_from_points(spark):
    rng = np.random.default_rng(0)
    n = 700
    pts = np.concatenate([np.c_[rng.uniform(0, 4, n), np.zeros(n), rng.uniform(0, 2.5, n)], np.c_[np.zeros(n), rng.uniform(0, 3, n), rng.uniform(0, 2.5, n)]])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=list("xyz")).assign(scan_id=np.int32(0), room_id=1, pid=range(2 * n)))
    config = Config(normal_radius_m=0.35, min_wall_points=200)
    seg = W.wall_segments(df, config)
    g = B.wall_geometry(seg).orderBy("wall_id").collect()
    assert len(g) == 2 and sorted(round(r.length) for r in g) == [3, 4] and all(r.thickness < 0.2 and r.fill_ratio > 0.4 for r in g)
    planes = W.ransac_planes(df, ["scan_id", "room_id"], Config(ransac_min_inliers=300)).collect()
    assert len(planes) == 2


def test_knn_means_equal_all_pairs():
    rng = np.random.default_rng(3)
    wall = np.c_[rng.uniform(0, 8, 3000), np.zeros(3000), rng.uniform(0, 2.5, 3000)]
    clumps = np.repeat(rng.uniform(0, 1, (30, 3)), 30, axis=0)
    for xyz in (wall, np.concatenate([wall, [[50, 9, 3], [20, 0, 0]]]), rng.normal(0, 1, (1500, 3)), clumps, np.zeros((40, 3)), np.c_[np.arange(200.0), np.zeros((200, 2))], rng.uniform(0, 1, (21, 3)), 1e4 + wall):
        d = np.sort(np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2)), axis=1)[:, :20].mean(1)
        assert np.allclose(W.knn_means(xyz, 20), d, rtol=1e-12, atol=1e-12)


def test_voids_and_openings(spark):
    m = np.ones((63, 100), bool)
    m[8:, 30:55] = False  # a door of 1 m by 2.2 m
    m[15:40, 70:95] = False  # a window
    g = spark.createDataFrame([(0, 100, 63)], "scan_id int, width long, height long")
    found = O.merged(O.voids(cells(spark, m), g, min_px=40), ["scan_id"], 3).withColumn("img_h", F.lit(63))
    got = {r.label: (r.bx, r.byy, r.w, r.h) for r in O.classified(found, Config()).collect()}
    assert got == {"door": (30, 8, 25, 55), "window": (70, 15, 25, 25)}


def test_building_to_ifc(spark):
    rows = [(0, 1, 1, 0.0, 0.0, 4.0, 0.0), (0, 1, 2, 4.0, 0.05, 4.0, 3.0), (0, 1, 3, 4.0, 3.0, 0.0, 3.0), (0, 1, 4, 0.0, 3.0, 0.0, 0.0), (0, 2, 5, 4.1, 0.0, 4.1, 3.0), (0, 2, 6, 4.1, 0.0, 8.0, 0.0)]
    w = spark.createDataFrame(rows, "scan_id int, room_id long, wall_id long, sx double, sy double, ex double, ey double")
    n = F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))
    across = F.abs(F.col("ex") - F.col("sx")) > F.abs(F.col("ey") - F.col("sy"))
    w = w.withColumns({"length": n, "angle": F.when(across, F.lit(math.pi / 2)).otherwise(F.lit(0.0)), "offs": F.when(across, F.col("sy")).otherwise(F.col("sx")), "height": F.lit(2.5), "thickness": F.lit(0.1)})
    unique = B.deduplicated(w, Config())
    assert sorted((r.wall_id, tuple(r.rooms)) for r in unique.where("size(rooms) > 1").collect()) == [(1, (1, 2)), (5, (1, 2))] or unique.count() < 6
    doors = spark.createDataFrame([(0, 3, 2.0, 3.0, 0.9, 2.1), (0, 3, 2.0, 3.0, 9.0, 2.1)], "scan_id int, wall_id long, x double, y double, width double, height double")
    doc = B.document(unique, doors, w, Config())
    d = doc.first().asDict(True)
    assert len(d["doors"]) == 1 and len(d["rooms"]) == 2 and all(x["height"] == 2.5 for x in d["walls"])
    model = ifc.entities(doc, Config()).toPandas()
    count = model["ifc_class"].value_counts()
    assert count["IFCWALL"] == len(d["walls"]) and count["IFCDOOR"] == 1 and count["IFCSPACE"] == 2 and count["IFCSLAB"] == 2
    text = ifc.step_text(list(model[["entity", "ifc_class", "args"]].itertuples(index=False, name=None)))
    defined = {line.split("=")[0] for line in text.splitlines() if line.startswith("#")}
    import re

    assert set(re.findall(r"#\d+", text)) == defined


def test_snap_ends_meets_corners_and_tees():
    w = B.snap_ends(np.array([[0, 0, 4, 0], [4.1, 0, 4.1, 3], [2, 0.1, 2, 3]], float), 0.15)
    assert np.allclose(w[0, 2:], w[1, :2]) and np.allclose(w[2, :2], [2, 0], atol=1e-2)


def snapped_by_all_pairs(walls, tol, rounds=3):
    w = np.array(walls, float).reshape(-1, 2, 2)
    for _ in range(rounds):
        for i in range(len(w)):
            for end in (0, 1):
                p, best, move = w[i, end].copy(), tol, None
                for j in (j for j in range(len(w)) if j != i):
                    run = w[j, 1] - w[j, 0]
                    size = float(np.hypot(*run))
                    t = float((p - w[j, 0]) @ run) / size**2 if size >= 0.01 else 0
                    ways = [(w[j, other], ((p + w[j, other]) / 2, other)) for other in (0, 1)] + ([(w[j, 0] + t * run, (w[j, 0] + t * run, None))] if 0.01 <= t <= 0.99 else [])
                    for at, to in ways:
                        d = float(np.hypot(*(p - at)))
                        if 0 < d < best:
                            best, move = d, (j, *to)
                if move:
                    w[i, end] = move[1]
                    if move[2] is not None:
                        w[move[0], move[2]] = move[1]
    return w.reshape(-1, 4)


def test_endpoint_snap_takes_all_walls(spark, tmp_path):
    spark.range(1, 251).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.wall_id: (r.sx, r.sy, r.ex, r.ey) for r in QUERIES["endpoint_snap"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(1, 251))
    walls = [(r.sx, r.sy, r.ex, r.ey) for r in fixture(spark, str(tmp_path), "fx_walls").orderBy("wall_id").collect()]
    assert np.array_equal(np.array([got[k] for k in sorted(got)]), snapped_by_all_pairs(walls, Config().ifc_snap_tolerance_m))


def test_bridges_connect_facing_ends_once(spark):
    m = np.zeros((12, 40), bool)
    m[5, 2:15] = m[5, 21:36] = True  # a gap of six cells
    m[9:12, 18] = True  # a third end off the line
    got = bridge_segments(cells(spark, m)).collect()
    assert [(r.r0, r.c0, r.r1, r.c1) for r in got] == [(5, 14, 5, 21)]
    full = as_mask(sealed(cells(spark, m), bridge_segments(cells(spark, m)), grid(spark, m.shape)), m.shape)
    assert full[5, 2:36].all() and (full | m == full).all() and full.sum() == m.sum() + 6


def test_peaks():
    s = np.zeros(180)
    s[[10, 20, 100, 178]] = [5, 9, 4, 8]
    assert W.pick_peaks(s) == [20, 100, 178]


def test_config_layers(tmp_path):
    (tmp_path / "pyproject.toml").write_text("")
    (tmp_path / "params.yaml").write_text("raster:\n  pixel_m: 0.05\ninput:\n  file_path: a/b.xyz\n")
    c = load_config(start=str(tmp_path), voxel_m=0.1)
    assert (c.pixel_m, c.voxel_m, c.file_path) == (0.05, 0.1, str(tmp_path / "a/b.xyz"))
    with pytest.raises(KeyError):
        flattened({"raster": {"no_such": 1}})
    assert Config.from_dict({**c.to_dict(), "other": 1}) == c
    check_upstream(c, {**c.to_dict(), "file_path": "elsewhere\\b.xyz"})
    with pytest.raises(ValueError, match="pixel_m"):
        check_upstream(c, {**c.to_dict(), "pixel_m": 0.2})


def test_files(spark, tmp_path):
    pts = pd.DataFrame({"x": [1.0, 2.5], "y": [0.5, -1.0], "z": [0.0, 3.0]})
    (tmp_path / "a.ply").write_bytes(clouds.format_ply(pts))
    (tmp_path / "a.xyz").write_text("1.0 0.5 0 9 9\n2.5\x10 -1 3 7 7\nbad\n")
    for df in (clouds.read_ply(spark, f"{tmp_path}/a.ply"), clouds.read_xyz(spark, f"{tmp_path}/a.xyz")):
        assert sorted(map(tuple, df.select("x", "y", "z").collect())) == [(1.0, 0.5, 0.0), (2.5, -1.0, 3.0)]
    room = tmp_path / "s" / "office_1" / "Annotations"
    room.mkdir(parents=True)
    (room / "floor_1.txt").write_text("0 0 0 1 2 3\n")
    (room / "wall_2.txt").write_text("1 1 1 1 2 3\n")
    got = clouds.read_rooms(spark, f"{tmp_path}/s", clouds.NOT_INTERIOR).collect()
    assert [(r.room, r["class"], r.x) for r in got] == [("office_1", "floor", 0.0)]
    image = np.random.default_rng(0).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (clouds.parse_png(clouds.png_bytes(image)) == image).all()
    stages.save_config(str(tmp_path), "stage_ifc", Config())
    stages.package_stage(str(tmp_path), "stage_ifc")
    import shutil

    shutil.rmtree(tmp_path / "stage_ifc")
    assert stages.stage_config(str(tmp_path), "stage_ifc")["pixel_m"] == 0.03
    with pytest.raises(FileNotFoundError):
        stages.find_stage(str(tmp_path), "none")
