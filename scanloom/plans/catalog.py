"""Registered queries: one per operator of the scan engine, over the fixture relations, each with its SQL.

A query takes (spark, sf_dir) and returns a DataFrame. Doubles that depend on the order of a sum are rounded in both.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import annotation_class
from ..operators import building as B
from ..operators import enrich as E
from ..operators import metrics as M
from ..operators import openings as O
from ..operators import points as P
from ..operators import raster as R
from ..operators import regions as G
from ..operators import rooms as Q
from ..operators import sealing as L
from ..operators import stencil as S
from ..operators import views as V
from ..operators import walls as W
from ..sources.fixtures import fixture, with_fixtures
from .config import Config

#: Pixel and band of the fixture scan.
CFG = Config(pixel_m=0.1, min_points_per_cell=1, ceiling_mode="global", slab_lo_m=0.125, slab_hi_m=0.5, min_wall_area_px=60, min_wall_points=30, offset_tol_m=0.2, sam_min_mask_region_area=60)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_fixtures(_expand(sql))
        return f

    return add


# ---- shared parts ---------------------------------------------------------------------------------------------------


def _points(spark, d):
    return fixture(spark, d, "fx_points")


def _slab(spark, d):
    return P.crop_slab(_points(spark, d), CFG)


def _walls(spark, d):
    """(wall cells, transform) of the slab."""
    slab = _slab(spark, d)
    grid = R.grid_of(slab, CFG.pixel_m)
    return R.occupancy(slab, grid).select("scan_id", "row", "col"), grid


def _labels(spark, d, column: str = "gt"):
    return fixture(spark, d, "fx_labels").select("scan_id", "row", "col", F.col(column).cast("long").alias("label"))


def _label_grid(spark, d):
    return _labels(spark, d).groupBy("scan_id").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"))


def _pred_walls(spark, d):
    return _labels(spark, d, "pred").where("label = -1").select("scan_id", "row", "col")


def _faces(spark, d):
    w = fixture(spark, d, "fx_walls")
    return w.select("scan_id", F.col("room_id").cast("long").alias("room_id"), F.col("wall_id").cast("long").alias("wall_id"), "sx", "sy", "ex", "ey", "angle", "length", "offs", "height", "thickness", F.lit(0.0).alias("floor_z"), F.when(F.col("axis") == 0, -F.col("ex")).otherwise(F.col("sy")).alias("u_min"), F.when(F.col("axis") == 0, -F.col("sx")).otherwise(F.col("ey")).alias("u_max"), F.lit(1.0).alias("fill_ratio"), (F.col("wall_id") % 9 == 0).alias("is_exterior"))


def _theta(spark, d):
    """Wall points of two 'rooms' with the direction of their surface's normal, slightly spread."""
    p = _points(spark, d).where("surf >= 2")
    base = F.when(F.col("surf") <= 3, F.lit(math.pi / 2)).otherwise(F.lit(0.0))
    spread = F.pmod(F.floor(F.col("z") * 1000), F.lit(7)) * 0.01
    return p.select("scan_id", F.lit(1).cast("long").alias("room_id"), "x", "y", "z", (base + spread).alias("theta"))


def _masks(spark, d):
    m = fixture(spark, d, "fx_masks")
    row = F.explode(F.sequence(F.col("r0"), F.col("r0") + F.col("h") - 1)).alias("row")
    cells = m.select(F.lit(0).alias("scan_id"), "mask_id", "c0", "w", row).select("scan_id", "mask_id", "row", F.explode(F.sequence(F.col("c0"), F.col("c0") + F.col("w") - 1)).alias("col"))
    return cells, m.select(F.lit(0).alias("scan_id"), "mask_id", "score")


def _room_points(spark, d):
    """Wall points of the fixture as one room's cloud with ids."""
    p = _points(spark, d).where("surf >= 2")
    pid = F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("scan_id").orderBy("surf", "x", "y", "z"))
    return p.select("scan_id", F.lit(1).cast("long").alias("room_id"), pid.cast("long").alias("pid"), "x", "y", "z")


def _offsets(offsets) -> str:
    return "(VALUES " + ", ".join(f"({dy},{dx})" for dy, dx in offsets) + ")"


_PART = {
    "e": "e AS (SELECT min(z) AS a, max(z) AS b FROM fx_points)",
    "h": "h AS (SELECT CAST(least(floor((z - a) / ((b - a) / 256)), 255) AS INTEGER) AS bin, count(*) AS n FROM fx_points, e GROUP BY 1)",
    "fc": "fc AS (SELECT min(a + (bin + 0.5::DOUBLE) * ((b - a) / 256)) AS floor_h, max(a + (bin + 0.5::DOUBLE) * ((b - a) / 256)) AS ceiling_h FROM h, e WHERE n >= 0.02 * (SELECT max(n) FROM h))",
    "slab": "slab AS (SELECT p.* FROM fx_points p, fc WHERE z BETWEEN ceiling_h - 0.5::DOUBLE AND ceiling_h - 0.125::DOUBLE)",
    "tr": "tr AS (SELECT min(x) AS a_min, min(y) AS b_min, CAST(trunc((max(x) - min(x)) / 0.1::DOUBLE) AS BIGINT) + 1 AS width, CAST(trunc((max(y) - min(y)) / 0.1::DOUBLE) AS BIGINT) + 1 AS height FROM slab)",
    "px": "px AS (SELECT p.*, CAST(trunc((x - a_min) / 0.1::DOUBLE) AS BIGINT) AS col, height - 1 - CAST(trunc((y - b_min) / 0.1::DOUBLE) AS BIGINT) AS row, width, height FROM fx_points p, tr)",
    "inb": "inb AS (SELECT * FROM px WHERE col BETWEEN 0 AND width - 1 AND row BETWEEN 0 AND height - 1)",
    "wc": "wc AS (SELECT height - 1 - CAST(trunc((y - b_min) / 0.1::DOUBLE) AS BIGINT) AS row, CAST(trunc((x - a_min) / 0.1::DOUBLE) AS BIGINT) AS col, count(*) AS n FROM slab, tr GROUP BY 1, 2)",
    "free": "free AS (SELECT r.v AS row, c.v AS col FROM tr, unnest(range(height)) r(v), unnest(range(width)) c(v) WHERE NOT EXISTS (SELECT 1 FROM wc WHERE wc.row = r.v AND wc.col = c.v))",
    "lg": "lg AS (SELECT max(col) + 1 AS width, max(row) + 1 AS height FROM fx_labels)",
    "ov": "ov AS (SELECT p.pred, p.gt, p.n, a.n AS pa, b.n AS ga, CAST(p.n AS DOUBLE) / (a.n + b.n - p.n) AS iou, CAST(p.n AS DOUBLE) / a.n AS p, CAST(p.n AS DOUBLE) / b.n AS g FROM (SELECT pred, gt, count(*) AS n FROM fx_labels WHERE pred >= 1 AND gt >= 1 GROUP BY 1, 2) p JOIN (SELECT pred, count(*) AS n FROM fx_labels GROUP BY 1) a USING (pred) JOIN (SELECT gt, count(*) AS n FROM fx_labels GROUP BY 1) b USING (gt))",
    "best": "best AS (SELECT gt, pred, iou FROM (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY iou DESC, pred) AS r FROM ov) t WHERE r = 1)",
    "th": "th AS (SELECT CASE WHEN surf <= 3 THEN 1.5707963267948966::DOUBLE ELSE 0.0::DOUBLE END + (CAST(floor(z * 1000) AS BIGINT) % 7) * 0.01::DOUBLE AS theta, x, y, z, surf FROM fx_points WHERE surf >= 2)",
    "mc": "mc AS (SELECT mask_id, score, r.v AS row, c.v AS col FROM fx_masks, unnest(range(r0, r0 + h)) r(v), unnest(range(c0, c0 + w)) c(v))",
}
_NEEDS = {"h": ["e"], "fc": ["e", "h"], "slab": ["e", "h", "fc"], "tr": ["slab"], "px": ["tr"], "inb": ["px"], "wc": ["tr"], "free": ["wc"], "best": ["ov"]}


def _expand(sql: str) -> str:
    """Put the parts named in '[a b] SELECT ...' in front as common table expressions, needed ones first."""
    sql = " ".join(sql.split())
    if not sql.startswith("["):
        return sql
    names, _, body = sql[1:].partition("] ")
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if body.upper().startswith("WITH "):
        return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join([*[_PART[n] for n in order], body[15 if recursive else 5 :]])
    return "WITH " + ", ".join(_PART[n] for n in order) + " " + body


def _hit(cells: str, offsets, keys: str = "") -> str:
    """Cells reached from `cells` by the offsets, within the grid tr."""
    k = keys + ", " if keys else ""
    return f"SELECT {k}c.row + o.dy AS row, c.col + o.dx AS col FROM {cells} c, {_offsets(offsets)} o(dy, dx), tr WHERE c.row + o.dy BETWEEN 0 AND height - 1 AND c.col + o.dx BETWEEN 0 AND width - 1"


def _eroded(cells: str, offsets) -> str:
    o = _offsets(offsets)
    return f"""SELECT t.row, t.col FROM ({_hit(cells, [(-a, -b) for a, b in offsets])}) t, tr GROUP BY t.row, t.col, width, height
      HAVING count(*) = (SELECT count(*) FROM {o} q(dy, dx) WHERE t.row + q.dy BETWEEN 0 AND height - 1 AND t.col + q.dx BETWEEN 0 AND width - 1)"""


# ---- points ---------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT x / 2 AS x, y / 2 AS y, z / 2 AS z FROM fx_points), m AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM s)
  SELECT CAST(floor((x - (x0 - 0.125::DOUBLE)) / 0.25::DOUBLE) AS BIGINT) AS vx, CAST(floor((y - (y0 - 0.125::DOUBLE)) / 0.25::DOUBLE) AS BIGINT) AS vy, CAST(floor((z - (z0 - 0.125::DOUBLE)) / 0.25::DOUBLE) AS BIGINT) AS vz,
    round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z FROM s, m GROUP BY 1, 2, 3""")
def points_scale_voxel(spark, d):
    return P.voxel_means(P.scaled(_points(spark, d), 2.0), 0.25).select("vx", "vy", "vz", *[F.round(c, 9).alias(c) for c in "xyz"])


@query("[h] SELECT bin, n FROM h")
def height_histogram(spark, d):
    return P.height_histogram(_points(spark, d), ["scan_id"]).select("bin", "n")


@query("[fc] SELECT 0 AS scan_id, floor_h, ceiling_h FROM fc")
def floor_ceiling(spark, d):
    return P.floor_ceiling(_points(spark, d))


_LOCAL = """[fc] WITH l AS (SELECT p.*, CAST(floor(x - (SELECT min(x) FROM fx_points)) AS BIGINT) AS ca, CAST(floor(y - (SELECT min(y) FROM fx_points)) AS BIGINT) AS cb FROM fx_points p),
  m AS (SELECT ca, cb, CASE WHEN min(z) = max(z) THEN min(z) - 0.5 ELSE min(z) END AS a, (CASE WHEN min(z) = max(z) THEN 1.0::DOUBLE ELSE max(z) - min(z) END) / 256 AS w FROM l GROUP BY 1, 2 HAVING count(*) >= 20),
  q AS (SELECT l.ca, l.cb, a, w, CAST(least(floor((z - a) / w), 255) AS INTEGER) AS bin, count(*) AS n FROM l JOIN m USING (ca, cb) GROUP BY 1, 2, 3, 4, 5),
  o AS (SELECT ca, cb, max(a + (bin + 0.5::DOUBLE) * w) AS own FROM (SELECT *, max(n) OVER (PARTITION BY ca, cb) AS top FROM q) t WHERE n >= 0.02 * top GROUP BY 1, 2),
  f AS (SELECT l.*, coalesce(own, (SELECT ceiling_h FROM fc)) AS local FROM l LEFT JOIN o USING (ca, cb))"""


@query(_LOCAL + " SELECT x, y, z, local FROM f")
def local_ceiling(spark, d):
    return P.local_ceiling(_points(spark, d), cell=1.0, min_pts=20).select("x", "y", "z", "local")


@query("SELECT x, y, z FROM fx_points WHERE z BETWEEN 1.0 AND 1.5")
def slab_absolute(spark, d):
    return P.crop_slab(_points(spark, d), Config(slab_relative_to="absolute", slab_lo_m=1.0, slab_hi_m=1.5)).select("x", "y", "z")


@query("[fc] SELECT x, y, z FROM fx_points, fc WHERE z BETWEEN floor_h + 0.125::DOUBLE AND floor_h + 0.5::DOUBLE")
def slab_floor(spark, d):
    return P.crop_slab(_points(spark, d), Config(slab_relative_to="floor")).select("x", "y", "z")


@query("[slab] SELECT x, y, z FROM slab")
def slab_ceiling_global(spark, d):
    return _slab(spark, d).select("x", "y", "z")


@query(_LOCAL + " SELECT x, y, z FROM f WHERE z BETWEEN local - 0.5::DOUBLE AND local - 0.125::DOUBLE")
def slab_ceiling_local(spark, d):
    return P.crop_slab(_points(spark, d), Config(ceiling_mode="local_perpoint", ceiling_cell_size_m=1.0, ceiling_min_pts_per_cell=20)).select("x", "y", "z")


@query("[fc] SELECT x, y, z FROM fx_points, fc WHERE z BETWEEN floor_h + 0.1::DOUBLE AND ceiling_h - 0.1::DOUBLE")
def height_band(spark, d):
    return P.height_band(_points(spark, d), CFG).select("x", "y", "z")


# ---- rasters --------------------------------------------------------------------------------------------------------


@query("[wc] SELECT 0 AS scan_id, row, col, n FROM wc")
def occupancy(spark, d):
    slab = _slab(spark, d)
    return R.occupancy(slab, R.grid_of(slab, 0.1), min_points=1)


@query("[wc] SELECT DISTINCT 0 AS scan_id, row, col FROM (" + _hit("wc", S.CROSS) + ") t")
def occupancy_thick(spark, d):
    cells, grid = _walls(spark, d)
    return S.thicken(cells, 1, grid)


@query("[inb fc] SELECT 0 AS scan_id, row, col, max(z) - min(z) AS span FROM inb, fc GROUP BY row, col, ceiling_h, floor_h HAVING max(z) - min(z) >= 0.5 * (ceiling_h - floor_h)")
def wallness(spark, d):
    return R.wallness(_points(spark, d), _walls(spark, d)[1], CFG)


_COVER = "cv AS (SELECT row, col, count(*) AS n FROM inb, fc WHERE z BETWEEN floor_h - 0.2::DOUBLE AND ceiling_h - 0.3::DOUBLE GROUP BY 1, 2)"


@query("[inb fc] WITH " + _COVER + " SELECT 0 AS scan_id, row, col, n FROM cv")
def coverage(spark, d):
    return R.coverage(_points(spark, d), _walls(spark, d)[1], CFG)


@query("[inb fc] WITH " + _COVER + ", di AS (SELECT DISTINCT row, col FROM (" + _hit("cv", S.disc(2)) + ") t) SELECT 0 AS scan_id, row, col FROM (" + _eroded("di", S.disc(2)) + ") z")
def coverage_closed(spark, d):
    grid = _walls(spark, d)[1]
    return S.closed(R.coverage(_points(spark, d), grid, CFG), S.disc(CFG.coverage_close_px), grid)


@query("[px] SELECT x, y, z, row, col, col BETWEEN 0 AND width - 1 AND row BETWEEN 0 AND height - 1 AS in_bounds FROM px")
def point_cells(spark, d):
    return R.cells(_points(spark, d), _walls(spark, d)[1]).select("x", "y", "z", "row", "col", "in_bounds")


@query("[px] SELECT x, y, z, CASE WHEN NOT (px.col BETWEEN 0 AND width - 1 AND px.row BETWEEN 0 AND height - 1) THEN -2 ELSE coalesce(l.gt, 0) END AS label FROM px LEFT JOIN fx_labels l ON l.row = px.row AND l.col = px.col")
def label_points(spark, d):
    return R.label_points(_points(spark, d), _labels(spark, d), _walls(spark, d)[1]).select("x", "y", "z", F.col("label").cast("int").alias("label"))


@query("[tr] SELECT 0 AS scan_id, a_min, b_min, a_min + width * 0.1::DOUBLE AS a_max, b_min + height * 0.1::DOUBLE AS b_max FROM tr")
def grid_bbox(spark, d):
    return R.world_box(_walls(spark, d)[1])


@query("[px] SELECT round(avg(CASE WHEN col BETWEEN 0 AND width - 1 AND row BETWEEN 0 AND height - 1 THEN 1.0 ELSE 0.0 END), 9) AS frac FROM px")
def ingrid_fraction(spark, d):
    return R.check_in_grid(_points(spark, d), _walls(spark, d)[1]).select(F.round("frac", 9).alias("frac"))


#: Components: every cell takes its neighbours' least root until none changes; keyed recursion keeps one row per cell.
_REACH = """comp(row, col, root) USING KEY (row, col) AS (SELECT row, col, row * 1000000 + col FROM (SELECT DISTINCT row, col FROM {0}) t
  UNION SELECT n.row, n.col, min(r.root) FROM comp r CROSS JOIN {1} s(dr, dc) JOIN recurring.comp n ON n.row = r.row + s.dr AND n.col = r.col + s.dc WHERE r.root < n.root GROUP BY n.row, n.col)"""
_N4, _N8 = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0))", "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1))"
_OUTSIDE = "air AS (SELECT DISTINCT root FROM comp, tr WHERE row = 0 OR col = 0 OR row = height - 1 OR col = width - 1)"


@query("[free] WITH RECURSIVE " + _REACH.format("free", _N4) + ", " + _OUTSIDE + ", inn AS (SELECT row, col FROM comp WHERE root NOT IN (SELECT root FROM air)) SELECT count(*) AS interior_cells, round(coalesce(avg(CASE WHEN row % 2 = 0 THEN 1.0 ELSE 0.0 END), 0), 9) AS frac FROM inn")
def interior_coverage(spark, d):
    cells, grid = _walls(spark, d)
    inner = G.interior(cells, grid)
    share = R.covered_share(inner, inner.where("row % 2 = 0"))
    return inner.agg(F.count("*").alias("interior_cells")).crossJoin(F.broadcast(share.agg(F.round(F.coalesce(F.max("frac"), F.lit(0.0)), 9).alias("frac"))))


# ---- stencils -------------------------------------------------------------------------------------------------------


@query("[wc] SELECT DISTINCT 0 AS scan_id, row, col FROM (" + _hit("wc", S.disc(2)) + ") t")
def dilate_ellipse(spark, d):
    cells, grid = _walls(spark, d)
    return S.dilate(cells, S.disc(2), grid)


@query("[free] SELECT 0 AS scan_id, row, col FROM (" + _eroded("free", S.disc(2)) + ") z")
def erode_ellipse(spark, d):
    cells, grid = _walls(spark, d)
    return S.erode(S.free_cells(cells, grid), S.disc(2), grid)


@query("[wc] WITH a AS (SELECT DISTINCT row, col FROM (" + _hit("wc", S.disc(3)) + ") t), b AS (" + _eroded("a", S.disc(3)) + "), c AS (" + _eroded("b", S.disc(1)) + ") SELECT DISTINCT 0 AS scan_id, row, col FROM (" + _hit("c", S.disc(1)) + ") t")
def open_close(spark, d):
    cells, grid = _walls(spark, d)
    return S.opened(S.closed(cells, S.disc(3), grid), S.disc(1), grid)


@query("[wc] SELECT 0 AS scan_id, row, col FROM wc w WHERE (SELECT count(*) FROM wc v WHERE abs(v.row - w.row) <= 1 AND abs(v.col - w.col) <= 1) >= 3")
def density_filter(spark, d):
    return S.dense_only(_walls(spark, d)[0], 1, 3)


@query("[free] SELECT 0 AS scan_id, f.row, f.col, min((f.row - w.row) * (f.row - w.row) + (f.col - w.col) * (f.col - w.col)) AS d2 FROM free f, wc w GROUP BY f.row, f.col")
def distance_transform(spark, d):
    cells, grid = _walls(spark, d)
    return S.distance(cells, grid)


@query("[free] WITH t AS (SELECT w.row, w.col, min((f.row - w.row) * (f.row - w.row) + (f.col - w.col) * (f.col - w.col)) AS d2 FROM free f, wc w GROUP BY w.row, w.col) SELECT 0 AS scan_id, CAST(greatest(round_even(2 * quantile_cont(sqrt(d2), 0.5), 0), 1) AS INTEGER) AS px FROM t")
def wall_thickness(spark, d):
    cells, grid = _walls(spark, d)
    return S.wall_thickness(cells, grid)


# ---- regions --------------------------------------------------------------------------------------------------------


@query("[wc] WITH RECURSIVE " + _REACH.format("wc", _N8) + " SELECT 0 AS scan_id, row, col, dense_rank() OVER (ORDER BY root) AS label FROM comp")
def components(spark, d):
    return G.components(_walls(spark, d)[0])


@query("[wc] WITH RECURSIVE " + _REACH.format("wc", _N8) + f" SELECT 0 AS scan_id, row, col FROM (SELECT *, count(*) OVER (PARTITION BY root) AS n FROM comp) t WHERE n >= {CFG.min_wall_area_px}")
def clean_walls(spark, d):
    return G.clean_walls(_walls(spark, d)[0], CFG.min_wall_area_px)


@query("[free wc] WITH RECURSIVE " + _REACH.format("free", _N4) + ", " + _OUTSIDE + " SELECT 0 AS scan_id, row, col FROM comp WHERE root NOT IN (SELECT root FROM air) UNION SELECT 0, row, col FROM wc")
def fill_holes(spark, d):
    cells, grid = _walls(spark, d)
    return G.filled(cells, grid)


_WIDE = "o AS (SELECT DISTINCT row, col FROM (" + _hit("wc", S.disc(5)) + ") t), bare AS (SELECT r.v AS row, c.v AS col FROM tr, unnest(range(height)) r(v), unnest(range(width)) c(v) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.row = r.v AND o.col = c.v))"


@query("[wc] WITH RECURSIVE " + _WIDE + ", " + _REACH.format("bare", _N4) + ", " + _OUTSIDE + ", whole AS (SELECT row, col FROM comp WHERE root NOT IN (SELECT root FROM air) UNION SELECT row, col FROM o) SELECT 0 AS scan_id, row, col FROM (" + _eroded("whole", S.disc(5)) + ") z")
def footprint(spark, d):
    cells, grid = _walls(spark, d)
    return G.footprint(cells, grid, 5)


_SEAL = "SELECT 0 AS scan_id, s_suppkey % 40 AS r0, s_suppkey % 70 AS c0, s_suppkey % 40 AS r1, s_suppkey % 70 + s_suppkey % 6 AS c1 FROM supplier"


@query("[wc] WITH s AS (" + _SEAL + ") SELECT 0 AS scan_id, row, col FROM wc UNION SELECT 0, s.r0, s.c0 + i.v FROM s, unnest(range(s.c1 - s.c0 + 1)) i(v)")
def door_seal(spark, d):
    cells, grid = _walls(spark, d)
    segments = spark.sql(_SEAL.replace("FROM supplier", "FROM {base}"), base=spark.read.parquet(f"{d}/supplier.parquet"))
    return L.sealed(cells, segments, grid)


@query()
def wall_bridge(spark, d):
    cells, grid = _walls(spark, d)
    return L.sealed(cells, L.bridge_segments(cells), grid)


@query()
def hmaxima(spark, d):
    cells, grid = _walls(spark, d)
    return G.seeds(S.distance(cells, grid), 3.0)


@query()
def watershed_rooms(spark, d):
    cells, grid = _walls(spark, d)
    return G.watershed_rooms(S.thicken(cells, 1, grid), grid, CFG)


_D2 = "dt AS (SELECT l.row, l.col, min((l.row - w.row) * (l.row - w.row) + (l.col - w.col) * (l.col - w.col)) AS d2 FROM fx_labels l, fx_labels w WHERE w.pred = -1 AND l.pred >= 1 GROUP BY 1, 2)"
_CONTACT = _D2 + """, lab AS (SELECT f.row, f.col, f.pred, sqrt(d2) AS d FROM fx_labels f JOIN dt USING (row, col)),
  ct AS (SELECT least(a.pred, b.pred) AS a, greatest(a.pred, b.pred) AS b, max(greatest(a.d, b.d)) AS ridge FROM lab a JOIN lab b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col) WHERE a.pred <> b.pred GROUP BY 1, 2)"""


def _pred_dt(spark, d):
    return S.distance(_pred_walls(spark, d), _label_grid(spark, d))


@query("WITH " + _CONTACT + " SELECT 0 AS scan_id, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, ridge FROM ct")
def room_contact(spark, d):
    return G.contact(_labels(spark, d, "pred").where("label >= 1"), _pred_dt(spark, d))


@query("WITH " + _CONTACT + ", r AS (SELECT l.row, l.col, CASE WHEN l.pred = 3 AND EXISTS (SELECT 1 FROM ct WHERE a = 1 AND b = 3 AND ridge >= 7) THEN 1 ELSE l.pred END AS p FROM fx_labels l) SELECT 0 AS scan_id, row, col, CAST(CASE WHEN p < 1 THEN p ELSE (SELECT count(DISTINCT q.p) FROM r q WHERE q.p BETWEEN 1 AND r.p) END AS BIGINT) AS label FROM r")
def ridge_merge(spark, d):
    return G.merge_open(_labels(spark, d, "pred"), _pred_dt(spark, d), 7.0)


@query("WITH s AS (SELECT pred, avg(CASE WHEN col >= 30 THEN 1.0 ELSE 0.0 END) AS share FROM fx_labels WHERE pred >= 1 GROUP BY 1), k AS (SELECT pred, row_number() OVER (ORDER BY pred) AS id FROM s WHERE share >= 0.25) SELECT 0 AS scan_id, row, col, CAST(CASE WHEN pred < 1 THEN pred ELSE coalesce(id, 0) END AS BIGINT) AS label FROM fx_labels LEFT JOIN k USING (pred)")
def void_reject(spark, d):
    labels = _labels(spark, d, "pred")
    return G.drop_uncovered(labels, labels.where("col >= 30"), CFG.min_coverage_frac)


@query("SELECT 0 AS scan_id, row, col, CAST(CASE pred WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE pred END AS BIGINT) AS label FROM fx_labels WHERE pred <> 1")
def relabel_dense(spark, d):
    return G.relabel(_labels(spark, d, "pred").where("label <> 1"))


@query("SELECT 0 AS scan_id, CAST(pred AS BIGINT) AS label, min(col) AS x0, min(row) AS y0, max(col) AS x1, max(row) AS y1, count(*) AS area, round(avg(col), 6) AS cx, round(avg(row), 6) AS cy, 1.0::DOUBLE AS confidence FROM fx_labels WHERE pred >= 1 GROUP BY pred")
def room_detections(spark, d):
    return G.detections(_labels(spark, d, "pred")).withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


# ---- rooms ----------------------------------------------------------------------------------------------------------

_GROWN = "tr AS (SELECT * FROM lg), grown AS (SELECT DISTINCT pred, row, col FROM ({0}) t)"


def _grown(radius: int) -> str:
    return "grown AS (SELECT DISTINCT pred, row, col FROM (SELECT pred, c.row + o.dy AS row, c.col + o.dx AS col FROM fx_labels c, " + _offsets(S.disc(radius)) + " o(dy, dx), lg WHERE pred >= 1 AND c.row + o.dy BETWEEN 0 AND height - 1 AND c.col + o.dx BETWEEN 0 AND width - 1) t)"


@query("[lg] WITH " + _grown(2) + " SELECT DISTINCT 0 AS scan_id, CAST(x.pred AS BIGINT) AS a, CAST(y.pred AS BIGINT) AS b FROM grown x JOIN grown y USING (row, col) WHERE x.pred < y.pred")
def room_adjacency(spark, d):
    return Q.adjacent(_labels(spark, d, "pred"), _label_grid(spark, d), 2)


@query("[lg] WITH " + _grown(2) + ", " + _CONTACT + ", z AS (SELECT x.pred AS a, y.pred AS b, row, col FROM grown x JOIN grown y USING (row, col) WHERE x.pred < y.pred), s AS (SELECT z.a, z.b, count(*) AS zone, avg(CASE WHEN f.pred = -1 THEN 1.0 ELSE 0.0 END) AS wall_frac FROM z LEFT JOIN fx_labels f USING (row, col) GROUP BY 1, 2) SELECT 0 AS scan_id, CAST(s.a AS BIGINT) AS a, CAST(s.b AS BIGINT) AS b, zone, round(wall_frac, 9) AS wall_frac, coalesce(ridge, 0) AS ridge FROM s LEFT JOIN ct ON ct.a = s.a AND ct.b = s.b")
def interface_evidence(spark, d):
    return Q.interface(_labels(spark, d, "pred"), _pred_walls(spark, d), _pred_dt(spark, d), _label_grid(spark, d), 2).withColumn("wall_frac", F.round("wall_frac", 9))


@query("WITH s AS (SELECT pred, avg(CASE WHEN col % 3 > 0 THEN 1.0 ELSE 0.0 END) AS c, count(*) AS n, (max(row) - min(row) + 1) * (max(col) - min(col) + 1) AS box FROM fx_labels WHERE pred >= 1 GROUP BY 1) SELECT 0 AS scan_id, CAST(pred AS BIGINT) AS room_id, round(c * (CAST(n AS DOUBLE) / box), 9) AS score FROM s")
def room_sanity(spark, d):
    labels = _labels(spark, d, "pred")
    return Q.sanity(Q.room_masks(labels), labels.where("col % 3 > 0"), _pred_walls(spark, d)).withColumn("score", F.round("score", 9))


_RING = """core AS (SELECT m.gt, m.row, m.col FROM fx_labels m, lg WHERE gt >= 1 AND NOT EXISTS (SELECT 1 FROM {o} q(dy, dx) WHERE m.row + q.dy BETWEEN 0 AND height - 1 AND m.col + q.dx BETWEEN 0 AND width - 1
    AND NOT EXISTS (SELECT 1 FROM fx_labels n WHERE n.gt = m.gt AND n.row = m.row + q.dy AND n.col = m.col + q.dx))),
  band AS (SELECT gt, row, col FROM fx_labels EXCEPT SELECT gt, row, col FROM core),
  ring AS (SELECT DISTINCT gt, b.row + o.dy AS row, b.col + o.dx AS col FROM band b, {p} o(dy, dx))""".format(o=_offsets(S.disc(1)), p=_offsets(S.disc(2)))


@query("[wc lg] WITH " + _RING + " SELECT DISTINCT 0 AS scan_id, CAST(ring.gt AS BIGINT) AS room_id, row, col FROM ring JOIN wc USING (row, col), lg WHERE row BETWEEN 0 AND lg.height - 1 AND col BETWEEN 0 AND lg.width - 1")
def boundary_ring(spark, d):
    return Q.boundary_ring(_labels(spark, d), _walls(spark, d)[0], _label_grid(spark, d), 1, 2)


@query("[lg] WITH " + _grown(1) + " SELECT DISTINCT 0 AS scan_id, CAST(g.pred AS BIGINT) AS room_id, row, col FROM grown g JOIN (SELECT row, col FROM fx_labels WHERE pred = -1) w USING (row, col) UNION SELECT 0, CAST(pred AS BIGINT), row, col FROM fx_labels WHERE pred >= 1")
def room_footprint_legacy(spark, d):
    return Q.footprints(_labels(spark, d, "pred"), _label_grid(spark, d), 1)


@query("[wc lg inb] WITH " + _RING + ", m AS (SELECT DISTINCT ring.gt, row, col FROM ring JOIN wc USING (row, col), lg WHERE row BETWEEN 0 AND lg.height - 1 AND col BETWEEN 0 AND lg.width - 1) SELECT CAST(m.gt AS BIGINT) AS room_id, x, y, z FROM inb JOIN m USING (row, col)")
def backproject(spark, d):
    cells, grid = _walls(spark, d)
    masks = Q.boundary_ring(_labels(spark, d), cells, _label_grid(spark, d), 1, 2)
    return Q.backproject(_points(spark, d), masks, grid).select("room_id", "x", "y", "z")


@query("""[mc] WITH s AS (SELECT mask_id, score, count(*) AS area, avg(CASE WHEN row % 3 > 0 THEN 1.0 ELSE 0.0 END) AS c FROM mc WHERE row <> 20 GROUP BY 1, 2), k AS (SELECT * FROM s WHERE area >= 60 AND c >= 0.5),
  b AS (SELECT row, col, mask_id FROM (SELECT m.row, m.col, k.mask_id, row_number() OVER (PARTITION BY m.row, m.col ORDER BY k.score DESC, k.area DESC, k.mask_id) AS r FROM mc m JOIN k USING (mask_id) WHERE m.row <> 20) t WHERE r = 1),
  i AS (SELECT k.mask_id, row_number() OVER (ORDER BY k.score, k.area, k.mask_id DESC) AS label FROM k WHERE mask_id IN (SELECT mask_id FROM b))
  SELECT 0 AS scan_id, row, col, label FROM b JOIN i USING (mask_id)""")
def mask_overlap_resolution(spark, d):
    masks, scores = _masks(spark, d)
    walls = masks.where("row = 20").select("scan_id", "row", "col").distinct()
    return Q.resolve_masks(masks, scores, walls, masks.where("row % 3 > 0").select("scan_id", "row", "col"), CFG)


@query("WITH s AS (SELECT pred, count(*) AS n FROM fx_labels WHERE pred >= 1 GROUP BY 1), k AS (SELECT pred, row_number() OVER (ORDER BY pred) AS id FROM s WHERE n >= 500) SELECT 0 AS scan_id, row, col, CAST(CASE WHEN pred < 1 THEN pred ELSE coalesce(id, 0) END AS BIGINT) AS label FROM fx_labels LEFT JOIN k USING (pred)")
def area_classify(spark, d):
    return Q.drop_small(_labels(spark, d, "pred"), 500)


@query("[free] SELECT 0 AS scan_id, row, col FROM free WHERE NOT EXISTS (SELECT 1 FROM fx_labels l WHERE l.pred >= 1 AND l.row = free.row AND l.col = free.col)")
def residual_free(spark, d):
    cells, grid = _walls(spark, d)
    return Q.residual(S.free_cells(cells, grid), _labels(spark, d, "pred"))


@query()
def buffer_rooms(spark, d):
    labels = _labels(spark, d, "pred").withColumn("label", F.when(F.col("label") == 3, 0).otherwise(F.col("label")).cast("long"))
    return Q.grown_rooms(labels, labels.where("label <> -1").select("scan_id", "row", "col"), _label_grid(spark, d), 3)


@query()
def sam_refine_fake(spark, d):
    """Rooms 1 and 3 of the prediction joined by a confident mask over both; the model is replaced by given masks."""
    labels, walls = _labels(spark, d, "pred"), _pred_walls(spark, d)
    masks = labels.where("label in (1, 3)").select("scan_id", F.lit(1).cast("long").alias("room_id"), "row", "col")
    scores = masks.select("scan_id", "room_id", F.lit(0.95).alias("score")).distinct()
    return Q.relabel_by_masks(labels, walls, _pred_dt(spark, d), _label_grid(spark, d), masks, scores, CFG)


@query("SELECT 0 AS scan_id, row, col, CAST(pred AS BIGINT) AS label, CASE WHEN pred >= 1 THEN (dense_rank() OVER (PARTITION BY pred >= 1 ORDER BY pred) - 1) % 20 * 18 END AS hue FROM fx_labels")
def label_colours(spark, d):
    return V.label_colours(_labels(spark, d, "pred"))


@query("SELECT 0 AS scan_id, CAST(pred AS BIGINT) AS label, round(avg(col), 6) AS x, round(avg(row), 6) AS y, count(*) AS n FROM fx_labels WHERE pred >= 1 GROUP BY pred")
def label_centroids(spark, d):
    return V.label_centroids(_labels(spark, d, "pred")).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query()
def sample_in_masks(spark, d):
    return V.sampled(Q.room_masks(_labels(spark, d, "pred")), 5, ["scan_id", "room_id"], ["row", "col"], seed=42)


@query("SELECT 0 AS scan_id, row * 4 + i.v AS row, col * 4 + j.v AS col FROM fx_labels, unnest(range(4)) i(v), unnest(range(4)) j(v) WHERE pred = 1")
def enlarge_image(spark, d):
    return V.enlarged(_labels(spark, d, "pred").where("label = 1").select("scan_id", "row", "col"), 4)


# ---- walls ----------------------------------------------------------------------------------------------------------


@query("[th] WITH n AS (SELECT CAST(least(floor(theta / (pi() / 180)), 179) AS INTEGER) AS bin, count(*) AS n FROM th GROUP BY 1), f AS (SELECT CAST(b.v AS INTEGER) AS bin, coalesce(n, 0) AS n FROM unnest(range(180)) b(v) LEFT JOIN n ON n.bin = b.v) SELECT f.bin, f.n, round(sum(g.n) / 5.0, 9) AS smoothed FROM f JOIN f g ON least(abs(f.bin - g.bin), 180 - abs(f.bin - g.bin)) <= 2 GROUP BY 1, 2")
def angle_histogram(spark, d):
    return W.angle_histogram(_theta(spark, d), ["scan_id", "room_id"]).select("bin", "n", F.round("smoothed", 9).alias("smoothed"))


@query()
def angle_peaks(spark, d):
    return W.angle_peaks(W.angle_histogram(_theta(spark, d), ["scan_id", "room_id"]), ["scan_id", "room_id"])


@query("[th] SELECT x, y, z, CASE WHEN least(abs(theta - 0.04), pi() - abs(theta - 0.04)) <= least(abs(theta - 1.6), pi() - abs(theta - 1.6)) THEN 0 ELSE 1 END AS peak FROM th")
def nearest_peak(spark, d):
    peaks = spark.createDataFrame([(0, 1, 0, 0.04), (0, 1, 1, 1.6)], "scan_id int, room_id long, peak long, centre double")
    return W.nearest_peak(_theta(spark, d), peaks, ["scan_id", "room_id"]).select("x", "y", "z", F.col("peak").cast("int").alias("peak"))


@query("WITH s AS (SELECT wall_id, axis, offs, CASE WHEN offs - lag(offs) OVER (PARTITION BY axis ORDER BY offs) > 0.2 THEN 1 ELSE 0 END AS j FROM fx_walls) SELECT axis, offs, CAST(sum(j) OVER (PARTITION BY axis ORDER BY offs) AS BIGINT) AS cluster FROM s")
def gap_clusters(spark, d):
    return W.gap_clusters(fixture(spark, d, "fx_walls"), ["axis"], "offs", 0.2).select("axis", "offs", "cluster")


@query("""[th] WITH n AS (SELECT *, CASE WHEN least(abs(theta - 0.04), pi() - abs(theta - 0.04)) <= least(abs(theta - 1.6), pi() - abs(theta - 1.6)) THEN 0 ELSE 1 END AS peak FROM th),
  m AS (SELECT peak, atan2(avg(sin(2 * theta)), avg(cos(2 * theta))) / 2 AS f FROM n GROUP BY 1), o AS (SELECT n.peak, x * cos(f + CASE WHEN f < 0 THEN pi() ELSE 0 END) + y * sin(f + CASE WHEN f < 0 THEN pi() ELSE 0 END) AS offs FROM n JOIN m USING (peak)),
  g AS (SELECT *, CASE WHEN offs - lag(offs) OVER (PARTITION BY peak ORDER BY offs) > 0.2 THEN 1 ELSE 0 END AS j FROM o), c AS (SELECT peak, offs, sum(j) OVER (PARTITION BY peak ORDER BY offs) AS cluster FROM g),
  k AS (SELECT peak, cluster, count(*) AS n, round(avg(offs), 6) AS offset_m FROM c GROUP BY 1, 2 HAVING count(*) >= 30) SELECT row_number() OVER (ORDER BY peak, cluster) AS wall_id, n, offset_m FROM k""")
def wall_offset_segments(spark, d):
    peaks = spark.createDataFrame([(0, 1, 0, 0.04), (0, 1, 1, 1.6)], "scan_id int, room_id long, peak long, centre double")
    return W.segments_of(_theta(spark, d), peaks, CFG).groupBy("wall_id").agg(F.count("*").alias("n"), F.round(F.first("offset"), 6).alias("offset_m"))


def _flat_segments(spark, d):
    """Each outer surface of the fixture as a wall with a known normal."""
    p = _points(spark, d).where("surf >= 2")
    flat = F.when(F.col("surf") <= 3, 0.0).otherwise(1.0)
    return p.select("scan_id", F.lit(1).cast("long").alias("room_id"), F.col("surf").cast("long").alias("wall_id"), "x", "y", "z", flat.alias("wx"), (1 - flat).alias("wy"), F.when(F.col("surf") <= 3, F.col("y")).otherwise(F.col("x")).alias("offset"))


_FLAT = """s AS (SELECT surf, CASE WHEN surf <= 3 THEN -x ELSE y END AS u, z FROM fx_points WHERE surf >= 2), t AS (SELECT surf, min(u) AS u0, max(u) AS u1, min(z) AS z0, max(z) AS z1 FROM s GROUP BY 1),
  c AS (SELECT DISTINCT s.surf, CAST(trunc((u - u0) / 0.1::DOUBLE) AS BIGINT) AS col, CAST(trunc((z1 - z0) / 0.1::DOUBLE) AS BIGINT) - CAST(trunc((z - z0) / 0.1::DOUBLE) AS BIGINT) AS row FROM s JOIN t USING (surf))"""


@query("WITH " + _FLAT + " SELECT CAST(surf AS BIGINT) AS wall_id, row, col FROM c")
def flatten_wall(spark, d):
    return W.flattened(_flat_segments(spark, d), Config(flat_pixel_m=0.1), clean=False).select("wall_id", "row", "col")


@query()
def outlier_filter(spark, d):
    """All wall points, wall by wall, as in the run. SQL would compare all pairs of a wall's points."""
    return W.without_outliers(_flat_segments(spark, d), W.WALL, 20, 2.0).select("wall_id", "x", "y", "z")


@query()
def normals_pca(spark, d):
    return W.normals(_room_points(spark, d), ["scan_id", "room_id"], 0.5, 30).select("pid", F.round(F.abs("nz"), 3).alias("nz"))


@query()
def wall_segments(spark, d):
    import dataclasses

    found = W.wall_segments(_room_points(spark, d), dataclasses.replace(CFG, normal_radius_m=0.4))
    return found.groupBy("room_id", "wall_id").agg(F.count("*").alias("n"), F.round(F.first("offset"), 2).alias("offset_m"))


@query()
def ransac_planes(spark, d):
    import dataclasses

    return W.ransac_planes(_room_points(spark, d), ["scan_id", "room_id"], dataclasses.replace(CFG, ransac_min_inliers=100))


# ---- openings -------------------------------------------------------------------------------------------------------


@query()
def void_components(spark, d):
    flat = W.flattened(_flat_segments(spark, d), Config(flat_pixel_m=0.1), clean=False)
    grid = flat.select("scan_id", "room_id", "wall_id", "width", "height").distinct()
    return O.voids(flat, grid, min_px=15, open_px=1, keys=["scan_id", "room_id", "wall_id"])


def _openings(spark, d):
    o = fixture(spark, d, "fx_openings")
    return o.select((F.col("opening_id") % 40).cast("int").alias("scan_id"), F.col("opening_id").cast("long").alias("opening_id"), "bx", "byy", "w", "h", "area", "img_h", F.lit(1.0).alias("score"))


@query("SELECT a.opening_id % 40 AS scan_id, a.opening_id AS a, b.opening_id AS b FROM fx_openings a JOIN fx_openings b ON a.opening_id % 40 = b.opening_id % 40 AND a.opening_id < b.opening_id WHERE a.bx <= b.bx + b.w + 3 AND b.bx <= a.bx + a.w + 3 AND a.byy <= b.byy + b.h + 3 AND b.byy <= a.byy + a.h + 3")
def bbox_close_pairs(spark, d):
    return O.near_pairs(_openings(spark, d), ["scan_id"], 3)


@query()
def opening_merge(spark, d):
    return O.merged(_openings(spark, d), ["scan_id"], 3)


_RECT = "SELECT *, w * 0.04::DOUBLE AS wm, h * 0.04::DOUBLE AS hm, img_h - byy - h AS below, CAST(area AS DOUBLE) / (w * h) AS rect FROM fx_openings"
_LABEL = "CASE WHEN rect < 0.55 THEN 'unknown' WHEN below <= 3 AND wm BETWEEN 0.5 AND 1.8 AND hm BETWEEN 1.8 AND 2.8 THEN 'door' WHEN below > 3 AND below * 0.04::DOUBLE >= 0.3 AND wm BETWEEN 0.3 AND 2.5 AND hm BETWEEN 0.3 AND 2.0 THEN 'window' ELSE 'unknown' END"


@query("WITH o AS (" + _RECT + ") SELECT opening_id, wm AS width_m, hm AS height_m, below * 0.04::DOUBLE AS sill_m, below <= 3 AS touches_floor, rect AS rectangularity, " + _LABEL + " AS label FROM o")
def opening_classify(spark, d):
    return O.classified(fixture(spark, d, "fx_openings"), Config()).select("opening_id", "width_m", "height_m", "sill_m", "touches_floor", "rectangularity", "label")


@query("WITH o AS (" + _RECT + "), l AS (SELECT " + _LABEL + " AS label FROM o) SELECT count(*) FILTER (WHERE label = 'door') AS doors, count(*) FILTER (WHERE label = 'window') AS windows, count(*) AS openings FROM l")
def opening_totals(spark, d):
    return O.opening_totals(O.classified(fixture(spark, d, "fx_openings"), Config()))


# ---- building -------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT surf, CASE WHEN surf <= 3 THEN -x ELSE y END AS u, z FROM fx_points WHERE surf >= 2), t AS (SELECT surf, min(u) AS u0, max(u) AS u1, min(z) AS z0, max(z) AS z1 FROM s GROUP BY 1),
  g AS (SELECT t.*, greatest(CAST(trunc((u1 - u0) / 0.1::DOUBLE) AS BIGINT), 1) AS nu, greatest(CAST(trunc((z1 - z0) / 0.1::DOUBLE) AS BIGINT), 1) AS nz FROM t),
  k AS (SELECT surf, count(*) AS used FROM (SELECT DISTINCT s.surf, least(CAST(trunc((u - u0) / 0.1::DOUBLE) AS BIGINT), nu - 1), least(CAST(trunc((z - z0) / 0.1::DOUBLE) AS BIGINT), nz - 1) FROM s JOIN g USING (surf)) q GROUP BY 1)
  SELECT CAST(surf AS BIGINT) AS wall_id, u1 - u0 AS length, z1 - z0 AS height, 0.0::DOUBLE AS thickness, round(CAST(used AS DOUBLE) / (nu * nz), 9) AS fill_ratio, true AS is_exterior FROM g JOIN k USING (surf)""")
def wall_geometry(spark, d):
    return B.wall_geometry(_flat_segments(spark, d)).select("wall_id", "length", "height", "thickness", F.round("fill_ratio", 9).alias("fill_ratio"), "is_exterior")


_PAIR = """p AS (SELECT a.wall_id AS i, b.wall_id AS j, a.room_id AS ri, b.room_id AS rj, a.length AS la, b.length AS lb, least(abs(a.angle - b.angle), pi() - abs(a.angle - b.angle)) AS gap,
  sqrt((a.ex - a.sx) * (a.ex - a.sx) + (a.ey - a.sy) * (a.ey - a.sy)) AS n, a.ex - a.sx AS dx, a.ey - a.sy AS dy, (b.sx + b.ex) / 2 - a.sx AS mx, (b.sy + b.ey) / 2 - a.sy AS my, b.sx - a.sx AS px, b.sy - a.sy AS py, b.ex - a.sx AS qx, b.ey - a.sy AS qy,
  least(sqrt((a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2), sqrt((a.sx - b.ex) ** 2 + (a.sy - b.ey) ** 2), sqrt((a.ex - b.sx) ** 2 + (a.ey - b.sy) ** 2), sqrt((a.ex - b.ex) ** 2 + (a.ey - b.ey) ** 2)) AS near
  FROM fx_walls a JOIN fx_walls b ON a.wall_id < b.wall_id),
  o AS (SELECT *, abs((mx * -dy + my * dx) / n) AS off, least(n, greatest((px * dx + py * dy) / n, (qx * dx + qy * dy) / n)) - greatest(0, least((px * dx + py * dy) / n, (qx * dx + qy * dy) / n)) AS ov FROM p WHERE gap < radians(10))"""


@query("WITH " + _PAIR + " SELECT i AS a, j AS b FROM o WHERE ri = rj AND off <= 0.45 AND (ov > 0 OR near < 0.5) AND ov / least(la, lb) >= 0.3")
def face_merge_pairs(spark, d):
    return B.face_pairs(_faces(spark, d), CFG).select("a", "b")


@query("WITH " + _PAIR + " SELECT i AS a, j AS b FROM o WHERE off <= 0.45 AND (ov > 0 OR near < 0.5) AND -ov <= 0.45")
def wall_dedup_pairs(spark, d):
    return B.duplicate_pairs(_faces(spark, d), CFG).select("a", "b")


@query("SELECT wall_id, CASE WHEN wall_id % 9 = 0 THEN 0.3 WHEN thickness > 0.4 THEN 0.15 ELSE thickness END AS thickness FROM fx_walls WHERE length BETWEEN 0.3 AND 15 AND length / greatest(height, 0.001) >= 0.15")
def wall_filter(spark, d):
    return B.usable(_faces(spark, d), CFG).select("wall_id", "thickness")


@query()
def wall_merge(spark, d):
    return B.merged_faces(_faces(spark, d), CFG).drop("sources")


@query()
def wall_dedup(spark, d):
    return B.deduplicated(_faces(spark, d), CFG).drop("rooms")


@query()
def manhattan_snap(spark, d):
    w = _faces(spark, d).withColumn("angle", F.col("angle") + (F.col("wall_id") % 5) * 0.01)
    return B.snapped_angles(w, B.dominant_angles(w)).select("wall_id", *[F.round(c, 9).alias(c) for c in ("sx", "sy", "ex", "ey", "angle")])


@query()
def endpoint_snap(spark, d):
    return B.snapped_ends(_faces(spark, d), CFG.ifc_snap_tolerance_m).select("wall_id", "sx", "sy", "ex", "ey")


@query("""WITH l AS (SELECT room_id, axis FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY length DESC, wall_id) AS r FROM fx_walls) t WHERE r = 1)
  SELECT room_id, round(min(least(sx, ex)), 6) AS x0, round(max(greatest(sx, ex)), 6) AS x1, round(min(least(sy, ey)), 6) AS y0, round(max(greatest(sy, ey)), 6) AS y1 FROM fx_walls GROUP BY 1""")
def room_boundary(spark, d):
    b = B.room_boundaries(_faces(spark, d)).select("room_id", F.explode("boundary").alias("p"))
    x, y = F.col("p")[0], F.col("p")[1]
    return b.groupBy("room_id").agg(F.round(F.min(x), 6).alias("x0"), F.round(F.max(x), 6).alias("x1"), F.round(F.min(y), 6).alias("y0"), F.round(F.max(y), 6).alias("y1"))


@query("SELECT 0 AS scan_id, quantile_cont(height, 0.9) AS storey_height FROM fx_walls")
def storey_height(spark, d):
    return B.storey_height(_faces(spark, d))


def _doors(walls):
    """A stand-in door in the middle of every fourth wall, for the fixture's walls have no points to find doors in."""
    doors = walls.where("wall_id % 4 = 0").select("scan_id", "wall_id", ((F.col("sx") + F.col("ex")) / 2).alias("x"), ((F.col("sy") + F.col("ey")) / 2).alias("y"), F.lit(0.9).alias("width"), F.lit(2.1).alias("height"))
    return B.carried(doors, walls, CFG)


@query()
def building_document(spark, d):
    walls = B.grouped(_faces(spark, d), CFG)
    unique = B.deduplicated(walls, CFG)
    return B.document(unique, _doors(walls), walls, CFG).select(F.to_json(F.struct("project", "storeys", "walls", "doors", "windows", "rooms")).alias("document"))


@query()
def ifc_entities(spark, d):
    from .ifc import entities

    walls = B.grouped(_faces(spark, d), CFG)
    return entities(B.document(B.deduplicated(walls, CFG), _doors(walls), walls, CFG), CFG)


# ---- enrichment -----------------------------------------------------------------------------------------------------


@query("WITH w AS (SELECT wall_id, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) AS n, height AS h, thickness AS t FROM fx_walls) SELECT wall_id, round(n, 6) AS \"Length\", round(h, 6) AS \"Height\", round(t, 6) AS \"Width\", round(n * t, 6) AS \"GrossFootprintArea\", round(n * h, 6) AS \"GrossSideArea\", round(n * h * t, 6) AS \"GrossVolume\", round(n * h * t, 6) AS \"NetVolume\" FROM w")
def qto_wall(spark, d):
    q = E.wall_quantities(_faces(spark, d)).drop("scan_id")
    return q.select("wall_id", *[F.round(c, 6).alias(c) for c in q.columns if c != "wall_id"])


@query("SELECT opening_id, round(w * 0.04::DOUBLE, 6) AS \"Width\", round(h * 0.04::DOUBLE, 6) AS \"Height\", round(w * 0.04::DOUBLE * (h * 0.04::DOUBLE), 6) AS \"Area\" FROM fx_openings")
def qto_door(spark, d):
    o = fixture(spark, d, "fx_openings").select("opening_id", (F.col("w") * F.lit(0.04)).alias("width"), (F.col("h") * F.lit(0.04)).alias("height"))
    return E.opening_quantities(o, "opening_id").select("opening_id", *[F.round(c, 6).alias(c) for c in ("Width", "Height", "Area")])


_BOX = "b AS (SELECT room_id, max(greatest(sx, ex)) - min(least(sx, ex)) AS w, max(greatest(sy, ey)) - min(least(sy, ey)) AS l, max(height) AS h FROM fx_walls GROUP BY 1)"


def _rooms(spark, d):
    walls = _faces(spark, d)
    return B.room_boundaries(walls).join(walls.groupBy("scan_id", "room_id").agg(F.max("height").alias("height")), ["scan_id", "room_id"])


@query("WITH " + _BOX + " SELECT room_id, round(w * l, 6) AS \"GrossFloorArea\", round(w * l, 6) AS \"NetFloorArea\", round(w * l * h, 6) AS \"GrossVolume\", round(2 * (w + l), 6) AS \"GrossPerimeter\", h AS \"Height\" FROM b")
def qto_space(spark, d):
    q = E.space_quantities(_rooms(spark, d)).drop("scan_id")
    return q.select("room_id", *[F.round(c, 6).alias(c) for c in q.columns if c not in ("room_id", "Height")], "Height")


@query("WITH " + _BOX + " SELECT room_id, 0.2::DOUBLE AS \"Width\", round(w * l, 6) AS \"GrossArea\", round(w * l * 0.2::DOUBLE, 6) AS \"GrossVolume\" FROM b")
def qto_slab(spark, d):
    q = E.slab_quantities(_rooms(spark, d), CFG.ifc_slab_thickness)
    return q.select("room_id", "Width", F.round("GrossArea", 6).alias("GrossArea"), F.round("GrossVolume", 6).alias("GrossVolume"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v) + "'" for v in r) + ")" for r in rows)


_DICTIONARY = [("IfcWall", "FireRating", "String"), ("IfcWall", "Compartmentation", "Boolean"), ("IfcWall", "ThermalMass", "Real"), ("IfcDoor", "Leafs", "Integer"), ("IfcDoor", "HasDrive", "Boolean")]
_DEFAULT_ROWS = [(c, k, v) for c, ps in E.DEFAULTS.items() for k, v in ps.items()]


@query("WITH d(c, p, t) AS (VALUES " + _values(_DICTIONARY) + "), v(c, p, x) AS (VALUES " + _values(_DEFAULT_ROWS) + ") SELECT coalesce(d.c, v.c) AS ifc_class, coalesce(d.p, v.p) AS property, coalesce(x, CASE WHEN t = 'Boolean' THEN 'False' WHEN t = 'Real' THEN '0.0' WHEN t = 'Integer' THEN '0' ELSE '' END) AS value FROM d FULL JOIN v ON d.c = v.c AND d.p = v.p")
def pset_merge(spark, d):
    return E.merged_properties(spark.createDataFrame(_DICTIONARY, "ifc_class string, property string, data_type string"), E.property_table(spark))


@query("WITH e AS (SELECT 'Wall-' || wall_id AS name, 'thickness' AS property, thickness AS value, 0.05::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM fx_walls UNION ALL SELECT 'Wall-' || wall_id, 'length', length * 7, 0.2::DOUBLE, 30.0::DOUBLE FROM fx_walls) SELECT name, 'IfcWall' AS ifc_class, property, value, lo, hi FROM e WHERE value < lo OR value > hi")
def geometry_limits(spark, d):
    w = _faces(spark, d).select(F.concat(F.lit("Wall-"), "wall_id").alias("name"), F.lit("IfcWall").alias("ifc_class"), F.expr("stack(2, 'thickness', thickness, 'length', length * 7) AS (property, value)"))
    return E.out_of_range(w).drop("message")


@query("SELECT 'Wall-' || (wall_id * 2) AS name, CAST(wall_id * 2 AS VARCHAR) AS id, (SELECT length FROM fx_walls w WHERE w.wall_id = v.wall_id * 2) AS length FROM fx_walls v")
def element_match(spark, d):
    w = _faces(spark, d)
    rows = w.select(F.col("wall_id").cast("string").alias("id"), "length")
    return E.matched(w.select(F.concat(F.lit("Wall-"), F.col("wall_id") * 2).alias("name")), rows).select("name", "id", "length")


@query("WITH h AS (SELECT s_suppkey % 5 AS k, s_suppkey AS pos, CASE WHEN s_suppkey % 7 = 0 THEN 'CLASS' || (s_suppkey % 5) ELSE 'other' END AS name, 'uri/' || s_suppkey AS uri FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN lower(name) = 'class' || k OR contains(lower(uri), 'class' || k) THEN 0 ELSE 1 END, pos) AS n FROM h) SELECT 'Class' || k AS label, name, uri FROM r WHERE n = 1")
def class_lookup(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    hits = s.selectExpr("concat('Class', s_suppkey % 5) AS label", "s_suppkey AS position", "CASE WHEN s_suppkey % 7 = 0 THEN concat('CLASS', s_suppkey % 5) ELSE 'other' END AS name", "concat('uri/', s_suppkey) AS uri")
    return E.best_class_hit(hits)


# ---- metrics --------------------------------------------------------------------------------------------------------


@query("[wc] WITH n AS (SELECT surf, row_number() OVER (ORDER BY 'room_' || surf) AS label FROM (SELECT DISTINCT surf FROM fx_points) s), c AS (SELECT height - 1 - CAST(trunc((y - b_min) / 0.1::DOUBLE) AS BIGINT) AS row, CAST(trunc((x - a_min) / 0.1::DOUBLE) AS BIGINT) AS col, label, width, height FROM fx_points JOIN n USING (surf), tr WHERE surf <> 3) SELECT 0 AS scan_id, row, col, CAST(max(label) AS INTEGER) AS label FROM c WHERE row BETWEEN 0 AND height - 1 AND col BETWEEN 0 AND width - 1 GROUP BY 1, 2, 3")
def gt_last_wins(spark, d):
    p = _points(spark, d).select("scan_id", "x", "y", "z", F.concat(F.lit("room_"), "surf").alias("room"), F.when(F.col("surf") == 3, "clutter").otherwise("floor").alias("class"))
    return M.truth_labels(p, _walls(spark, d)[1], exclude=("clutter",))


@query("SELECT 0 AS scan_id, pred, gt, count(*) AS n FROM fx_labels GROUP BY 2, 3")
def crosstab(spark, d):
    return M.crosstab(fixture(spark, d, "fx_labels"))


@query("[ov] SELECT 0 AS scan_id, pred, gt, n, pa AS pred_area, ga AS gt_area, iou, p, g FROM ov")
def overlap_stats(spark, d):
    return M.overlaps(fixture(spark, d, "fx_labels"))


@query("[best] SELECT 0 AS scan_id, gt, pred AS best_pred, iou FROM best")
def room_matches(spark, d):
    return M.per_room(fixture(spark, d, "fx_labels"))


@query("[best] SELECT 0 AS scan_id, (SELECT count(DISTINCT gt) FROM fx_labels WHERE gt >= 1) AS n_gt, (SELECT count(DISTINCT pred) FROM fx_labels WHERE pred >= 1) AS n_pred, (SELECT avg(iou) FROM best) AS mean_iou, (SELECT count(*) FROM (SELECT gt FROM ov WHERE p >= 0.5 OR g >= 0.5 GROUP BY 1 HAVING count(*) >= 2) x) AS over_seg, (SELECT count(*) FROM (SELECT pred FROM ov WHERE p >= 0.5 OR g >= 0.5 GROUP BY 1 HAVING count(*) >= 2) x) AS under_seg")
def score_rooms(spark, d):
    return M.room_scores(fixture(spark, d, "fx_labels"))


@query("[ov] WITH t AS (SELECT count(*) AS tp, coalesce(avg(iou), 0) AS sq FROM ov WHERE iou > 0.5), c AS (SELECT count(DISTINCT CASE WHEN gt >= 1 THEN gt END) AS ng, count(DISTINCT CASE WHEN pred >= 1 THEN pred END) AS np FROM fx_labels) SELECT 0 AS scan_id, tp, np - tp AS fp, ng - tp AS fn, round(sq, 9) AS sq, round(tp / (tp + 0.5 * (np - tp) + 0.5 * (ng - tp)), 9) AS rq, round(sq * (tp / (tp + 0.5 * (np - tp) + 0.5 * (ng - tp))), 9) AS pq FROM t, c")
def panoptic_quality(spark, d):
    return M.panoptic(fixture(spark, d, "fx_labels")).withColumns({c: F.round(c, 9) for c in ("sq", "rq", "pq")})


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'wall' WHEN s_suppkey % 3 = 1 THEN 'book_case' ELSE 'clutter_2_x' END AS class FROM supplier")
def annotation_classes(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 3 = 0 THEN concat('a/b/wall_', s_suppkey, '.txt') WHEN s_suppkey % 3 = 1 THEN concat('book_case_', s_suppkey, '.txt') ELSE 'clutter_2_x.txt' END AS f")
    return s.select("s_suppkey", annotation_class(F.col("f")).alias("class"))
