"""Registered queries against their SQL at the smallest scale, and the driver's entry points."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_points
from scanloom.plans.catalog import CFG, ORACLE_SQL, QUERIES
from scanloom.sources.fixtures import fixture

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    result = db.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == names
    at = [result.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr) == want


def test_outlier_filter_takes_all_walls(spark):
    walls = fixture(spark, SF, "fx_points").where("surf >= 2").toPandas()
    want = []
    for surf, w in walls.groupby("surf"):
        xyz = w[["x", "y", "z"]].to_numpy()
        mean = np.array([np.sort(np.sqrt(((xyz - p) ** 2).sum(1)))[:20].mean() for p in xyz])
        want += [(surf, *p) for p in xyz[mean <= mean.mean() + 2 * mean.std(ddof=1)].tolist()]
    assert len({w[0] for w in want}) == 5 and len(want) < len(walls)
    assert sorted(map(tuple, QUERIES["outlier_filter"](spark, SF).collect())) == sorted(want)


def flooded(cells, around):
    """Components of a set of (row, col), in the order of their first cells."""
    left, out = set(cells), []
    for start in sorted(cells):
        if start not in left:
            continue
        left.discard(start)
        comp, todo = {start}, [start]
        while todo:
            r, c = todo.pop()
            more = {(r + a, c + b) for a, b in around} & left
            left -= more
            comp |= more
            todo += more
        out.append(comp)
    return out


def test_regions_equal_flooding_of_the_tenth_metre_raster(spark):
    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    eight = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    slab = QUERIES["occupancy"](spark, SF).toPandas()
    walls = {(r, c) for r, c in zip(slab["row"], slab["col"])}
    height, width = (max(k) + 1 for k in zip(*walls))
    assert height >= 50 and width >= 80
    comps = flooded(walls, eight)
    got = {(r.row, r.col): r.label for r in QUERIES["components"](spark, SF).collect()}
    assert got == {cell: k for k, comp in enumerate(comps, 1) for cell in comp}
    got = {(r.row, r.col) for r in QUERIES["clean_walls"](spark, SF).collect()}
    assert got == {cell for comp in comps if len(comp) >= CFG.min_wall_area_px for cell in comp}
    free = {(r, c) for r in range(height) for c in range(width)} - walls
    holes = {cell for comp in flooded(free, four) if not any(r in (0, height - 1) or c in (0, width - 1) for r, c in comp) for cell in comp}
    assert {(r.row, r.col) for r in QUERIES["fill_holes"](spark, SF).collect()} == walls | holes
    share = QUERIES["interior_coverage"](spark, SF).first()
    assert share.interior_cells == len(holes) and share.frac == round(sum(r % 2 == 0 for r, _ in holes) / max(len(holes), 1), 9)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
