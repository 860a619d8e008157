"""Closing gaps of wall rasters: lines across doors, and bridges between wall ends that point at each other."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .regions import CELL
from .stencil import dilate, disc


def wall_ends(skeleton: np.ndarray, reach: float = 6.0) -> list[tuple[int, int, float, float]]:
    """(row, col, d_row, d_col) of skeleton cells with one neighbour; the direction leads away from the cells in reach."""
    rows, cols = np.nonzero(skeleton)
    at = np.stack([rows, cols], 1)
    out = []
    for r, c in at.tolist():
        if skeleton[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2].sum() != 2:
            continue
        near = at[((at - (r, c)) ** 2).sum(1) <= reach * reach]
        away = np.array([r, c]) - near.mean(0)
        size = float(np.hypot(*away))
        if size > 0:
            out.append((r, c, float(away[0]) / size, float(away[1]) / size))
    return out


def bridges(ends: list[tuple[int, int, float, float]], max_gap: float = 12.0, max_angle_deg: float = 45.0) -> list[tuple[int, int, int, int]]:
    """Pairs of ends to connect: nearest first, each end once, both pointing at the other within the angle."""
    least = math.cos(math.radians(max_angle_deg))
    options = []
    for i, (r, c, dr, dc) in enumerate(ends):
        for j in range(i + 1, len(ends)):
            y, x, ey, ex = ends[j]
            gap = math.hypot(y - r, x - c)
            if 0 < gap <= max_gap and (dr * (y - r) + dc * (x - c)) / gap >= least and (ey * (r - y) + ex * (c - x)) / gap >= least:
                options.append((gap, i, j))
    used: set[int] = set()
    out = []
    for _, i, j in sorted(options):
        if i not in used and j not in used:
            used |= {i, j}
            out.append((*ends[i][:2], *ends[j][:2]))
    return out


def lines(segments: DataFrame) -> DataFrame:
    """Cells of straight segments (scan_id, r0, c0, r1, c1), one per step along the longer axis."""
    steps = F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0")), F.lit(1))
    at = segments.withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long"))))
    place = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n") + 0.5).cast("long")
    return at.select("scan_id", place("r0", "r1").alias("row"), place("c0", "c1").alias("col")).distinct()


def sealed(walls: DataFrame, segments: DataFrame, grid: DataFrame, thickness: int = 1) -> DataFrame:
    """Wall cells with the segments drawn in the given thickness."""
    drawn = lines(segments)
    if thickness > 1:
        drawn = dilate(drawn, disc(thickness // 2), grid)
    return walls.select(*CELL).union(drawn.select(*CELL)).distinct()


def bridge_segments(walls: DataFrame, max_gap: float = 12.0, max_angle_deg: float = 45.0) -> DataFrame:
    """Segments that bridge the ends of each scan's thinned walls; thinning and greedy pairing run one scan per group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        thin = K.thinned(K.dense(r, c, True, (r.max() + 1, c.max() + 1), False))
        found = bridges(wall_ends(thin), max_gap, max_angle_deg)
        return pd.DataFrame([(pdf["scan_id"].iloc[0], *b) for b in found], columns=["scan_id", "r0", "c0", "r1", "c1"])

    return walls.select(*CELL).groupBy("scan_id").applyInPandas(run, "scan_id int, r0 long, c0 long, r1 long, c1 long")
