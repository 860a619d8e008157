"""Scan-like relations derived from the driver's tables by integer arithmetic, as SQL valid in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One statement per relation; a relation may refer to the ones before it.
FIXTURES = {
    "fx_points": """SELECT 0 AS scan_id, surf, CAST(x_mm AS DOUBLE)/1000 AS x, CAST(y_mm AS DOUBLE)/1000 AS y, CAST(z_mm AS DOUBLE)/1000 AS z
FROM (SELECT surf,
  CASE WHEN surf <= 3 THEN u % 8000 WHEN surf = 4 THEN 0 WHEN surf = 5 THEN 8000 ELSE 4000 END AS x_mm,
  CASE WHEN surf <= 1 THEN v % 5000 WHEN surf = 2 THEN 0 WHEN surf = 3 THEN 5000 WHEN surf <= 5 THEN u % 5000
       WHEN u % 4600 < 2300 THEN u % 4600 ELSE u % 4600 + 400 END AS y_mm,
  CASE WHEN surf = 0 THEN 0 WHEN surf = 1 THEN 2500 ELSE w % 2500 END AS z_mm
 FROM (SELECT CAST((l_orderkey*31 + l_partkey*17 + l_suppkey*7 + l_linenumber) % 7 AS INT) AS surf,
   (l_orderkey*7919 + l_partkey*104729 + l_suppkey*1299709 + l_linenumber*15485863) % 1000003 AS u,
   (l_orderkey*611953 + l_partkey*7907 + l_suppkey*86028121 + l_linenumber*49979687) % 1000033 AS v,
   (CAST(round(l_extendedprice*100) AS BIGINT)*48611 + l_partkey*22801763) % 1000037 AS w FROM lineitem) a) b""",
    "fx_labels": """SELECT 0 AS scan_id, r AS row, c AS col, CASE WHEN c < 40 THEN 1 ELSE 2 END AS gt,
  CASE WHEN c = 38 THEN -1 WHEN c < 38 AND r < 10 THEN 3 WHEN c < 38 THEN 1 ELSE 2 END AS pred
FROM (SELECT DISTINCT CAST(floor(y*10) AS BIGINT) AS r, CAST(floor(x*10) AS BIGINT) AS c FROM fx_points WHERE surf = 0) a""",
    "fx_walls": """SELECT 0 AS scan_id, wall_id, room_id, sx, sy, CASE WHEN axis = 0 THEN sx + length ELSE sx END AS ex,
  CASE WHEN axis = 0 THEN sy ELSE sy + length END AS ey, axis, length, CASE WHEN axis = 0 THEN 1.5707963267948966D ELSE 0.0D END AS angle,
  CASE WHEN axis = 0 THEN sy ELSE sx END AS offs, 2.0D + CAST(wall_id % 7 AS DOUBLE)/10 AS height,
  CAST(5 + wall_id * 11 % 40 AS DOUBLE)/100 AS thickness
 FROM (SELECT s_suppkey AS wall_id, s_suppkey % 10 - s_suppkey % 2 AS room_id,
  CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey*13 % 60 AS DOUBLE)/10 ELSE CAST((s_suppkey*29) % 5 AS DOUBLE)*2 + CAST(s_suppkey % 3 AS DOUBLE)/10 END AS sx,
  CASE WHEN s_suppkey % 2 = 0 THEN CAST((s_suppkey*29) % 4 AS DOUBLE)*2 + CAST(s_suppkey % 3 AS DOUBLE)/10 ELSE CAST(s_suppkey*13 % 60 AS DOUBLE)/10 END AS sy,
  s_suppkey % 2 AS axis, CAST(1 AS DOUBLE)/2 + CAST(s_suppkey*17 % 50 AS DOUBLE)/10 AS length FROM supplier) a""",
    "fx_openings": """SELECT p_partkey AS opening_id, p_partkey % 60 AS bx, CASE WHEN p_partkey % 2 = 0 THEN 63 - h ELSE p_partkey % 20 END AS byy, w, h,
  CAST(floor(w*h*(40 + p_partkey % 61)/100) AS BIGINT) AS area, 63 AS img_h
FROM (SELECT p_partkey, 5 + (p_partkey*7) % 45 AS w, 10 + p_size AS h FROM part) a""",
    "fx_masks": """SELECT vec_id AS mask_id, CAST(60 + (vec_id*37) % 40 AS DOUBLE)/100 AS score, (vec_id*53) % 70 AS c0, (vec_id*31) % 40 AS r0,
  4 + (vec_id*7) % 12 AS w, 4 + (vec_id*11) % 10 AS h FROM embeddings""",
}
_BASE = {"fx_points": "lineitem", "fx_walls": "supplier", "fx_openings": "part", "fx_masks": "embeddings"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture relation over the tables in sf_dir, as a plan of its own (nothing is registered)."""
    if name == "fx_labels":
        return spark.sql(FIXTURES[name].replace("FROM fx_points", "FROM {points}"), points=fixture(spark, sf_dir, "fx_points"))
    base = _BASE[name]
    return spark.sql(FIXTURES[name].replace(f"FROM {base}", "FROM {base}"), base=spark.read.parquet(f"{sf_dir}/{base}.parquet"))


def with_fixtures(query: str) -> str:
    """A DuckDB statement with the fixtures it names as common table expressions before its own."""
    names = [n for n in FIXTURES if n in query]
    if "fx_labels" in names and "fx_points" not in names:
        names.insert(0, "fx_points")
    heads = [f"{n} AS ({FIXTURES[n].replace('6D E', '6 E').replace('6D ', '6::DOUBLE ').replace('0.0D', '0.0::DOUBLE').replace('2.0D', '2.0::DOUBLE')})" for n in names]
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*heads, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*heads, body[5:]])
    return ("WITH " + ", ".join(heads) + " " if heads else "") + body
