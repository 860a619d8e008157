"""Point-cloud files: .xyz text, ASCII and binary PLY, annotated room trees; as DataFrames of points."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "scan_id int, x double, y double, z double"
_NUMBER = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def read_xyz(spark: SparkSession, path: str, scan_id: int = 0) -> DataFrame:
    """Points of whitespace-separated text, columns after the third unread; stray characters in numbers are dropped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 3)
    clean = lambda k: F.regexp_replace(F.col("p")[k], "[^0-9eE.+-]", "").try_cast("double")
    return rows.select(F.lit(scan_id).alias("scan_id"), clean(0).alias("x"), clean(1).alias("y"), clean(2).alias("z")).where("x is not null and y is not null and z is not null")


def write_xyz(points: DataFrame, path: str) -> None:
    points.select(F.format_string("%.4f %.4f %.4f", "x", "y", "z").alias("value")).write.mode("overwrite").text(path)


def parse_ply(data: bytes) -> pd.DataFrame:
    """The vertices of a PLY file, all scalar properties by name."""
    end = data.index(b"end_header")
    head = data[:end].decode("ascii").splitlines()
    body = data[data.index(b"\n", end) + 1 :]
    kind, count, names, in_vertex = "ascii", 0, [], False
    for line in head:
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            in_vertex = w[1] == "vertex"
            count = int(w[2]) if in_vertex else count
        elif w[:1] == ["property"] and in_vertex:
            names.append((w[2], _NUMBER[w[1]]))
    if kind == "ascii":
        rows = [line.split()[: len(names)] for line in body.decode("ascii").splitlines() if line.strip()][:count]
        return pd.DataFrame(np.array(rows, float).reshape(-1, len(names)), columns=[n for n, _ in names])
    order = "<" if kind == "binary_little_endian" else ">"
    table = np.frombuffer(body, np.dtype([(n, order + t) for n, t in names]), count)
    return pd.DataFrame({n: table[n].astype(table[n].dtype.newbyteorder("=")) for n, _ in names})


def format_ply(points: pd.DataFrame) -> bytes:
    """x, y, z as a binary PLY file of doubles."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(points)}\nproperty double x\nproperty double y\nproperty double z\nend_header\n"
    return head.encode() + np.ascontiguousarray(points[["x", "y", "z"]].to_numpy("<f8")).tobytes()


def read_ply(spark: SparkSession, path: str, scan_id: int = 0) -> DataFrame:
    """Points of PLY files (a path or glob); one file is one task's array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                yield parse_ply(bytes(data))[["x", "y", "z"]].astype(float).assign(scan_id=scan_id)[["scan_id", "x", "y", "z"]]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, POINTS)


def read_rooms(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Annotated rooms <root>/<room>/Annotations/<class>_<n>.txt: scan_id, room, class, x, y, z; classes may be left out."""
    from ..functions.geometry import annotation_class

    lines = spark.read.text(f"{root}/*/Annotations/*.txt").withColumn("file", F.input_file_name())
    p = F.split(F.trim("value"), r"\s+")
    clean = lambda k: F.regexp_replace(p[k], "[^0-9eE.+-]", "").try_cast("double")
    rows = lines.where(F.size(p) >= 3).select(F.lit(0).alias("scan_id"), F.regexp_extract("file", r"([^/]+)/Annotations/[^/]+$", 1).alias("room"), annotation_class(F.col("file")).alias("class"), clean(0).alias("x"), clean(1).alias("y"), clean(2).alias("z"))
    return rows.where(~F.col("class").isin(*exclude)) if exclude else rows


#: Structural and clutter classes of annotated rooms that do not mark their floor area.
NOT_INTERIOR = ("wall", "beam", "column", "door", "window", "clutter")


def parse_header(data: bytes) -> dict[str, int]:
    """Counts of a PLY header's elements."""
    return {m[1].decode(): int(m[2]) for m in re.finditer(rb"element (\w+) (\d+)", data[: data.index(b"end_header")])}


def png_bytes(image: np.ndarray) -> bytes:
    """An 8-bit grey (H, W) or RGB (H, W, 3) picture as PNG."""
    import zlib

    image = np.ascontiguousarray(image, np.uint8)
    height, width = image.shape[:2]
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    rows = b"".join(b"\0" + image[r].tobytes() for r in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def parse_png(data: bytes) -> np.ndarray:
    """An 8-bit grey or RGB picture without interlace; the five row filters are undone."""
    import zlib

    at, idat, head = 8, b"", b""
    while at < len(data):
        n, tag = struct.unpack(">I4s", data[at : at + 8])
        if tag == b"IHDR":
            head = data[at + 8 : at + 8 + n]
        elif tag == b"IDAT":
            idat += data[at + 8 : at + 8 + n]
        at += 12 + n
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", head)
    if depth != 8 or colour not in (0, 2):
        raise ValueError("only 8-bit grey and RGB")
    step = 3 if colour == 2 else 1
    raw, out = zlib.decompress(idat), np.zeros((height, width * step), np.int64)
    for r in range(height):
        line = np.frombuffer(raw, np.uint8, width * step, r * (width * step + 1) + 1).astype(np.int64)
        kind, up = raw[r * (width * step + 1)], out[r - 1] if r else np.zeros(width * step, np.int64)
        if kind in (0, 2):
            out[r] = (line + (up if kind == 2 else 0)) & 255
            continue
        for c in range(width * step):
            a, b, d = (out[r, c - step] if c >= step else 0), up[c], (up[c - step] if c >= step else 0)
            guess = a if kind == 1 else (a + b) // 2 if kind == 3 else min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2]
            out[r, c] = (line[c] + guess) & 255
    return out.astype(np.uint8).reshape((height, width) if step == 1 else (height, width, 3))
