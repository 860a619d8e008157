"""Shared parts of the vector searches: valid vectors, shards of bounded size, query blocks, merging of answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(v: Column, *, nonzero: bool) -> Column:
    """Neither null nor empty, no null or non-finite component and, if asked for, not the zero vector."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, odd), F.lit(True))
    return ok & F.exists(v, lambda x: x != 0) if nonzero else ok


def only_vectors(table: DataFrame, id_col: str, vec_col: str, *, nonzero: bool) -> DataFrame:
    """id and v of the rows that take part, one per id: of several vectors of an id the least counts."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("v"), nonzero=nonzero))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def common_length(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and the length that all their vectors v have."""
    n, low, high = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} components")
    return n, low or 0


def matrix(column) -> np.ndarray:
    """A list column of equally long vectors as rows of doubles."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = flat.chunk(0) if hasattr(flat, "num_chunks") else flat
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if scores.dtype == object:  # Python integers
        return np.array(sorted(range(len(scores)), key=lambda p: (-scores[p], ids[p]))[:k], np.int64)
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, ties to smaller vec_id.

    The rows of a query are few (k per shard at most) and the limit is applied before the shuffle too.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
