"""Tables for plots and prompts: colours of labels, centroids, hash-ordered samples, enlarged images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLOURS = 20


def label_colours(labels: DataFrame) -> DataFrame:
    """labels with hue (degrees) by the rank of the room, COLOURS in a circle; null for walls and exterior."""
    ids = labels.where("label >= 1").select("scan_id", "label").distinct().withColumn("hue", (F.dense_rank().over(Window.partitionBy("scan_id").orderBy("label")) - 1) % COLOURS * (360 // COLOURS))
    return labels.join(F.broadcast(ids), ["scan_id", "label"], "left")


def label_centroids(labels: DataFrame) -> DataFrame:
    return labels.where("label >= 1").groupBy("scan_id", "label").agg(F.avg("col").alias("x"), F.avg("row").alias("y"), F.count("*").alias("n"))


def sampled(rows: DataFrame, n: int, keys: list[str], by: list[str], seed: int = 0) -> DataFrame:
    """n rows of each group, those of least hash of `by`; the same rows on every run. The limit is the feature."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *by), *by)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def enlarged(cells: DataFrame, times: int) -> DataFrame:
    """Every cell as a square of times x times cells (nearest-neighbour enlargement)."""
    steps = F.sequence(F.lit(0), F.lit(times - 1))
    rest = [c for c in cells.columns if c not in ("row", "col")]
    wide = cells.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return wide.select(*rest, (F.col("row") * times + F.col("dy")).alias("row"), (F.col("col") * times + F.col("dx")).alias("col"))


def reduced(cells: DataFrame, times: int) -> DataFrame:
    """The cells whose first enlarged cell is set: undoes `enlarged`."""
    return cells.where((F.col("row") % times == 0) & (F.col("col") % times == 0)).withColumns({"row": F.floor(F.col("row") / times), "col": F.floor(F.col("col") / times)}).distinct()
