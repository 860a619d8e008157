"""Room-level scores of a predicted label map against ground truth. Cells are (scan_id, row, col, pred, gt)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def truth_labels(annotations: DataFrame, transform: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Cells labelled by rooms in the order of their names; where rooms overlap the later one wins.

    A room without a point that is kept still has its number, so numbers name the same rooms whatever is excluded.
    """
    from .raster import cells

    kept = annotations.where(~F.col("class").isin(*exclude) | F.col("class").isNull()) if exclude else annotations
    names = annotations.select("scan_id", "room").distinct().withColumn("label", F.dense_rank().over(Window.partitionBy("scan_id").orderBy("room")))
    inside = cells(kept, transform).where("in_bounds").join(F.broadcast(names), ["scan_id", "room"])
    return inside.groupBy("scan_id", "row", "col").agg(F.max("label").alias("label"))


def compared(pred: DataFrame, gt: DataFrame, walls: DataFrame | None = None) -> DataFrame:
    """Cells (scan_id, row, col, pred, gt) of two label maps, 0 where one has none; cells of `walls` do not count."""
    cell = ["scan_id", "row", "col"]
    both = pred.select(*cell, F.col("label").alias("pred")).join(gt.select(*cell, F.col("label").alias("gt")), cell, "full").na.fill(0, ["pred", "gt"])
    return both if walls is None else both.join(walls.select(*cell).distinct(), cell, "left_anti")


def crosstab(cells: DataFrame) -> DataFrame:
    """Count of cells per (pred, gt)."""
    return cells.groupBy("scan_id", "pred", "gt").agg(F.count("*").alias("n"))


def overlaps(cells: DataFrame) -> DataFrame:
    """Per pair of rooms that meet: n, areas, iou, p (share of the prediction), g (share of the truth)."""
    pairs = crosstab(cells)
    pred = pairs.where("pred >= 1").groupBy("scan_id", "pred").agg(F.sum("n").alias("pred_area"))
    gt = pairs.where("gt >= 1").groupBy("scan_id", "gt").agg(F.sum("n").alias("gt_area"))
    both = pairs.where("pred >= 1 and gt >= 1").join(pred, ["scan_id", "pred"]).join(gt, ["scan_id", "gt"])
    n = F.col("n").cast("double")
    return both.select("scan_id", "pred", "gt", "n", "pred_area", "gt_area", (n / (F.col("pred_area") + F.col("gt_area") - F.col("n"))).alias("iou"), (n / F.col("pred_area")).alias("p"), (n / F.col("gt_area")).alias("g"))


def per_room(cells: DataFrame) -> DataFrame:
    """Per true room its best prediction by iou (the least id among equals; null at iou 0) and that iou."""
    rooms = cells.where("gt >= 1").select("scan_id", "gt").distinct()
    best = overlaps(cells).groupBy("scan_id", "gt").agg(F.max_by(F.struct("pred", "iou"), F.struct("iou", -F.col("pred"))).alias("b"))
    return rooms.join(best, ["scan_id", "gt"], "left").select("scan_id", "gt", F.col("b.pred").alias("best_pred"), F.coalesce(F.col("b.iou"), F.lit(0.0)).alias("iou"))


def room_scores(cells: DataFrame, match: float = 0.5) -> DataFrame:
    """Per scan: rooms, mean iou over true rooms, over-segmented true rooms and under-segmenting predictions."""
    close = overlaps(cells).where((F.col("p") >= match) | (F.col("g") >= match))
    over = close.groupBy("scan_id", "gt").count().groupBy("scan_id").agg(F.count_if(F.col("count") >= 2).alias("over_seg"))
    under = close.groupBy("scan_id", "pred").count().groupBy("scan_id").agg(F.count_if(F.col("count") >= 2).alias("under_seg"))
    counts = cells.groupBy("scan_id").agg(F.countDistinct(F.when(F.col("gt") >= 1, F.col("gt"))).alias("n_gt"), F.countDistinct(F.when(F.col("pred") >= 1, F.col("pred"))).alias("n_pred"))
    mean = per_room(cells).groupBy("scan_id").agg(F.avg("iou").alias("mean_iou"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return counts.join(mean, "scan_id", "left").join(over, "scan_id", "left").join(under, "scan_id", "left").select("scan_id", "n_gt", "n_pred", F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"), zero("over_seg"), zero("under_seg"))


def panoptic(cells: DataFrame) -> DataFrame:
    """tp, fp, fn, sq, rq, pq per scan; label maps give a pair above iou 0.5 at most one partner."""
    hits = overlaps(cells).where("iou > 0.5").groupBy("scan_id").agg(F.count("*").alias("tp"), F.avg("iou").alias("sq"))
    counts = room_scores(cells).select("scan_id", "n_gt", "n_pred")
    out = counts.join(hits, "scan_id", "left").select("scan_id", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("sq", F.lit(0.0)).alias("sq"), "n_gt", "n_pred")
    out = out.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})
    rq = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")), F.lit(0.0))
    return out.select("scan_id", "tp", "fp", "fn", "sq", rq.alias("rq"), (F.col("sq") * rq).alias("pq"))
