"""Detection metrics over matched images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou, size_band
from ..functions.scores import precision_recall_f1
from .matching import HIT

# The thresholds of the sweep.
THRESHOLDS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60)


def area(b):
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def by_group(matched: DataFrame, group: str) -> DataFrame:
    """Images, ground truths, hits, false positives, recall and false positives an image, by group."""
    out = matched.groupBy(group).agg(F.count(F.lit(1)).alias("imgs"), *(F.sum(c).alias(a) for c, a in (("n_gt", "gt"), ("hits", "hit"), ("fp", "fp"))))
    return out.select(group, "imgs", "gt", "hit", "fp", F.coalesce(F.try_divide("hit", "gt"), F.lit(0.0)).alias("recall"), (F.col("fp") / F.col("imgs")).alias("fp_per_img"))


def by_size(matched: DataFrame) -> DataFrame:
    """Ground truths, hits and recall by size band."""
    each = matched.select(F.explode("matches").alias("m")).select(size_band(area(F.col("m.box"))).alias("band"), F.col("m.pred").isNotNull().alias("hit"))
    return each.groupBy("band").agg(F.count(F.lit(1)).alias("gt"), F.count_if("hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("gt"))


def recall_report(best: DataFrame, least: float = 0.5) -> DataFrame:
    """Recall and mean best overlap by size band, empty bands too, and over all (ALL has no mean)."""
    each = best.withColumn("band", size_band(area(F.col("box"))))
    rolled = each.rollup("band").agg(F.count(F.lit(1)).alias("gt"), F.count_if(F.col("best_iou") >= least).alias("hits"), F.avg("best_iou").alias("mean_iou"))
    bands = best.sparkSession.range(1).select(F.explode(F.array(*(F.lit(b) for b in ("small", "medium", "large", "ALL")))).alias("band"))
    found = rolled.select(F.coalesce("band", F.lit("ALL")).alias("band"), "gt", "hits", "mean_iou")
    out = bands.join(found, "band", "left")
    mean = F.when(F.col("band") != "ALL", F.col("mean_iou"))
    return out.select("band", F.coalesce("gt", F.lit(0)).alias("gt"), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce(F.try_divide("hits", "gt"), F.lit(0.0)).alias("recall"), mean.alias("mean_iou"))


def sweep(images: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Precision, recall and F1 at each confidence threshold, as greedy_match counts them.

    Only overlaps that are hits can be taken, so each image's overlaps are computed
    once, the hits kept without their boxes, and the thresholds fold over those.
    """
    near = F.transform("gts", lambda g: F.filter(F.transform("preds", lambda p: F.struct(iou(g["box"], p["box"]).alias("iou"), (-p["k"]).alias("nk"), p["conf"].alias("conf"))), lambda c: c["iou"] >= HIT))
    lean = images.select(F.size("gts").alias("n_gt"), F.transform("preds", lambda p: p["conf"]).alias("confs"), F.filter(near, lambda c: F.size(c) > 0).alias("near"))
    rows = lean.select("*", F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold"))
    taken = F.aggregate("near", F.transform(F.slice(F.flatten("near"), 1, 0), lambda c: c["nk"]), _take)
    each = rows.select("threshold", "n_gt", F.size(taken).alias("hits"), F.size(F.filter("confs", lambda c: c >= F.col("threshold"))).alias("n_pred"))
    counts = each.groupBy("threshold").agg(F.sum("n_gt").alias("n_gt"), F.sum("hits").alias("hits"), F.sum(F.col("n_pred") - F.col("hits")).alias("fp"))
    return counts.select("threshold", "n_gt", "hits", "fp", *precision_recall_f1(F.col("hits"), F.col("fp"), F.col("n_gt")))


def _take(used: Column, hits: Column) -> Column:
    """used and the best of the hits that are free and sure enough, if there is one."""
    free = F.filter(hits, lambda c: (c["conf"] >= F.col("threshold")) & ~F.array_contains(used, c["nk"]))
    best = F.filter(F.array(F.array_max(F.transform(free, lambda c: F.struct(c["iou"], c["nk"])))), lambda c: c.isNotNull())
    return F.concat(used, F.transform(best, lambda c: c["nk"]))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row of highest F1; of equals the lowest threshold."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1)


def by_background(matched: DataFrame, least: float = 0.4) -> DataFrame:
    """by_group over backgrounds: green where the share of green pixels (column green) is above ``least``."""
    return by_group(matched.withColumn("background", F.when(F.col("green") > least, "green").otherwise("other")), "background")
