"""Matching predictions to ground truth, and non-maximum suppression, as ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou

HIT = 0.5


def per_image(gt: DataFrame, preds: DataFrame, image: list[str]) -> DataFrame:
    """One row an image: gts (k, box) and preds (k, box, conf), each in order; images without either side have an empty list."""
    g = gt.groupBy(*image).agg(F.array_sort(F.collect_list(F.struct("k", "box"))).alias("gts"))
    p = preds.groupBy(*image).agg(F.array_sort(F.collect_list(F.struct("k", "box", "conf"))).alias("preds"))
    return g.join(p, image, "full").withColumn("gts", F.coalesce("gts", F.array())).withColumn("preds", F.coalesce("preds", F.array()))


def greedy(gts: Column, preds: Column, least: float = HIT) -> Column:
    """One to one: each ground truth in turn takes the free prediction of highest overlap (the first of equals) if it is a hit.

    An array with, for each ground truth, its k, box, overlap and the prediction taken (or null).
    """
    none = F.array().cast("array<struct<k:int,box:struct<x1:double,y1:double,x2:double,y2:double>,iou:double,pred:int>>")

    def step(done: Column, g: Column) -> Column:
        used = F.transform(F.filter(done, lambda d: d["pred"].isNotNull()), lambda d: d["pred"])
        free = F.filter(preds, lambda p: ~F.array_contains(used, p["k"]))
        scored = F.transform(free, lambda p: F.struct(iou(g["box"], p["box"]).alias("iou"), (-p["k"]).alias("nk")))

        def made(best: Column) -> Column:
            hit = F.coalesce(best["iou"] >= least, F.lit(False))
            return F.struct(g["k"].cast("int").alias("k"), g["box"].alias("box"), F.coalesce(best["iou"], F.lit(0.0)).alias("iou"), F.when(hit, -best["nk"]).cast("int").alias("pred"))

        return F.concat(done, F.transform(F.array(F.array_max(scored)), made))  # a lambda's argument is computed once

    return F.aggregate(gts, none, step)


def greedy_match(images: DataFrame, min_conf: float | Column = 0.0) -> DataFrame:
    """Adds matches and counts (n_gt, n_pred, hits, fp) to per-image rows; predictions below min_conf are left out."""
    kept = F.filter("preds", lambda p: p["conf"] >= min_conf)
    rows = images.withColumn("preds", kept).withColumn("matches", greedy(F.col("gts"), F.col("preds")))
    hits = F.size(F.filter("matches", lambda m: m["pred"].isNotNull()))
    return rows.withColumn("n_gt", F.size("gts")).withColumn("n_pred", F.size("preds")).withColumn("hits", hits).withColumn("fp", F.size("preds") - hits)


def best_overlap(gt: DataFrame, preds: DataFrame, image: list[str]) -> DataFrame:
    """Not exclusive: for each ground truth the highest overlap with any prediction, 0 without one."""
    p = preds.select(*image, F.col("box").alias("pbox"))
    rows = gt.join(p, image, "left").withColumn("o", F.when(F.col("pbox").isNotNull(), iou(F.col("box"), F.col("pbox"))).otherwise(0.0))
    return rows.groupBy(*image, "k", "box").agg(F.max("o").alias("best_iou"))


def suppress(boxes: Column, threshold: float) -> Column:
    """Non-maximum suppression of an array of (k, box, conf): by falling confidence, a box stays if it overlaps every kept one by less than the threshold."""
    order = lambda a, b: F.when(a["conf"] > b["conf"], -1).when(a["conf"] < b["conf"], 1).when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    ranked = F.array_sort(boxes, order)
    return F.aggregate(
        ranked,
        F.slice(ranked, 1, 0),
        lambda kept, b: F.when(F.exists(kept, lambda q: iou(q["box"], b["box"]) >= threshold), kept).otherwise(F.concat(kept, F.array(b))),
    )
