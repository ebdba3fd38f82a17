"""Small relational steps: moves, shares, resume, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def move_plan(frames: DataFrame, moves: DataFrame) -> DataFrame:
    """frames (.., video, split) whose video is to be in another split: with to_split."""
    return frames.join(moves.select("video", F.col("split").alias("to_split")), "video").where(F.col("split") != F.col("to_split"))


def move_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy(F.concat_ws(" -> ", "split", "to_split").alias("move")).agg(F.count(F.lit(1)).alias("n"))


def not_yet(images: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """What has no label yet (or isn't in the target yet)."""
    return images.join(labels.select(*on).distinct(), on, "left_anti")


def dimensions(images: DataFrame) -> DataFrame:
    return images.groupBy("width", "height").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width", "height")


def verdict_counts(frames: DataFrame) -> DataFrame:
    """Frames by split and verdict, one column a verdict."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return frames.groupBy("split").agg(n("keep"), n("review"), n("removed"))


def split_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.sum("boxes").alias("boxes"), F.count_if(F.col("boxes") == 0).alias("negatives"))


def negative_quota(images: DataFrame, negatives: int, share: float = 1.0) -> DataFrame:
    """How many negatives each split is to get: by its share of positive images."""
    per = images.groupBy("split").agg(F.count_if("positive").alias("positives"))
    total = per.agg(F.sum("positives").alias("all"))
    return per.join(F.broadcast(total), F.lit(True)).select("split", "positives", F.floor(F.col("positives") / F.col("all") * negatives * share).cast("bigint").alias("quota"))  # one row


def best_run(runs: DataFrame) -> DataFrame:
    """The run of best validation score; of equals the earliest."""
    return runs.orderBy(F.desc("score"), "seq").limit(1)
