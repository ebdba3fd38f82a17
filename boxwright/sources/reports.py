"""Readers of reports, review state and registries."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "split string, filename string, verdict string, yolo_conf string, motion_score string, reason string"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(split, filename, score): rows without a number are skipped; of a file's rows the last wins."""
    rows = spark.read.schema(REPORT).option("header", True).csv(path).withColumn("row_no", F.monotonically_increasing_id())
    rows = rows.withColumn("score", F.col("yolo_conf").try_cast("double")).where("score is not null and filename is not null")
    return rows.groupBy("split", "filename").agg(F.max_by("score", "row_no").alias("score"))


def review_order(frames: DataFrame, scores: DataFrame) -> DataFrame:
    """frames (split, filename, video, idx) in the order of review: lowest score first, unscored last."""
    rows = frames.join(scores, ["split", "filename"], "left").withColumn("score", F.coalesce("score", F.lit(99.0)))
    return rows.orderBy("score", "split", "video", "idx")


def review_state(path: str) -> dict:
    """The marks and position of a review; empty on any error."""
    try:
        state = json.loads(Path(path).read_text())
        return {"marks": dict(state["marks"]), "position": int(state["position"])}
    except (OSError, ValueError, KeyError, TypeError):
        return {"marks": {}, "position": 0}


def merge_marks(marks: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: the newest mark of each (split, name)."""
    both = marks.withColumn("n", F.lit(0)).unionByName(new.withColumn("n", F.lit(1)))
    return both.groupBy("split", "name").agg(F.max_by("mark", "n").alias("mark"))


def registry(spark: SparkSession, entries: list[tuple[str, str, str, str]]) -> DataFrame:
    """Known sources: name, kind, status, note."""
    return spark.createDataFrame(entries, "name string, kind string, status string, note string")


