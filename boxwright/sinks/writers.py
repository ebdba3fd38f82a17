"""Writers: manifests, labels, reports and audit tables.  A plan is a lazy DataFrame; only these calls write."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import label_line


def write_manifest(plan: DataFrame, path: str) -> None:
    """The placed files by split; written anew each time."""
    plan.write.mode("overwrite").partitionBy("split").parquet(path)


def label_texts(boxes: DataFrame, key: list[str]) -> DataFrame:
    """One text a file from boxes (.., line_no, box), lines in order."""
    lines = boxes.select(*key, F.struct("line_no", label_line(F.col("box")).alias("line")).alias("s"))
    return lines.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("text"))


def write_yaml(path: str, root: str, splits: dict[str, str], names: list[str]) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump({"path": root, **splits, "nc": len(names), "names": names}, sort_keys=False))


def write_json(row: DataFrame, path: str) -> None:
    """A report of one row as one JSON document."""
    Path(path).write_text(json.dumps(json.loads(row.toJSON().first()), indent=2))


def report_rows(frames: DataFrame) -> DataFrame:
    """The frame report with fixed precision."""
    conf = F.format_string("%.3f", F.greatest("conf", F.lit(0.0)))
    return frames.select("split", "filename", "verdict", conf.alias("yolo_conf"), F.format_string("%.2f", F.coalesce("motion", F.lit(0.0))).alias("motion_score"), "reason")


def write_report(frames: DataFrame, path: str) -> None:
    report_rows(frames).write.mode("overwrite").option("header", True).csv(path)


def apply_verdicts(frames: DataFrame) -> DataFrame:
    """Where each frame lives after the move: removed and reviewed frames leave their split; prior keeps what restore needs."""
    return frames.withColumn("prior", F.col("split")).withColumn("split", F.when(F.col("verdict") == "keep", F.col("split")).otherwise(F.concat_ws("/", F.col("verdict"), F.col("split"))))


def restore(moved: DataFrame) -> DataFrame:
    return moved.withColumn("split", F.col("prior")).drop("prior")


def append_audit(added: DataFrame, path: str, run: str) -> None:
    """An added-negatives record; earlier runs stay."""
    added.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def rewrite_with_backup(spark: SparkSession, path: str, backup: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Replaces a table by its changed rows; a backup is written first, and the changed rows are read from it, so nothing is overwritten while read."""
    before = spark.read.parquet(path)
    before.write.mode("errorifexists").parquet(backup)
    change(spark.read.schema(before.schema).parquet(backup)).write.mode("overwrite").parquet(path)
