"""Signals over the frames of a video, in frame order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import reason, strong, verdict


def ordered(video: list[str], order: list[str]):
    return Window.partitionBy(*video).orderBy(*order)


def neighbours(df: DataFrame, video: list[str], order: list[str], col: str) -> DataFrame:
    w = ordered(video, order)
    return df.withColumn("prev", F.lag(col).over(w)).withColumn("next", F.lead(col).over(w))


def near_strong(df: DataFrame, video: list[str], order: list[str], flag: str, guard: int = 2) -> Column:
    """Whether another frame within so many rows before or after is strong."""
    w = ordered(video, order)
    before = F.bool_or(flag).over(w.rowsBetween(-guard, -1))
    after = F.bool_or(flag).over(w.rowsBetween(1, guard))
    return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))


def filter_frames(frames: DataFrame, video: list[str], order: list[str], guard: int = 2) -> DataFrame:
    """frames (.., conf, motion) with strong, near, verdict and reason: all are scored, then decided with their neighbours."""
    rows = frames.withColumn("strong", strong(F.col("conf"), F.col("motion")))
    rows = rows.withColumn("near", near_strong(rows, video, order, "strong", guard))
    conf, motion = F.col("conf"), F.coalesce("motion", F.lit(0.0))
    return rows.withColumn("verdict", verdict(conf, motion, F.col("near"))).withColumn("reason", reason(conf, motion, F.col("near")))


def every_step(df: DataFrame, index: str, step: int) -> DataFrame:
    return df.where(F.col(index) % step == 0)


def rolling_fps(df: DataFrame, source: list[str], order: list[str], seconds: str, frames: int = 30) -> Column:
    """Mean of the last so many frame rates."""
    return F.avg(F.try_divide(F.lit(1.0), F.col(seconds))).over(ordered(source, order).rowsBetween(-(frames - 1), 0))


def running_hit_rate(source: list[str], order: list[str], hit: str) -> Column:
    w = ordered(source, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.col(hit).cast("int")).over(w) / F.count(F.lit(1)).over(w)


def min_gap(df: DataFrame, source: list[str], time: str, key: str, gap: float) -> DataFrame:
    """Rows at least ``gap`` after the last one taken (of each source); rows without a time are left out.

    Each source streams through a task in time order, of which only the last time
    taken is held; between two rows taken the others are passed over by bisection.
    """
    rows = df.where(F.col(time).isNotNull()).select(*source, key, time)
    placed = rows.repartition(*source).sortWithinPartitions(*source, time, key)
    n = len(source)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_source, last = None, None
        for batch in batches:
            times = batch.column(n + 1).cast(pa.float64()).to_numpy(zero_copy_only=False)
            taken, start = [], 0
            for name, run in groupby(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True)):
                end = start + sum(1 for _ in run)
                if name != open_source:
                    open_source, last = name, None
                at = start
                while at < end:
                    if last is not None:
                        first = at
                        at += int(np.searchsorted(times[at:end], last + gap))
                        while at > first and times[at - 1] - last >= gap:  # what rounding of the sum passed over
                            at -= 1
                        while at < end and not times[at] - last >= gap:
                            at += 1
                    if at < end:
                        taken.append(at)
                        last = times[at]
                        at += 1
                start = end
            yield batch.take(pa.array(taken, pa.int64()))

    return placed.mapInArrow(pick, rows.schema)
