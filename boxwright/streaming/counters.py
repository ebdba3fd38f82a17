"""Stateful streams over detections: running counters and rate-limited capture, one state a source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FPS_FRAMES = 30
COUNTERS = "source string, frame_no bigint, seen bigint, hit bigint, hit_rate double, fps double"
CAPTURES = "source string, frame_no bigint, t double, saved bigint"


def running_counters(frames: DataFrame) -> DataFrame:
    """frames (source, frame_no, seconds, n) to the counters after each frame: seen, hit, hit rate and the mean of the last frame rates."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, hit, rates = state.get if state.exists else (0, 0, [])
        rates, out = list(rates), []
        for row in pd.concat(batches).sort_values("frame_no").itertuples():
            seen += 1
            hit += int(row.n > 0)
            if row.seconds > 0:
                rates = [*rates, 1.0 / row.seconds][-FPS_FRAMES:]
            out.append((key[0], row.frame_no, seen, hit, hit / seen, sum(rates) / len(rates) if rates else None))
        state.update((seen, hit, rates))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in COUNTERS.split(", ")])

    return frames.groupBy("source").applyInPandasWithState(step, COUNTERS, "seen bigint, hit bigint, rates array<double>", "append", GroupStateTimeout.NoTimeout)


def rate_limited(frames: DataFrame, gap: float = 0.15, most: int = 300) -> DataFrame:
    """Frames (source, frame_no, t) at least ``gap`` seconds after the last one taken, up to ``most`` a source."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, saved = state.get if state.exists else (float("-inf"), 0)
        out = []
        for row in pd.concat(batches).sort_values(["t", "frame_no"]).itertuples():
            if saved < most and row.t - last >= gap:
                last, saved = row.t, saved + 1
                out.append((key[0], row.frame_no, row.t, saved))
        state.update((last, saved))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in CAPTURES.split(", ")])

    return frames.groupBy("source").applyInPandasWithState(step, CAPTURES, "last double, saved bigint", "append", GroupStateTimeout.NoTimeout)


def detect_stream(frames: DataFrame, detector, schema: str) -> DataFrame:
    """Frame-at-a-time detection with a pluggable model; works on batch and streaming frames."""
    return frames.mapInPandas(detector, schema)
