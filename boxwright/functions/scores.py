"""Scores and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence at which a frame is kept or reviewed, and what a frame without neighbours scores.
CONF_KEEP, CONF_REVIEW = 0.10, 0.04
MOTION_KEEP, MOTION_REVIEW = 1.5, 0.35
NO_NEIGHBOUR = 1.5
PAN = 0.35
LEAST_AREA, MOST_AREA = 12, 20000
PROXY_CLASSES = ("airplane", "bird", "kite", "frisbee", "sports ball", "boat")


def motion_score(fill: Column, aspect: Column, changed: Column) -> Column:
    return 4 * fill * aspect * (1 - F.least(F.lit(1.0), changed / PAN))


def blob_usable(area: Column, changed: Column) -> Column:
    return area.between(LEAST_AREA, MOST_AREA) & (changed <= PAN)


def proposal_score(area: Column, fill: Column, aspect: Column) -> Column:
    return area * fill * (0.5 + aspect)


def frame_score(motion: Column, sharpness: Column) -> Column:
    return F.coalesce(motion, F.lit(0.0)) + 0.30 * F.sqrt(sharpness)


def strong(conf: Column, motion: Column) -> Column:
    return F.coalesce((conf >= CONF_KEEP) | (F.coalesce(motion, F.lit(0.0)) >= MOTION_KEEP), F.lit(False))


def verdict(conf: Column, motion: Column, near: Column) -> Column:
    """keep, review or removed; a frame that could not be read (a negative confidence) is reviewed."""
    return (
        F.when(conf < 0, "review").when(conf >= CONF_KEEP, "keep").when(motion >= MOTION_KEEP, "keep")
        .when((conf >= CONF_REVIEW) | (motion >= MOTION_REVIEW), "review").when(near, "review").otherwise("removed")
    )


def reason(conf: Column, motion: Column, near: Column) -> Column:
    return (
        F.when(conf < 0, F.lit("unreadable file"))
        .when(conf >= CONF_KEEP, F.format_string("yolo %.2f", conf))
        .when(motion >= MOTION_KEEP, F.format_string("motion %.2f", motion))
        .when((conf >= CONF_REVIEW) | (motion >= MOTION_REVIEW), F.format_string("weak (yolo %.2f, motion %.2f)", conf, motion))
        .when(near, F.lit("no evidence, but a neighbouring frame has a drone"))
        .otherwise(F.lit("no evidence"))
    )


def precision_recall_f1(hits: Column, fp: Column, gt: Column) -> list[Column]:
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = share(hits, hits + fp), share(hits, gt)
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]
