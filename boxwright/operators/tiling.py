"""Tiled inference: tile, detect, shift back, suppress, clip."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clipped, shifted, tile_origins
from ..functions.scores import PROXY_CLASSES
from .matching import suppress

#: A detector gets frames of (image, tile, x, y, size, content..) and yields (image, tile, k, x1, y1, x2, y2, conf) in tile coordinates.
Detector = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def tiles(images: DataFrame, tile: int = 640, overlap: float = 0.25) -> DataFrame:
    """images (image, width, height) with a row for each tile: tile number, x, y."""
    return images.select("*", F.posexplode(tile_origins(F.col("width"), F.col("height"), tile, overlap)).alias("tile", "o")).select("*", "o.x", "o.y").drop("o")


def merge_tiles(detections: DataFrame, tiled: DataFrame, images: DataFrame, iou: float = 0.5) -> DataFrame:
    """Detections (image, tile, k, box, conf) in frame coordinates, suppressed and then clipped: (image, k, box, conf).

    Tile -1 stands for the whole frame.
    """
    origins = tiled.select("image", "tile", "x", "y")
    rows = detections.join(origins, ["image", "tile"], "left").withColumn("box", shifted(F.col("box"), F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))))
    listed = rows.groupBy("image").agg(F.collect_list(F.struct((F.col("tile") * 100000 + F.col("k")).cast("int").alias("k"), "box", "conf")).alias("d"))
    kept = listed.select("image", F.explode(suppress(F.col("d"), iou)).alias("b")).join(images.select("image", "width", "height"), "image")
    return kept.select("image", "b.k", clipped(F.col("b.box"), F.col("width").cast("double"), F.col("height").cast("double")).alias("box"), "b.conf")


def predict_tiled(images: DataFrame, detector: Detector, tile: int = 640, overlap: float = 0.25, conf: float = 0.25, iou: float = 0.5, full_frame: bool = True) -> DataFrame:
    """Detections of a pluggable model over all tiles, and the whole frame, of each image."""
    tiled = tiles(images, tile, overlap)
    work = tiled.withColumn("size", F.lit(tile))
    if full_frame:
        whole = images.select("*", F.lit(-1).alias("tile"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.greatest("width", "height").alias("size"))
        work = work.unionByName(whole)
    found = work.mapInPandas(detector, "image string, tile int, k int, x1 double, y1 double, x2 double, y2 double, conf double")
    boxed = found.where(F.col("conf") >= conf).select("image", "tile", "k", F.struct("x1", "y1", "x2", "y2").alias("box"), "conf")
    return merge_tiles(boxed, tiled, images, iou)


def proxy_scores(preds: DataFrame, classes: tuple[str, ...] = PROXY_CLASSES) -> DataFrame:
    """(image, conf, label): the best proxy detection over all tiles, the first of equals."""
    hit = preds.where(F.col("label").isin(*classes)).select("image", F.struct((-F.col("conf")).alias("c"), "tile", "k", "label").alias("s"))
    best = hit.groupBy("image").agg(F.min("s").alias("s"))
    return preds.select("image").distinct().join(best, "image", "left").select("image", F.coalesce(-F.col("s.c"), F.lit(0.0)).alias("conf"), F.col("s.label").alias("label"))
