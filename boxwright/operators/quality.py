"""Label quality: line checks, bounds, repair, and the validation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import repaired

EDGE, MOVED = 1e-6, 1e-9
_NAMES = ("center_x", "center_y", "width", "height")


def fields(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")


def line_error(line: Column, target: int = 0) -> Column:
    """What is wrong with a label line (the first failure wins), or null."""
    p = fields(line)
    n = F.size(p)
    cls = F.when(F.get(p, F.lit(0)).rlike(r"^[+-]?\d+$"), F.get(p, F.lit(0)).try_cast("int"))
    v = [F.get(p, F.lit(i)).try_cast("double") for i in range(1, 5)]
    cx, cy, w, h = v
    error = F.when(n != 5, F.format_string("expected 5 fields, got %d", n))
    error = error.when(cls.isNull() | v[0].isNull() | v[1].isNull() | v[2].isNull() | v[3].isNull(), "non-numeric field")
    error = error.when(cls != target, F.format_string(f"class id %d, expected {target}", cls))
    for name, x in zip(_NAMES, v, strict=True):
        error = error.when(~x.between(0.0, 1.0) | F.isnan(x), F.format_string(f"{name}=%.4f outside [0,1]", x))
    error = error.when((w <= 0) | (h <= 0), F.format_string("width/height must be > 0 (got %.4fx%.4f)", w, h))
    out = (cx - w / 2 < -EDGE) | (cx + w / 2 > 1 + EDGE) | (cy - h / 2 < -EDGE) | (cy + h / 2 > 1 + EDGE)
    return error.when(out, "box extends outside the image")


def moved(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Whether repair changes any part of a box."""
    r = repaired(cx, cy, w, h)
    return (F.abs(r["cx"] - cx) > MOVED) | (F.abs(r["cy"] - cy) > MOVED) | (F.abs(r["w"] - w) > MOVED) | (F.abs(r["h"] - h) > MOVED)


def label_line(box: Column, cls: int = 0) -> Column:
    return F.format_string(f"{cls} %.6f %.6f %.6f %.6f", box["cx"], box["cy"], box["w"], box["h"])


def repair_labels(labels: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Each file's text with out-of-bounds boxes cut back, all other lines as they are; touched says whether any was."""
    p = lambda line: fields(line)

    def fixed(line: Column) -> Column:
        v = [F.get(p(line), F.lit(i)).try_cast("double") for i in range(1, 5)]
        r = repaired(*v)
        new = F.format_string("%s %.6f %.6f %.6f %.6f", F.get(p(line), F.lit(0)), r["cx"], r["cy"], r["w"], r["h"])
        return F.when((F.size(p(line)) == 5) & F.coalesce(moved(*v), F.lit(False)), new).otherwise(line)

    out = labels.withColumn("__fixed", F.array_join(F.transform(F.split(F.col(text), "\n"), fixed), "\n"))
    return out.select(*key, F.col("__fixed").alias(text), (F.col("__fixed") != F.col(text)).alias("touched"))


def validation_report(images: DataFrame, lines: DataFrame) -> DataFrame:
    """By split: images, positives, negatives, missing labels, lines, boxes and bad lines.

    images (split, stem, label_present); lines (split, stem, line).
    """
    checked = lines.withColumn("error", line_error(F.col("line"))).where("trim(line) <> ''")
    per = checked.groupBy("split", "stem").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("error").isNull()).alias("n_boxes"))
    rows = images.join(per, ["split", "stem"], "left")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.coalesce("n_boxes", F.lit(0)) > 0).alias("positives"),
        F.count_if(F.col("label_present") & (F.coalesce("n_boxes", F.lit(0)) == 0)).alias("negatives"),
        F.count_if(~F.col("label_present")).alias("missing"),
        n("n_lines").alias("lines"),
        n("n_boxes").alias("boxes"),
        (n("n_lines") - n("n_boxes")).alias("bad"),
    )


def duplicate_groups(images: DataFrame) -> DataFrame:
    """Digests that occur more than once: copies, splits, and error (across splits) or warning (inside one)."""
    groups = images.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("split").alias("splits")).where("copies > 1")
    return groups.withColumn("level", F.when(F.col("splits") > 1, "error").otherwise("warning"))


def orphan_labels(labels: DataFrame, images: DataFrame) -> DataFrame:
    return labels.join(images, ["split", "stem"], "left_anti")


def box_extent(boxes: DataFrame, tiny: float = 0.01) -> DataFrame:
    """Least, greatest and mean sides of all boxes, and the share of tiny ones."""
    small = (F.col("w") < tiny) & (F.col("h") < tiny)
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("w", "h") for f in (F.min, F.max, F.avg)]
    return boxes.agg(*ends, (F.count_if(small) / F.count(F.lit(1))).alias("tiny_share"))
