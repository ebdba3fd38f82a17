"""Box geometry as column expressions; a box is a struct of four doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL, MEDIUM = 32.0 * 32.0, 96.0 * 96.0
LEAST_SIDE = 1e-6


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def to_pixels(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def normalised(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct(cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


def from_pixels(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Corners in any order, clipped to the image; null if a side is under a pixel."""
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    a, b = inside(F.least(x1, x2), width), inside(F.greatest(x1, x2), width)
    c, d = inside(F.least(y1, y2), height), inside(F.greatest(y1, y2), height)
    out = normalised((a + b) / 2 / width, (c + d) / 2 / height, (b - a) / width, (d - c) / height)
    return F.when((b - a >= 1) & (d - c >= 1), out)


def _clipped(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.greatest(zero, cx - w / 2), F.greatest(zero, cy - h / 2), F.least(one, cx + w / 2), F.least(one, cy + h / 2)


def repaired(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Cut back to the image; sides of a box that lies outside come out negative."""
    x1, y1, x2, y2 = _clipped(cx, cy, w, h)
    return normalised((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)


def ingested(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Cut back to the image; null if a side all but vanishes or a number is not finite."""
    x1, y1, x2, y2 = _clipped(cx, cy, w, h)
    finite = ~(F.isnan(cx) | F.isnan(cy) | F.isnan(w) | F.isnan(h))
    return F.when(finite & (x2 - x1 > LEAST_SIDE) & (y2 - y1 > LEAST_SIDE), repaired(cx, cy, w, h))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where there is no union."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    common = side("x1", "x2") * side("y1", "y2")
    area = lambda q: (q["x2"] - q["x1"]) * (q["y2"] - q["y1"])
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def size_band(area: Column) -> Column:
    return F.when(area < SMALL, "small").when(area < MEDIUM, "medium").otherwise("large")


def shifted(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def clipped(b: Column, width: Column, height: Column) -> Column:
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    return box(inside(b["x1"], width), inside(b["y1"], height), inside(b["x2"], width), inside(b["y2"], height))


def axis_origins(length: Column, tile: int, overlap: float) -> Column:
    """Tile origins along one side; the last tile lies flush with the edge."""
    step = max(1, int(tile * (1 - overlap)))
    regular = F.sequence(F.lit(0), length - tile, F.lit(step))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.array_union(regular, F.array(length - tile)))


def tile_origins(width: Column, height: Column, tile: int, overlap: float) -> Column:
    """All tile origins, row by row, as structs (x, y)."""
    xs, ys = axis_origins(width, tile, overlap), axis_origins(height, tile, overlap)
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def grid_tiles(width: Column, height: Column, rows: int = 2, cols: int = 3, overlap: float = 0.25) -> Column:
    """An even grid, each cell widened on all sides, then the whole frame."""
    tw, th = width / cols, height / rows
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(rows * cols - 1)),
        lambda i: F.struct(
            F.greatest(F.lit(0), (i % cols * tw - tw * overlap).cast("int")).alias("x1"),
            F.greatest(F.lit(0), (F.floor(i / cols) * th - th * overlap).cast("int")).alias("y1"),
            F.least(width, ((i % cols + 1) * tw + tw * overlap).cast("int")).alias("x2"),
            F.least(height, ((F.floor(i / cols) + 1) * th + th * overlap).cast("int")).alias("y2"),
        ),
    )
    whole = F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), width.alias("x2"), height.alias("y2"))
    return F.concat(cells, F.array(whole))
