"""Box and crop geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def centrality(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """1 at the image's centre, 0 at its corners; 1 for an image without extent."""
    x, y = w.cast("double") / 2, h.cast("double") / 2
    far = F.sqrt(x * x + y * y)
    return F.when(far == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) / far)


def mask_score(n_px: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return n_px.cast("double") / (h.cast("double") * w.cast("double")) * centrality(cx, cy, w, h)


def padded_box(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column, margin: float) -> Column:
    """A box (greatest coordinates inclusive) widened by a margin of its own extent, at least one pixel, within the image."""
    dx = F.greatest(F.lit(1), ((x1 - x0) * F.lit(margin)).cast("int"))
    dy = F.greatest(F.lit(1), ((y1 - y0) * F.lit(margin)).cast("int"))
    return F.struct(F.greatest(F.lit(0), x0 - dx).alias("x0"), F.greatest(F.lit(0), y0 - dy).alias("y0"), F.least(w, x1 + dx).alias("x1"), F.least(h, y1 + dy).alias("y1"))


def square(box: Column) -> Column:
    """The square a crop is centred on, and the crop's offsets in it."""
    cw, ch = box["x1"] - box["x0"], box["y1"] - box["y0"]
    side = F.greatest(cw, ch)
    return F.struct(cw.alias("cw"), ch.alias("ch"), side.alias("side"), F.floor((side - cw) / 2).cast("int").alias("left"), F.floor((side - ch) / 2).cast("int").alias("top"))
