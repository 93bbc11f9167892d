"""Masks as pixel rows (image, mask, x, y): score, choice and crop geometry in plain aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import mask_score, padded_box, square


def measured(pixels: DataFrame, *, image: str = "image_id", mask: str = "mask_idx") -> DataFrame:
    """Each non-empty mask's area, centroid and extent. Pixel counts combine before the shuffle; an empty mask has no rows."""
    x, y = F.col("x"), F.col("y")
    return pixels.groupBy(image, mask).agg(F.count(F.lit(1)).alias("n_px"), F.avg(x.cast("double")).alias("cx"), F.avg(y.cast("double")).alias("cy"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def scored(masks: DataFrame, images: DataFrame, *, image: str = "image_id") -> DataFrame:
    """measured() with the images' w and h, and score: share of the image times centrality."""
    joined = masks.join(images, image)
    return joined.withColumn("score", mask_score(F.col("n_px"), F.col("cx"), F.col("cy"), F.col("w"), F.col("h")))


def best(scores: DataFrame, n: int = 1, *, image: str = "image_id", mask: str = "mask_idx") -> DataFrame:
    """Each image's n best masks with j, their position from 0; of equal scores the later mask comes first."""
    order = Window.partitionBy(image).orderBy(F.desc("score"), F.desc(mask))
    return scores.withColumn("j", F.row_number().over(order) - 1).where(F.col("j") < n)


def crops(chosen: DataFrame, margin: float = 0.1) -> DataFrame:
    """The padded crop box of each mask, and how it is centred in its square."""
    box = padded_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("w"), F.col("h"), margin)
    return chosen.withColumn("box", box).withColumn("square", square(F.col("box")))


def with_fallback(images: DataFrame, chosen: DataFrame, *, image: str = "image_id") -> DataFrame:
    """Every image: its crops, or one row marked is_fallback that stands for the whole image."""
    return images.select(image).join(chosen, image, "left").withColumn("is_fallback", F.col("j").isNull()).withColumn("j", F.coalesce("j", F.lit(0)))


def of_quality(masks: DataFrame, pred_iou: str = "pred_iou", stability: str = "stability", pred_iou_thresh: float = 0.88, stability_score_thresh: float = 0.95) -> DataFrame:
    """Masks whose predicted overlap and stability both lie above their thresholds."""
    return masks.where((F.col(pred_iou) > pred_iou_thresh) & (F.col(stability) > stability_score_thresh))
