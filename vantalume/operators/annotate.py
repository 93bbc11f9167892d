"""Annotations: drawing instructions as columns, and masks blended into pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PALETTE, label_text, palette, text_anchor
from .images import to_rgb


def instructions(detected: DataFrame, most: int = 12) -> DataFrame:
    """One row a box of each detected row: pos, whole-number box, colour, label text and where it stands. Rows without boxes have none."""
    zipped = F.arrays_zip("boxes", "scores", F.coalesce("labels", F.transform("scores", lambda s: F.lit(""))).alias("labels"))
    rows = detected.select("id", F.posexplode(zipped).alias("pos", "d")).withColumn("box", F.transform("d.boxes", lambda v: v.cast("int")))
    return rows.select("id", "pos", "box", palette(F.col("pos")).alias("colour"), label_text(F.col("d.labels"), F.col("d.scores"), most).alias("text"), text_anchor(F.element_at("box", 1), F.element_at("box", 2)).alias("anchor"))


def blend(image: np.ndarray, masks: list[np.ndarray], alpha: int = 120) -> np.ndarray:
    """Masks laid over an image in the palette's colours, one after the other."""
    out = image.astype(float)
    a = alpha / 255
    for i, m in enumerate(masks):
        m = np.asarray(m, bool)
        out[m] = out[m] * (1 - a) + np.array(PALETTE[i % len(PALETTE)], float) * a
    return np.rint(out).astype(np.uint8)


def outlined(image: np.ndarray, boxes: list[list[float]], width: int = 1) -> np.ndarray:
    """An image with rectangles, drawn inwards; without boxes it is unchanged."""
    out = image.copy()
    h, w = out.shape[:2]
    for i, box in enumerate(boxes):
        x0, y0, x1, y1 = (int(v) for v in box)
        x0, x1, y0, y1 = max(0, x0), min(w - 1, x1), max(0, y0), min(h - 1, y1)
        if x0 > x1 or y0 > y1:
            continue
        inside = out[y0 : y1 + 1, x0 : x1 + 1]
        edge = np.ones(inside.shape[:2], bool)
        edge[width : inside.shape[0] - width, width : inside.shape[1] - width] = False
        inside[edge] = PALETTE[i % len(PALETTE)]
    return out


#: A face of 3 x 5 dots: of each character its five lines, bits from the left. Lower case is drawn as upper case, others as a block.
GLYPHS = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,:-_/+()", "25755 65656 34443 65556 74647 74644 34553 55755 72227 11152 55655 44447 57755 65555 25552 65644 25531 65655 34216 72222 55557 55552 55775 55255 55222 71247 75557 26227 71747 71711 55711 74717 74757 71111 75757 75717 00000 00002 00024 02020 00700 00007 11244 02720 12221 42224".split(), strict=True))


def lettered(image: np.ndarray, text: str, x: int, y: int, size: int = 2, colour: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """An image with text whose upper left corner stands at (x, y); what lies outside is cut off."""
    lines = np.zeros((5, 4 * len(text)), bool)
    for i, c in enumerate(text.upper()):
        for k, bits in enumerate(GLYPHS.get(c, "77777")):
            lines[k, 4 * i : 4 * i + 3] = [int(bits) >> 2 & 1, int(bits) >> 1 & 1, int(bits) & 1]
    dots = np.repeat(np.repeat(lines, size, 0), size, 1)
    out = image.copy()
    ys, xs = np.nonzero(dots)
    ys, xs = ys + y, xs + x
    there = (ys >= 0) & (ys < out.shape[0]) & (xs >= 0) & (xs < out.shape[1])
    out[ys[there], xs[there]] = colour
    return out


def written(score: float, label: object, most: int) -> str:
    """What stands beside a box: the label's first characters and the score."""
    return f"{str(label)[:most]} {float(score):.2f}"


def annotate(image: np.ndarray, boxes: list, scores: list, labels: list | str, masks: list | None = None, alpha: int = 110, most: int | None = None) -> np.ndarray:
    """An image with masks, boxes and their texts in one call; labels is one text for all, or one each. Without masks, boxes alone are drawn.

    Texts have at most 12 characters of a label where there are masks and 14 where there are not.
    """
    out = blend(image, masks, alpha) if masks else image.copy()
    out = outlined(out, boxes, 2)
    most = (12 if masks else 14) if most is None else most
    for i, (box, score) in enumerate(zip(boxes, scores, strict=False)):
        label = labels if isinstance(labels, str) else labels[i]
        out = lettered(out, written(score, label, most), int(box[0]) + 3, max(int(box[1]) - 18, 0))
    return out


def annotated(detected: DataFrame, image: str = "image") -> DataFrame:
    """search.detect()'s rows with their image: annotated, the drawn image as height, width and pixels (red first)."""
    kept = [f for f in detected.schema.fields if f.name != image]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "annotated struct<height:int,width:int,pixels:binary>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            drawn = []
            for x, boxes, scores, labels, masks in zip(b[image], b["boxes"], b["scores"], b["labels"], b["masks"], strict=True):
                shapes = [np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["h"] * m["w"]).reshape(m["h"], m["w"]).astype(bool) for m in masks] if masks is not None else None
                boxes, scores = [] if boxes is None else list(boxes), [] if scores is None else list(scores)
                a = annotate(to_rgb(x), boxes, scores, [""] * len(boxes) if labels is None else list(labels), shapes)
                drawn.append({"height": a.shape[0], "width": a.shape[1], "pixels": a.tobytes()})
            yield b.drop(columns=[image]).assign(annotated=drawn)

    return detected.mapInPandas(run, schema)
