"""Dense images: crops of the best masks, on a background, square and resized. Arrays in Arrow batches, one image at a time."""

from __future__ import annotations

import struct
import uuid
import warnings
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import crop_filename, crop_id, source_path
from ..sources.config import CropSettings
from ..sources.paths import opened, qualified
from .models import mask_box

FILLS = {"gray": 128, "black": 0, "white": 255}
#: Bytes of crops that a task holds, about.
MOST_BYTES = 32 << 20
CROP = "path string, ts double, j int, is_fallback boolean, size int, pixels binary"


def to_rgb(x: Any) -> np.ndarray:
    """Height x width x 3, red first, from an array or a row of Spark's image source (blue first)."""
    if isinstance(x, np.ndarray):
        a = x
    else:
        get = x.get if isinstance(x, dict) else lambda k: getattr(x, k)
        h, w, c = get("height"), get("width"), get("nChannels")
        a = np.frombuffer(get("data"), np.uint8).reshape(h, w, c)
        a = a[..., ::-1] if c == 3 else a[..., 2::-1] if c == 4 else a
    if a.ndim == 2:
        a = a[..., None]
    return np.repeat(a, 3, 2) if a.shape[2] == 1 else np.ascontiguousarray(a[..., :3])


def score_masks(masks: list[np.ndarray], w: int, h: int) -> dict[int, float]:
    """Share of the image times centrality of each non-empty mask."""
    far = float(np.hypot(w / 2, h / 2))
    out = {}
    for i, m in enumerate(masks):
        ys, xs = np.nonzero(m)
        if len(xs):
            off = float(np.hypot(xs.mean() - w / 2, ys.mean() - h / 2))
            out[i] = len(xs) / (h * w) * (1.0 if far == 0 else 1.0 - off / far)
    return out


def best_masks(masks: list[np.ndarray], w: int, h: int, n: int) -> list[int]:
    """The n best masks, the later one first among equals; the first mask if all are empty."""
    scores = score_masks(masks, w, h)
    return [0] if not scores and masks else sorted(scores, key=lambda i: (scores[i], i), reverse=True)[:n]


@lru_cache(256)
def _lobes(n: int, size: int) -> np.ndarray:
    scale = n / size
    wide = max(1.0, scale)
    centre = (np.arange(size) + 0.5) * scale - 0.5
    d = (np.arange(n)[None] - centre[:, None]) / wide
    k = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0)
    return k / k.sum(1, keepdims=True)


def lanczos(image: np.ndarray, size: int) -> np.ndarray:
    """A square resize by a separable Lanczos filter of three lobes, widened when shrinking."""

    x = np.tensordot(_lobes(image.shape[0], size), image.astype(float), (1, 0))
    x = np.tensordot(_lobes(image.shape[1], size), x, (1, 1)).transpose(1, 0, 2)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


class ObjectExtractor:
    """Images to square crops of their best masks."""

    def __init__(self, generator, settings: CropSettings | None = None, **changes: Any) -> None:
        self.generator, self.s = generator, settings or CropSettings(**changes)

    @classmethod
    def from_config(cls, path: str, generator) -> ObjectExtractor:
        return cls(generator, CropSettings.load(path))

    def _noise(self, shape: tuple, key: int) -> np.ndarray:
        r = np.random.default_rng((self.s.seed, key))
        return np.clip(r.normal(self.s.noise_mean, self.s.noise_std, shape), 0, 255).astype(np.uint8)

    def canvas(self, h: int, w: int, key: int = 0) -> np.ndarray:
        return self._noise((h, w, 3), key) if self.s.background == "noise" else np.full((h, w, 3), FILLS[self.s.background], np.uint8)

    def fill(self, image: np.ndarray, mask: np.ndarray, key: int = 0) -> np.ndarray:
        """The image with all but the mask replaced by the background."""
        return np.where(np.asarray(mask, bool)[..., None], image, self.canvas(*mask.shape, key=key))

    def crop(self, image: np.ndarray, mask: np.ndarray, key: int = 0) -> np.ndarray:
        h, w = mask.shape
        x0, y0, x1, y1 = (int(v) for v in mask_box(mask))
        dx, dy = (max(1, int((b - a) * self.s.margin)) for a, b in ((x0, x1), (y0, y1)))
        x0, y0, x1, y1 = max(0, x0 - dx), max(0, y0 - dy), min(w, x1 + dx), min(h, y1 + dy)
        cut = self.fill(image, mask, key)[y0:y1, x0:x1]
        side = max(cut.shape[:2])
        out = self.canvas(side, side, key + 1)
        top, left = (side - cut.shape[0]) // 2, (side - cut.shape[1]) // 2
        out[top : top + cut.shape[0], left : left + cut.shape[1]] = cut
        return lanczos(out, self.s.output_size)

    def one(self, image: np.ndarray, key: int = 0) -> tuple[list[np.ndarray], bool]:
        """The crops of an image, and whether it had to stand for itself; noise is drawn anew for each key and crop."""
        image = to_rgb(image)
        masks = self.generator.invoke(image)["masks"]
        chosen = [i for i in best_masks(masks, image.shape[1], image.shape[0], self.s.top_n) if np.any(masks[i])]
        if not chosen:
            warnings.warn("no masks: the whole image is used", stacklevel=2)
            return [lanczos(image, self.s.output_size)], True
        return [self.crop(image, masks[i], 2 * (key + i)) for i in chosen], False

    def extract(self, images: np.ndarray | list) -> list:
        """One image's crops, or a list of such lists."""
        if isinstance(images, list):
            for i, x in enumerate(images):
                if not isinstance(x, np.ndarray):
                    raise TypeError(f"image {i} is a {type(x).__name__}, not an array")
            return [self.one(x)[0] for x in images]
        if not isinstance(images, np.ndarray):
            raise TypeError(f"an array or a list of arrays is needed, not {type(images).__name__}")
        return self.one(images)[0]

    def crops(self, images: DataFrame) -> DataFrame:
        """(path, ts, image) to one row a crop, with its id and file name; pixels are size x size x 3, red first."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for path, ts, image in zip(b["path"], b["ts"], b["image"], strict=True):
                    made, whole = self.one(image, zlib.crc32(path.encode()) << 32)
                    rows += [(path, ts, j, whole, c.shape[0], c.tobytes()) for j, c in enumerate(made)]
                    if len(rows) * 3 * self.s.output_size**2 >= MOST_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

        names = [c.split()[0] for c in CROP.split(", ")]
        out = images.select("path", "ts", "image").mapInPandas(run, CROP)
        return out.withColumn("id", crop_id(F.col("path"), F.col("j"))).withColumn("file", crop_filename(F.col("ts"), F.col("j")))


def png(image: np.ndarray) -> bytes:
    """A height x width x 3 array as a PNG file."""
    h, w = image.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def write_crops(crops: DataFrame, folder: str) -> DataFrame:
    """Writes each crop as a PNG unless its file exists; returns (id, path, timestamp) of all crops, for indexing.

    A folder without a scheme lies where Spark resolves it. A file appears complete: it is renamed into place.
    """
    at, folder = qualified(crops.sparkSession, folder), folder.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = opened(at)
        files.create_dir(base, recursive=True)
        for b in batches:
            for name, size, pixels in zip(b["file"], b["size"], b["pixels"], strict=True):
                if files.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
                    part = f"{base}/.{uuid.uuid4().hex}.part"
                    with files.open_output_stream(part) as out:
                        out.write(png(np.frombuffer(pixels, np.uint8).reshape(size, size, 3)))
                    files.move(part, f"{base}/{name}")
            yield pd.DataFrame({"id": b["id"], "path": folder + "/" + b["file"], "timestamp": b["ts"]})

    return crops.mapInPandas(run, "id string, path string, timestamp double")


def placeholder(size: int = 224, level: int = 80) -> np.ndarray:
    """Stands in for an original that is gone."""
    return np.full((size, size, 3), level, np.uint8)


ORIGINAL = "height int, width int, pixels binary, lost boolean"


def with_originals(hits: DataFrame, originals: DataFrame, ident: str = "id") -> DataFrame:
    """Crop hits with original: the image (path, image) that each was cut from, red first; a grey placeholder, marked lost, for one that is gone."""
    spark = hits.sparkSession
    wanted = hits.withColumn("__path", source_path(F.col(ident)))
    found = originals.join(wanted.select(F.col("__path").alias("path")), "path", "left_semi").where("image is not null").dropDuplicates(["path"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, x in zip(b["path"], b["image"], strict=True):
                a = to_rgb(x)
                rows.append({"path": path, "height": a.shape[0], "width": a.shape[1], "pixels": a.tobytes(), "lost": False})
            yield pd.DataFrame(rows, columns=["path", "height", "width", "pixels", "lost"])

    images = found.select("path", "image").mapInPandas(run, f"path string, {ORIGINAL}")
    grey = placeholder()
    gone = spark.createDataFrame([(grey.shape[0], grey.shape[1], grey.tobytes(), True)], ORIGINAL)
    joined = wanted.join(images.withColumnRenamed("path", "__path"), "__path", "left").crossJoin(F.broadcast(gone.select(F.struct("*").alias("__gone"))))  # one row
    own = F.when(F.col("pixels").isNotNull(), F.struct("height", "width", "pixels", "lost")).otherwise(F.col("__gone"))
    return joined.select(*(F.col(f"`{c}`") for c in hits.columns), own.alias("original"))
