"""Contracts of the networks that plug in, and small deterministic stand-ins.

No pretrained weights are here: an encoder, a detector and a mask generator made elsewhere take the stand-ins' place.
Images reach them as arrays of height x width x 3 (red first), or as bytes for encoders that decode themselves.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from typing import Any

import numpy as np

from ..sources.config import model_settings


class Model(ABC):
    """A model loads once, when it is made; its settings come from one section of a YAML file."""

    config_key: str | None = None

    @classmethod
    def from_config(cls, path: str) -> Model:
        return cls(**model_settings(path, cls.config_key))

    @abstractmethod
    def invoke(self, input: Any, config: dict | None = None, **kw: Any) -> dict: ...


class Loaded:
    """A model that is sent to workers as its class and settings, and made once in each process that asks for more than a setting."""

    _made: dict[str, Model] = {}

    def __init__(self, kind: type[Model], **settings: Any) -> None:
        self.kind, self.settings = kind, settings
        self.key = f"{kind.__module__}.{kind.__qualname__}({sorted(settings.items())!r})"

    @classmethod
    def from_config(cls, kind: type[Model], path: str) -> Loaded:
        return cls(kind, **model_settings(path, kind.config_key))

    def get(self) -> Model:
        if self.key not in Loaded._made:
            Loaded._made[self.key] = self.kind(**self.settings)
        return Loaded._made[self.key]

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__") or name in ("kind", "settings", "key"):
            raise AttributeError(name)
        return self.settings[name] if name in self.settings else getattr(self.get(), name)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class HashEncoder(Model):
    """Texts and images to unit vectors by hashed features: equal words and equal pixels meet."""

    config_key = "encoder"

    def __init__(self, embedding_dim: int = 64, batch_size: int = 64, **_: Any) -> None:
        self.embedding_dim, self.batch_size = embedding_dim, batch_size

    def _of(self, parts: list[bytes]) -> np.ndarray:
        v = np.zeros(self.embedding_dim)
        for p in parts or [b""]:
            seed = int.from_bytes(hashlib.sha1(p).digest()[:8], "big")
            v += np.random.default_rng(seed).standard_normal(self.embedding_dim)
        return unit(v).astype(np.float32)

    def embed_text(self, text: str) -> np.ndarray:
        return self._of([w.encode() for w in text.lower().split()])

    def embed_images(self, images: list) -> np.ndarray:
        raw = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in images]
        return np.stack([self._of([x]) for x in raw]) if raw else np.zeros((0, self.embedding_dim), np.float32)

    def invoke(self, input: Any, config: dict | None = None, **kw: Any) -> dict:
        if isinstance(input, str):
            return {"embedding": self.embed_text(input)}
        if isinstance(input, (np.ndarray, bytes)):
            return {"embedding": self.embed_images([input])[0]}
        if isinstance(input, list):
            return {"embedding": self.embed_images(input)}
        raise TypeError(f"text, an image or a list of images is needed, not {type(input).__name__}")


class RegionDetector(Model):
    """A promptable detector: the region brighter than its image's mean, scored by a hash of prompt and area.

    Only regions that score above box_threshold are found. A label is made of the prompt's words that score above text_threshold, each by
    its own hash, and may so be empty.
    """

    config_key = "detector"

    def __init__(self, threshold: float = 0.0, masks: bool = True, labels: bool = False, box_threshold: float | None = None, text_threshold: float = 0.0, **_: Any) -> None:
        self.threshold = threshold if box_threshold is None else box_threshold
        self.text_threshold, self.masks, self.labels = text_threshold, masks, labels

    def invoke(self, input: Any, config: dict | None = None, **kw: Any) -> dict:
        image, text = input["image"], input["text"]
        share = lambda t: int(hashlib.sha1(t.encode()).hexdigest()[:4], 16) / 65536
        grey = np.asarray(image, float).mean(-1)
        mask = grey >= grey.mean()
        ys, xs = np.nonzero(mask)
        score = float(mask.mean()) * (0.5 + share(text) / 2)
        keep = len(xs) > 0 and score > self.threshold
        out = {"scores": [score] if keep else [], "boxes": [[float(xs.min()), float(ys.min()), float(xs.max()), float(ys.max())]] if keep else []}
        if self.masks:
            out["masks"] = [mask] if keep else []
        if self.labels:
            words = text.split()
            out["labels"] = [" ".join(w for w in words if share(w) >= self.text_threshold)] if keep else []
        return out


class GridMasks(Model):
    """An automatic mask generator: the cells of a grid whose mean colour stands out; takes an image only.

    A mask's predicted quality is its contrast, and its stability the share of it that stays if the contrast is measured by ``offset`` more
    strictly; only masks above both thresholds are kept.
    """

    config_key = "masks"

    def __init__(self, points_per_side: int = 4, min_contrast: float = 8.0, pred_iou_thresh: float = 0.0, stability_score_thresh: float = -1.0, offset: float = 4.0, **_: Any) -> None:
        self.points_per_side, self.min_contrast = points_per_side, min_contrast
        self.pred_iou_thresh, self.stability_score_thresh, self.offset = pred_iou_thresh, stability_score_thresh, offset

    def invoke(self, input: Any, config: dict | None = None, **kw: Any) -> dict:
        if not isinstance(input, np.ndarray):
            raise TypeError(f"an image is needed, not {type(input).__name__}")
        h, w = input.shape[:2]
        mean, masks, scores = input.reshape(-1, input.shape[-1]).mean(0), [], []
        for i in range(self.points_per_side):
            for j in range(self.points_per_side):
                y0, y1 = h * i // self.points_per_side, h * (i + 1) // self.points_per_side
                x0, x1 = w * j // self.points_per_side, w * (j + 1) // self.points_per_side
                cell = input[y0:y1, x0:x1]
                if cell.size and (contrast := float(np.abs(cell.reshape(-1, cell.shape[-1]).mean(0) - mean).max())) >= self.min_contrast:
                    off = np.abs(cell.reshape(-1, cell.shape[-1]) - mean).max(1)
                    strict, loose = ((off >= self.min_contrast + d).sum() for d in (self.offset, -self.offset))
                    if contrast / 255 > self.pred_iou_thresh and strict / max(1, loose) > self.stability_score_thresh:
                        m = np.zeros((h, w), bool)
                        m[y0:y1, x0:x1] = True
                        masks.append(m)
                        scores.append(contrast / 255)
        return finish_masks(masks, scores, [])


def to_mask(seg: Any) -> np.ndarray:
    """A boolean mask: arrays count by their truth, images (rows of Spark's image source) by grey levels from 128 on."""
    if not isinstance(seg, np.ndarray) and hasattr(seg, "nChannels"):
        seg = {k: getattr(seg, k) for k in ("height", "width", "nChannels", "data")}
    if isinstance(seg, dict):
        a = np.frombuffer(seg["data"], np.uint8).reshape(seg["height"], seg["width"], seg["nChannels"]).astype(float)
        # blue comes first
        return (a[..., 0] if a.shape[2] == 1 else np.floor(a[..., 2] * 0.299 + a[..., 1] * 0.587 + a[..., 0] * 0.114 + 0.5)) > 127
    return np.asarray(seg).astype(bool)


def mask_box(mask: np.ndarray) -> list[float]:
    """The least and greatest coordinates, both inclusive; zeros for an empty mask."""
    ys, xs = np.nonzero(mask)
    return [float(xs.min()), float(ys.min()), float(xs.max()), float(ys.max())] if len(xs) else [0.0] * 4


def finish_masks(masks: list, scores: list, boxes: list) -> dict:
    """Parallel lists; a mask without a box gets its own extent."""
    masks = [to_mask(m) for m in masks]
    return {"masks": masks, "scores": [float(s) for s in scores], "boxes": [[float(v) for v in boxes[i]] if i < len(boxes) and boxes[i] is not None else mask_box(m) for i, m in enumerate(masks)]}


ENCODERS = {"hash": HashEncoder}
DETECTORS = {"region": RegionDetector}
