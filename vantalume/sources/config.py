"""Settings from YAML files."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml


def load(path: str | Path) -> dict:
    return yaml.safe_load(Path(path).read_text())


def model_settings(path: str | Path, key: str | None) -> dict:
    """Constructor arguments of one model; a model without a key can't be made from a file."""
    if key is None:
        raise NotImplementedError("this model names no section")
    return dict(load(path)["models"][key] or {})


@dataclass(frozen=True)
class IndexSettings:
    db_path: str
    batch_size: int | None = None

    @classmethod
    def load(cls, path: str | Path) -> IndexSettings:
        return cls.of(load(path))

    @classmethod
    def of(cls, settings: dict) -> IndexSettings:
        section = settings["indexing"]
        return cls(section["db_path"], section.get("batch_size"))


@dataclass(frozen=True)
class CropSettings:
    background: str = "gray"
    selection: str = "area_centrality"
    margin: float = 0.1
    output_size: int = 224
    top_n: int = 1
    noise_mean: float = 128.0
    noise_std: float = 40.0
    seed: int = 0

    def __post_init__(self) -> None:
        if self.background not in ("gray", "black", "white", "noise"):
            raise ValueError(f"unknown background {self.background!r}")

    @classmethod
    def load(cls, path: str | Path) -> CropSettings:
        section = load(path).get("preprocess") or {}
        kinds = {"margin": float, "output_size": int, "top_n": int, "noise_mean": float, "noise_std": float, "seed": int}
        return cls(**{k: kinds.get(k, str)(v) for k, v in section.items() if k in cls.__dataclass_fields__})
