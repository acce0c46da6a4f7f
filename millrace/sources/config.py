"""Versioned JSON settings and pointers to the latest of something."""

from __future__ import annotations

import json
import math
import os
from dataclasses import asdict, dataclass, fields

from millrace.sources.sinks import safe_relative, write_json

CONFIG_VERSION = "1.0.0"


@dataclass(frozen=True)
class TrainingConfig:
    """Settings of a training run's data and schedule; impossible ones are errors."""

    max_steps: int
    micro_batch: int
    accumulation: int = 1
    warmup_steps: int = 0
    learning_rate: float = 3e-4
    min_learning_rate: float = 3e-5
    validation_interval: int = 100
    seed: int = 0

    def __post_init__(self) -> None:
        for name in ("max_steps", "micro_batch", "accumulation", "validation_interval"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a whole number of 1 or more")
        if not 0 <= self.warmup_steps <= self.max_steps:
            raise ValueError("warmup_steps must lie between 0 and max_steps")
        if not (math.isfinite(self.learning_rate) and 0 <= self.min_learning_rate <= self.learning_rate):
            raise ValueError("rates must be finite, and the least one not above the other")

    def capped(self, steps: int) -> TrainingConfig:
        """The settings for a shorter run: warm-up and intervals are held to it."""
        return TrainingConfig(**{f.name: getattr(self, f.name) for f in fields(self)} | {"max_steps": steps, "warmup_steps": min(self.warmup_steps, steps), "validation_interval": min(self.validation_interval, steps)})


@dataclass(frozen=True)
class ModelConfig:
    """Sizes of a decoder; impossible ones are errors."""

    vocab_size: int
    max_seq_len: int
    n_layers: int
    n_heads: int
    d_model: int
    d_ff: int
    dropout: float = 0.0
    bias: bool = False
    tie_embeddings: bool = True

    def __post_init__(self) -> None:
        for name in ("vocab_size", "max_seq_len", "n_layers", "n_heads", "d_model", "d_ff"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a whole number of 1 or more")
        if self.d_model % self.n_heads:
            raise ValueError("d_model must be a multiple of n_heads")
        if not 0 <= self.dropout < 1:
            raise ValueError("dropout must be 0 or more and below 1")

    @property
    def head_dim(self) -> int:
        return self.d_model // self.n_heads


def save(config: TrainingConfig | ModelConfig, path: str) -> None:
    write_json({"config_version": CONFIG_VERSION} | asdict(config), path)


def load_model(path: str) -> ModelConfig:
    """Model settings from JSON, as strictly as load()."""
    return load(path, ModelConfig)


def load(path: str, kind: type = TrainingConfig):
    """Settings from JSON; another version, or a key that doesn't belong, is an error."""
    with open(path, encoding="utf-8") as source:
        found = json.load(source)
    version = found.pop("config_version", None)
    if version != CONFIG_VERSION:
        raise ValueError(f"config_version is {version!r}, not {CONFIG_VERSION!r}")
    odd = set(found) - {f.name for f in fields(kind)}
    if odd:
        raise ValueError(f"unknown settings: {sorted(odd)}")
    return kind(**found)


def point_to(folder: str, name: str) -> None:
    """Sets a folder's latest pointer, at once."""
    write_json({"latest": safe_relative(name)}, os.path.join(folder, "latest.json"))


def latest(folder: str) -> str:
    """What a folder's latest pointer names; it must be there."""
    with open(os.path.join(folder, "latest.json"), encoding="utf-8") as source:
        path = os.path.join(folder, safe_relative(json.load(source)["latest"]))
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path
