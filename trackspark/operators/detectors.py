"""Detectors of candidates in frames: a registry, choice by what is at hand, and models that a worker loads once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.frames import opened
from .pixels import frame_triples, moving_balls, peaks

#: Bytes that a file of weights has at least; shorter ones are failed downloads.
LEAST_WEIGHTS = 1_000_000
#: Stacks of three frames in one call of a model.
BATCH = 4


class DetectorError(RuntimeError):
    """A detector that was asked for by name cannot run."""


@dataclass(frozen=True)
class Model:
    """A detector that needs weights. load(path) gives a model, in a worker; forward(model, stacks) gives a heat map (h, w) of 0 to 1 for each stack (n, h, w, 9)."""

    load: Callable[[str], Any]
    forward: Callable[[Any, np.ndarray], np.ndarray]
    least_bytes: int = LEAST_WEIGHTS


MODELS: dict[str, Model] = {}
CLASSICAL = "classical"
_loaded: dict[tuple[str, str], Any] = {}


def register(name: str, model: Model) -> None:
    """Makes a model known; `auto` tries models in the order of their registration."""
    if name in (CLASSICAL, "auto"):
        raise ValueError(f"{name} is taken")
    MODELS[name] = model


def usable(model: Model, weights: str | None) -> bool:
    """Whether the weights are there and not cut short."""
    if not weights:
        return False
    store, path = opened(weights)
    info = store.get_file_info(path)
    return bool(info.is_file and info.size > model.least_bytes)


def chosen(kind: str = "auto", weights: str | None = None) -> str:
    """The detector's name: with `auto` the first model whose weights are usable, else the classical one; any other name is meant and fails hard."""
    if kind == CLASSICAL:
        return kind
    if kind == "auto":
        return next((n for n, m in MODELS.items() if usable(m, weights)), CLASSICAL)
    if kind not in MODELS:
        raise DetectorError(f"no detector {kind}")
    if not usable(MODELS[kind], weights):
        raise DetectorError(f"no usable weights for {kind} at {weights}")
    return kind


def loaded(name: str, model: Model, weights: str) -> Any:
    """The model in this worker: loaded at its first batch, and kept for all later tasks."""
    if (name, weights) not in _loaded:
        _loaded[name, weights] = model.load(weights)
    return _loaded[name, weights]


def by_model(frames: DataFrame, keys: list[str], width: float, height: float, name: str, weights: str, fps: float = 25.0, batch: int = BATCH, least: float = 0.1, most: int = 4) -> DataFrame:
    """keys, frame, cand_idx, x, y, score of a registered model's heat maps, over each frame with the ones before and after.

    Stacks go to the model in batches of `batch`, across the rows of a task; frames of another size than the one before begin a new batch. Frames without
    pixels, or with another number of bytes than h * w * 3, have no candidates.
    """
    model, step = MODELS[name], 2 if fps > 37.5 else 1
    good = frames.where(F.octet_length("rgb") == F.col("h") * F.col("w") * 3)
    triples = frame_triples(good.select(*keys, "frame", "h", "w", "rgb"), keys, step)
    triples = triples.where((F.octet_length("before") == F.octet_length("rgb")) & (F.octet_length("after") == F.octet_length("rgb")))
    head = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in (*keys, "frame"))

    def told(net: Any, held: list[tuple]) -> list[tuple]:
        heat = model.forward(net, np.stack([s for _, s in held]))
        out = []
        for (key, s), h in zip(held, heat, strict=True):
            found = peaks(h, least, most)
            out += [(*key, k, x * width / s.shape[1], y * height / s.shape[0], score) for k, (x, y, score) in enumerate(found)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, held = None, []
        for pdf in batches:
            net = net or loaded(name, model, weights)
            out = []
            for key, h, w, *pixels in zip(pdf[[*keys, "frame"]].itertuples(index=False, name=None), pdf["h"], pdf["w"], pdf["before"], pdf["rgb"], pdf["after"], strict=True):
                stack = np.concatenate([np.frombuffer(p, np.uint8).reshape(h, w, 3) for p in pixels], axis=2)
                if held and (len(held) == batch or held[0][1].shape != stack.shape):
                    out += told(net, held)
                    held = []
                held.append((key, stack))
            yield pd.DataFrame(out, columns=[*keys, "frame", "cand_idx", "x", "y", "score"])
        if held:
            yield pd.DataFrame(told(net, held), columns=[*keys, "frame", "cand_idx", "x", "y", "score"])

    return triples.mapInPandas(run, f"{head}, cand_idx int, x double, y double, score double")


def detect(frames: DataFrame, keys: list[str], width: float, height: float, fps: float = 25.0, kind: str = "auto", weights: str | None = None, batch: int = BATCH, roi: tuple[float, float, float, float] | None = None) -> DataFrame:
    """keys, frame, cand_idx, x, y, score of the candidates in frames (keys name the shot; frame, h, w, rgb), by the detector that chosen() gives.

    `roi` holds for the classical detector alone. weights is a path that every executor reaches.
    """
    name = chosen(kind, weights)
    if name == CLASSICAL:
        return moving_balls(frames, keys, width, height, fps, roi)
    return by_model(frames, keys, width, height, name, weights, fps, batch)
