"""Encoder options: one explicit set of defaults, presets as a small table, validation as a column."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    lossless: bool = False
    quality: float = 75.0
    method: int = 4
    target_size: int = 0
    target_psnr: float = 0.0
    preprocessing: int = 0
    preset: int = 0
    sns_strength: int = 50
    filter_strength: int = 60
    filter_sharpness: int = 0
    filter_type: int = 1
    partitions: int = 0
    segments: int = 4
    passes: int = 1
    qmin: int = 0
    qmax: int = 100
    alpha_compression: int = 1
    alpha_filtering: int = 1
    alpha_quality: int = 100

    def row(self) -> dict:
        return asdict(self)


# What each preset changes.
PRESETS = {
    "default": {},
    "picture": {"sns_strength": 80, "filter_sharpness": 4, "filter_strength": 35},
    "photo": {"sns_strength": 80, "filter_sharpness": 3, "filter_strength": 30, "preprocessing": 2},
    "drawing": {"sns_strength": 25, "filter_sharpness": 6, "filter_strength": 10},
    "icon": {"sns_strength": 0, "filter_strength": 0},
    "text": {"sns_strength": 0, "filter_strength": 0, "segments": 2},
}


def preset(name: str, quality: float = 75.0) -> Options:
    return replace(Options(), quality=quality, preset=list(PRESETS).index(name), **PRESETS[name])


# Option, least (None: negative values stand for the default) and most, in the order of the checks.
LIMITS = (
    ("quality", 0, 100), ("method", 0, 6), ("target_size", 0, None), ("target_psnr", 0, None), ("preprocessing", 0, 3), ("preset", 0, 5), ("sns_strength", None, 100),
    ("filter_strength", None, 100), ("filter_sharpness", 0, 7), ("filter_type", None, 1), ("partitions", 0, 3), ("segments", None, 4), ("passes", None, 10), ("qmin", 0, 100),
    ("alpha_compression", None, 1), ("alpha_filtering", None, 2), ("alpha_quality", None, 100),
)
#: What a negative value stands for.
DEFAULTS = {k: v for k, v in Options().row().items() if k in {n for n, low, _ in LIMITS if low is None} | {"qmax"}}


def resolved(name: str, value: Column) -> Column:
    return F.when(value < 0, DEFAULTS[name]).otherwise(value) if name in DEFAULTS else value


def first_error(of: dict[str, Column]) -> Column:
    """The name of the first option out of its range, null if all are valid."""
    out = None
    for name, low, high in LIMITS:
        v = of[name]
        bad = F.isnan(v.cast("double"))
        bad = bad | (v < low) if low is not None else bad
        bad = bad | (v > high) if high is not None else bad | (v == float("inf"))
        if name == "qmin":
            top = resolved("qmax", of["qmax"])
            bad = bad | (top > 100) | (v > top)
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out
