"""The alpha plane's chunk: one byte of method, then raw or losslessly coded filtered values."""

from __future__ import annotations

import numpy as np

from . import lossless
from .bits import Corrupt

NONE, HORIZONTAL, VERTICAL, GRADIENT = range(4)


def guess(plane: np.ndarray, method: int) -> np.ndarray:
    """What a filter predicts of each value from the original plane."""
    p = plane.astype(np.int64)
    out = np.zeros_like(p)
    if method == NONE:
        return out
    out[0, 1:], out[1:, 0] = p[0, :-1], p[:-1, 0]
    if method == HORIZONTAL:
        out[1:, 1:] = p[1:, :-1]
    elif method == VERTICAL:
        out[1:, 1:] = p[:-1, 1:]
    else:
        out[1:, 1:] = np.clip(p[1:, :-1] + p[:-1, 1:] - p[:-1, :-1], 0, 255)
    return out


def unfiltered(res: np.ndarray, method: int) -> np.ndarray:
    r = res.astype(np.int64)
    if method == NONE:
        return res
    if method == HORIZONTAL:
        r[:, 0] = np.cumsum(r[:, 0])
        return (np.cumsum(r, 1) & 255).astype(np.uint8)
    r[0] = np.cumsum(r[0]) & 255
    if method == VERTICAL:
        return (np.cumsum(r, 0) & 255).astype(np.uint8)
    r[:, 0] = np.cumsum(r[:, 0]) & 255
    height, width = r.shape
    for d in range(2, height + width - 1):  # all places of an anti-diagonal at once
        y = np.arange(max(1, d - width + 1), min(height, d))
        x = d - y
        r[y, x] = r[y, x] + np.clip(r[y, x - 1] + r[y - 1, x] - r[y - 1, x - 1], 0, 255) & 255
    return r.astype(np.uint8)


def levels(quality: int) -> int:
    return 256 if quality >= 100 else 2 + quality // 5 if quality <= 70 else 16 + (quality - 70) * 8


def quantised(plane: np.ndarray, n: int) -> np.ndarray:
    """At most n different values: one-dimensional k-means whose outer centres stay at the least and greatest value, until the
    error falls by less than a ten-thousandth a value, six rounds at most."""
    values, counts = np.unique(plane, return_counts=True)
    if not 2 <= n <= 256 or len(values) <= n:
        return plane
    v, c = values.astype(np.float64), counts.astype(np.float64)
    centres = np.linspace(v[0], v[-1], n)
    before = np.inf
    for _ in range(6):
        slot = np.searchsorted((centres[:-1] + centres[1:]) / 2, v, side="left")
        weight = np.bincount(slot, c, n)
        mean = np.bincount(slot, c * v, n) / np.maximum(weight, 1)
        inner = slice(1, n - 1)
        centres[inner] = np.where(weight[inner] > 0, mean[inner], centres[inner])
        error = float((c * (v - centres[slot]) ** 2).sum())
        if before - error < 1e-4 * plane.size:
            break
        before = error
    table = np.zeros(256, np.uint8)
    table[values] = np.floor(centres[slot] + 0.5).astype(np.uint8)
    return table[plane]


def best_filter(plane: np.ndarray) -> int:
    """The filter with the least entropy of residuals."""
    def entropy(method):
        p = np.bincount(((plane.astype(np.int64) - guess(plane, method)) & 255).ravel(), minlength=256) / plane.size
        return -(p[p > 0] * np.log2(p[p > 0])).sum()

    return min(range(4), key=lambda m: (entropy(m), m))


def encode(plane: np.ndarray, quality: int = 100, compression: int = 1, filtering: int = 1) -> bytes:
    """``filtering``: 0 none, 1 by entropy, 2 try all. Raw where that is shorter."""
    plane = quantised(np.ascontiguousarray(plane, np.uint8), levels(quality))
    tries = [NONE] if not filtering or not compression else [best_filter(plane)] if filtering == 1 else range(4)
    found = []
    for method in tries:
        res = ((plane.astype(np.int64) - guess(plane, method)) & 255).astype(np.uint8)
        if compression:
            zero = np.zeros(res.shape, np.int64)
            found.append(bytes([1 | method << 2]) + lossless.encode(lossless.words(zero + 255, zero, res.astype(np.int64), zero), header=False))
    raw = bytes([0]) + plane.tobytes()
    return min([*found, raw], key=len)


def decode(data: bytes, width: int, height: int) -> np.ndarray:
    if not data:
        raise Corrupt("truncated")
    how, method = data[0] & 3, data[0] >> 2 & 3
    if how == 0:
        if len(data) < 1 + width * height:
            raise Corrupt("truncated")
        res = np.frombuffer(data, np.uint8, width * height, 1).reshape(height, width)
    elif how == 1:
        res = (lossless.decode(data[1:], (width, height)) >> np.uint32(8) & np.uint32(255)).astype(np.uint8)
    else:
        raise Corrupt("unknown alpha method")
    return unfiltered(res, method)
