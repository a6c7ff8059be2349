"""Rectangles of whole images ``(key, width, height, data)`` with RGBA bytes: cut out, filled, and laid over others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec.columns import kernel

IMAGE = "width int, height int, data binary"


def _each(df: DataFrame, key: str, columns: list[str], change) -> DataFrame:
    """``change(width, height, pixels, *others)`` gives new pixels, or None; an image whose bytes don't fit its size is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # an image at a time: cells are large
                w, h, data, *others = (batch.column(1 + j)[k].as_py() for j in range(3 + len(columns)))
                out = None
                if data is not None and w is not None and h is not None and len(data) == 4 * w * h:
                    out = change(w, h, np.frombuffer(data, np.uint8).reshape(h, w, 4), *others)
                size = (None, None, None) if out is None else (out.shape[1], out.shape[0], np.ascontiguousarray(out).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *(pa.array([v], t) for v, t in zip(size, (pa.int32(), pa.int32(), pa.binary())))], [key, "width", "height", "data"])

    return kernel(df, [key, "width", "height", "data", *columns], run, f"`{key}` {df.schema[key].dataType.simpleString()}, {IMAGE}")


def clamped(x: int, y: int, w: int, h: int, width: int, height: int) -> tuple[int, int, int, int]:
    """Begin and end of what lies within the image."""
    return max(0, x), max(0, y), max(0, min(x + w, width)), max(0, min(y + h, height))


def cropped(images: DataFrame, key: str, x: int, y: int, w: int, h: int) -> DataFrame:
    """What lies within the rectangle; null if nothing does."""
    def change(width, height, px):
        x0, y0, x1, y1 = clamped(x, y, w, h, width, height)
        return px[y0:y1, x0:x1] if x0 < x1 and y0 < y1 else None

    return _each(images, key, [], change)


def filled(images: DataFrame, key: str, x: int, y: int, w: int, h: int, rgba: tuple[int, int, int, int]) -> DataFrame:
    def change(width, height, px):
        x0, y0, x1, y1 = clamped(x, y, w, h, width, height)
        out = px.copy()
        out[y0:y1, x0:x1] = rgba
        return out

    return _each(images, key, [], change)


def pasted(images: DataFrame, others: DataFrame, key: str, x: int, y: int) -> DataFrame:
    """The other image of the same key laid over at (x, y), without blending; what goes over the edge is left out."""
    def change(width, height, px, ow, oh, data):
        out = px.copy()
        if data is not None and len(data) == 4 * ow * oh:
            x0, y0, x1, y1 = clamped(x, y, ow, oh, width, height)
            if x0 < x1 and y0 < y1:
                out[y0:y1, x0:x1] = np.frombuffer(data, np.uint8).reshape(oh, ow, 4)[y0 - y : y1 - y, x0 - x : x1 - x]
        return out

    names = {c: f"other_{c}" for c in ("width", "height", "data")}
    return _each(images.join(others.select(key, *[F.col(c).alias(n) for c, n in names.items()]), key, "left"), key, list(names.values()), change)
