"""Operators on tables of animation frames ``(anim_id, frame_idx, x, y, w, h, duration_ms, ...)``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P

MAX_DURATION = 0xFFFFFF


def timeline(frames: DataFrame) -> DataFrame:
    """``start_ms``: when each frame is shown first."""
    before = Window.partitionBy("anim_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("start_ms", F.coalesce(F.sum("duration_ms").over(before), F.lit(0).cast("long")))


def summary(frames: DataFrame, canvas_w: int, canvas_h: int) -> DataFrame:
    """A row for each animation; partial sums before the shuffle, whatever an animation's length."""
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    return frames.groupBy("anim_id").agg(
        F.count("*").alias("n_frames"), F.sum("duration_ms").alias("duration_ms"), F.bool_or("has_alpha").alias("has_alpha"), ((F.count("*") > 1) | (F.max("duration_ms") > 0)).alias("is_animated"),
        F.greatest(F.max(right), F.lit(1)).alias("canvas_w"), F.greatest(F.max(bottom), F.lit(1)).alias("canvas_h"), F.bool_and((right <= canvas_w) & (bottom <= canvas_h)).alias("fits"),
    )


def merge_identical(frames: DataFrame, canvas: str) -> DataFrame:
    """Runs of frames with equal canvases become one, with the sum of their durations."""
    order = Window.partitionBy("anim_id").orderBy("frame_idx")
    new = (~F.col(canvas).eqNullSafe(F.lag(canvas).over(order))) | (F.row_number().over(order) == 1)
    runs = frames.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("anim_id", "run").agg(F.min("frame_idx").alias("frame_idx"), F.first(canvas).alias(canvas), F.count("*").alias("merged"), F.sum("duration_ms").alias("duration_ms")).drop("run")


def split_durations(merged: DataFrame) -> DataFrame:
    """Durations over the format's 24 bits: rows of at most ``MAX_DURATION``, numbered by ``part``."""
    parts = F.sequence(F.lit(0), F.greatest(F.floor((F.col("duration_ms") - 1) / MAX_DURATION), F.lit(0)).cast("int"))
    out = merged.withColumn("part", F.explode(parts))
    return out.withColumn("duration_ms", F.least(F.col("duration_ms") - F.col("part") * MAX_DURATION, F.lit(MAX_DURATION)))


def keyframes(frames: DataFrame, canvas_w: int, canvas_h: int) -> DataFrame:
    """``is_key``: frames that don't depend on those before.

    A frame is one by itself (first, or whole and without transparency to blend), or if the one before was disposed to the
    background and was whole or a key frame itself. The recurrence only passes from one frame to the next through frames that
    are disposed and not whole, so it is a run of windows: a frame that isn't key by itself is key if the nearest earlier
    frame at which the chain's answer is known says so.
    """
    order = Window.partitionBy("anim_id").orderBy("frame_idx")
    whole = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("w") == canvas_w) & (F.col("h") == canvas_h)
    own = (F.lag("frame_idx").over(order).isNull()) | (whole & (~F.col("has_alpha") | F.col("no_blend")))
    before = F.lag(F.struct(F.col("to_background").alias("gone"), whole.alias("whole"))).over(order)
    known = F.when(own, True).when(before["gone"] & before["whole"], True).when(~before["gone"], False)  # null: as the frame before
    out = frames.withColumn("known", known)
    return out.withColumn("is_key", F.last("known", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("known")


def forced_keyframes(frames: DataFrame, kmax: int) -> DataFrame:
    """``forced``: where at most kmax frames may lie between key frames, counted from the last key frame (``is_key``)."""
    order = Window.partitionBy("anim_id").orderBy("frame_idx")
    run = frames.withColumn("run", F.sum(F.col("is_key").cast("int")).over(order))
    place = F.row_number().over(Window.partitionBy("anim_id", "run").orderBy("frame_idx")) - 1
    forced = (place > 0) & (place % max(kmax, 1) == 0) if kmax > 0 else F.lit(False)
    return run.withColumn("forced", forced).drop("run")


def changed_rect(pixels: DataFrame, image: str, before: dict[str, Column], after: dict[str, Column], most: Column) -> DataFrame:
    """Bounds of the pixels that differ (ends exclusive), and whether blending ``after`` over ``before`` gives ``after``."""
    differs = before["r"] != after["r"]
    for c in "gba":
        differs = differs | (before[c] != after[c])
    opaque = after["a"] == 255
    of = lambda f, c: f(F.when(differs, F.col(c)))
    return pixels.groupBy(image).agg(
        of(F.min, "x").alias("x0"), of(F.min, "y").alias("y0"), (of(F.max, "x") + 1).alias("x1"), (of(F.max, "y") + 1).alias("y1"), F.count(F.when(differs, 1)).alias("changed"),
        F.bool_and(opaque | ~differs).alias("lossless_blend"), F.bool_and(opaque | P.similar(before, after, most)).alias("lossy_blend"),
    )


def frame_bounds(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A frame's rectangle (ends exclusive); an end beyond 64 bits is the greatest number."""
    end = lambda at, size: F.coalesce(F.try_add(at.cast("long"), size.cast("long")), F.lit((1 << 63) - 1))
    return F.struct(x.cast("long").alias("x0"), y.cast("long").alias("y0"), end(x, w).alias("x1"), end(y, h).alias("y1"))


CANVAS = "anim_id long, frame_idx long, width int, height int, data binary"


def canvases(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Shown canvases of animations: frames ``(anim_id, frame_idx, x, y, w, h, no_blend, to_background, data)`` with
    non-premultiplied RGBA bytes, composed in order. Frames of an animation come sorted to one task and are folded one
    after the other; only the canvas is held, so an animation's length isn't bounded by memory.

    Disposing to the background clears to transparent. A frame whose bytes don't fit its size leaves the canvas as it is.
    """
    import numpy as np

    def blended(src, dst):
        sa, da = src[..., 3:].astype(np.int64), dst[..., 3:].astype(np.int64)
        below = da * (256 - sa) >> 8
        alpha = sa + below
        scale = (1 << 24) // np.maximum(alpha, 1)
        mix = np.minimum((src[..., :3] * sa + dst[..., :3] * below) * scale >> 24, 255)
        out = np.concatenate([mix, alpha], axis=-1).astype(np.uint8)
        return np.where(sa == 0, dst, np.where((sa == 255) | (da == 0), src, out))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, canvas, pending = object(), None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.anim_id != current:
                    current, canvas, pending = r.anim_id, np.zeros((height, width, 4), np.uint8), None
                if pending is not None:
                    x, y, w, h = pending
                    canvas[y : y + h, x : x + w] = 0
                x, y, w, h = int(r.x), int(r.y), int(r.w), int(r.h)
                if r.data is not None and len(r.data) == 4 * w * h:
                    src = np.frombuffer(r.data, np.uint8).reshape(h, w, 4)[: max(0, height - y), : max(0, width - x)]
                    view = canvas[y : y + src.shape[0], x : x + src.shape[1]]
                    view[:] = src if r.no_blend else blended(src, view)
                pending = (x, y, w, h) if r.to_background else None
                out.append((r.anim_id, r.frame_idx, width, height, canvas.tobytes()))
            yield pd.DataFrame(out, columns=["anim_id", "frame_idx", "width", "height", "data"])

    need = ["anim_id", "frame_idx", "x", "y", "w", "h", "no_blend", "to_background", "data"]
    return frames.select(*need).repartition("anim_id").sortWithinPartitions("anim_id", "frame_idx").mapInPandas(fold, CANVAS)


def smallest_candidate(candidates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each frame's encodings ``(keys, order, data)`` the shortest, of equals the first in order."""
    best = F.min_by(F.struct("data", order), F.struct(F.length("data"), F.col(order)))
    return candidates.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")
