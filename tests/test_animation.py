"""Folds over frames against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from pixelbrook.operators import animation, mux
from pixelbrook.sources.container import parse

FRAME = "anim_id long, frame_idx long, x int, y int, w int, h int, duration_ms long, has_alpha boolean, no_blend boolean, to_background boolean, data binary"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for a in range(8):
        for i in range(rng.randint(1, 20)):
            w, h = (4, 4) if rng.random() < 0.5 else (rng.randint(1, 3), rng.randint(1, 3))
            x, y = (0, 0) if (w, h) == (4, 4) else (rng.randint(0, 4 - w), rng.randint(0, 4 - h))
            out.append((a, i, x, y, w, h, rng.randint(0, 50), rng.random() < 0.5, rng.random() < 0.3, rng.random() < 0.5, bytes(rng.choice([0, 60, 128, 255]) for _ in range(4 * w * h))))
    return out


def over(s, d):
    if s[3] == 0:
        return d
    if s[3] == 255 or d[3] == 0:
        return s
    below = d[3] * (256 - s[3]) >> 8
    alpha = s[3] + below
    scale = (1 << 24) // alpha
    return tuple(min((s[c] * s[3] + d[c] * below) * scale >> 24, 255) for c in range(3)) + (alpha,)


def test_canvases(spark, rows):
    got = {(r.anim_id, r.frame_idx): bytes(r.data) for r in animation.canvases(spark.createDataFrame(rows, FRAME), 4, 4).collect()}
    canvas, last, gone = None, None, None
    for a, i, x, y, w, h, _, _, no_blend, back, data in rows:
        if a != last:
            canvas, last, gone = [[(0, 0, 0, 0)] * 4 for _ in range(4)], a, None
        for yy, xx in gone or ():
            canvas[yy][xx] = (0, 0, 0, 0)
        for k in range(w * h):
            s = tuple(data[4 * k : 4 * k + 4])
            yy, xx = y + k // w, x + k % w
            canvas[yy][xx] = s if no_blend else over(s, canvas[yy][xx])
        gone = [(y + k // w, x + k % w) for k in range(w * h)] if back else None
        assert got[a, i] == bytes(v for row in canvas for p in row for v in p)


def test_keyframes(spark, rows):
    got = {(r.anim_id, r.frame_idx): r.is_key for r in animation.keyframes(spark.createDataFrame(rows, FRAME), 4, 4).collect()}
    before = None
    for a, i, x, y, w, h, _, alpha, no_blend, back, _ in rows:
        whole = (x, y, w, h) == (0, 0, 4, 4)
        key = i == 0 or (whole and (not alpha or no_blend)) or (before[1] and (before[2] or before[0]))
        assert got[a, i] == key
        before = (key, back, whole)


def test_split_durations(spark):
    out = animation.split_durations(spark.createDataFrame([(1, 0, 2 * 0xFFFFFF + 5), (1, 1, 0), (1, 2, 0xFFFFFF)], "anim_id int, frame_idx int, duration_ms long"))
    assert sorted((r.frame_idx, r.part, r.duration_ms) for r in out.collect()) == [(0, 0, 0xFFFFFF), (0, 1, 0xFFFFFF), (0, 2, 5), (1, 0, 0), (2, 0, 0xFFFFFF)]


def test_forced_keyframes(spark):
    df = spark.createDataFrame([(1, i, i in (0, 4)) for i in range(10)], "anim_id int, frame_idx int, is_key boolean")
    assert [r.forced for r in animation.forced_keyframes(df, 3).orderBy("frame_idx").collect()] == [False, False, False, True, False, False, False, True, False, False]


def test_mux_round_trip(spark):
    image = b"\x2f" + ((8 - 1) | (6 - 1) << 14 | 1 << 28).to_bytes(4, "little")
    frames = spark.createDataFrame([(1, i, 2 * i, 0, 8, 6, 10 * i, i % 2, 0, image) for i in range(3)] + [(2, 0, 0, 0, 8, 6, 5, 0, 0, b"")], "anim_id long, frame_idx int, x int, y int, w int, h int, duration_ms long, dispose int, no_blend int, data binary")
    out = {r.anim_id: r for r in mux.animated(frames, loop=70000).collect()}
    assert out[2].content is None and out[2].error == "empty frame"
    f = parse(bytes(out[1].content), "strict")
    assert f.error is None and f.loop == 65535 and (f.width, f.height) == (12, 6) and [(r.x, r.duration_ms, r.dispose) for r in f.frames] == [(0, 0, 0), (2, 10, 1), (4, 20, 0)]


def test_still_with_metadata(spark):
    image = b"\x2f" + ((8 - 1) | (6 - 1) << 14).to_bytes(4, "little")
    df = spark.createDataFrame([(image, b"icc", b"exif")], "d binary, i binary, e binary")
    f = parse(bytes(df.select(mux.still(F.col("d"), F.lit(8), F.lit(6), icc=F.col("i"), exif=F.col("e")).alias("f")).first().f), "lenient")
    assert f.metadata == {"ICCP": b"icc", "EXIF": b"exif"} and f.format == "extended" and not f.error
    assert parse(bytes(df.select(mux.still(F.col("d"), F.lit(8), F.lit(6)).alias("f")).first().f)).format == "lossless"


def test_smallest_candidate(spark):
    df = spark.createDataFrame([(1, 0, b"abc"), (1, 1, b"ab"), (1, 2, b"cd"), (2, 0, b"x")], "k int, o int, data binary")
    assert sorted((r.k, r.o) for r in animation.smallest_candidate(df, ["k"], "o").collect()) == [(1, 1), (2, 0)]
