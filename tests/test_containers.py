"""Hand-built files in both dialects, malformed ones too."""

import random

import pytest

from pixelbrook.sources.container import parse


def chunk(kind, payload):
    return kind.encode() + len(payload).to_bytes(4, "little") + payload + b"\0" * (len(payload) & 1)


def riff(*chunks):
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def lossless(w, h, alpha=0):
    return b"\x2f" + ((w - 1) | (h - 1) << 14 | alpha << 28).to_bytes(4, "little")


def lossy(w, h):
    return b"\x10\0\0\x9d\x01\x2a" + w.to_bytes(2, "little") + h.to_bytes(2, "little")


def extended(flags, w, h):
    return chunk("VP8X", flags.to_bytes(4, "little") + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little"))


def anmf(x, y, w, h, ms, bits, *subs):
    return chunk("ANMF", b"".join(v.to_bytes(3, "little") for v in (x // 2, y // 2, w - 1, h - 1, ms)) + bytes([bits]) + b"".join(subs))


ANIM = chunk("ANIM", bytes.fromhex("000000ff") + (2).to_bytes(2, "little"))


@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_simple_files(mode):
    f = parse(riff(chunk("VP8L", lossless(100, 50, 1))), mode)
    assert (f.width, f.height, f.has_alpha, f.format, len(f.frames), f.error) == (100, 50, True, "lossless", 1, None)
    f = parse(riff(chunk("VP8 ", lossy(640, 480))), mode)
    assert (f.width, f.height, f.has_alpha, f.format, f.error) == (640, 480, False, "lossy", None)


@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_animation(mode):
    data = riff(extended(2, 32, 16), ANIM, anmf(0, 0, 32, 16, 40, 0, chunk("VP8L", lossless(32, 16))), anmf(4, 2, 8, 8, 60, 3, chunk("ALPH", b"\0abc"), chunk("VP8 ", lossy(8, 8))))
    f = parse(data, mode)
    assert (f.animated, f.loop, f.background, f.error) == (True, 2, 0xFF000000, None)
    a, b = f.frames
    assert (a.x, a.y, a.w, a.h, a.duration_ms, a.dispose, a.no_blend, a.lossless) == (0, 0, 32, 16, 40, 0, 0, True)
    assert (b.x, b.y, b.w, b.h, b.duration_ms, b.dispose, b.no_blend, b.has_alpha, b.alpha_data) == (4, 2, 8, 8, 60, 1, 1, True, b"\0abc")
    assert len(parse(data, mode, max_frames=1).frames) == 1


def test_dialects_differ():
    frame = anmf(0, 0, 8, 8, 10, 0, chunk("VP8L", lossless(8, 8)))
    early = riff(extended(2, 8, 8), frame, ANIM)
    assert parse(early, "strict").error == "frame before animation chunk" and not parse(early, "lenient").error
    late = riff(extended(8, 8, 8), chunk("VP8L", lossless(8, 8)), chunk("EXIF", b"abc"))
    assert parse(late, "strict").metadata == {} and parse(late, "lenient").metadata == {"EXIF": b"abc"}
    unknown = riff(extended(1, 8, 8), chunk("VP8L", lossless(8, 8)))
    assert parse(unknown, "strict").error == "unknown flags" and not parse(unknown, "lenient").error
    assert parse(riff(extended(2, 8, 8), ANIM), "strict").error is None
    assert parse(riff(extended(2, 8, 8), ANIM), "lenient").error == "no image"


@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_malformed_gives_error_not_exception(mode):
    rng = random.Random(5)
    good = riff(extended(2, 32, 16), ANIM, anmf(0, 0, 32, 16, 40, 0, chunk("VP8L", lossless(32, 16))))
    assert parse(None, mode).error and parse(b"", mode).error and parse(b"RIFF", mode).error
    for k in range(len(good)):
        parse(good[:k], mode)
    for _ in range(500):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        parse(bytes(bad), mode)


def test_tables(spark):
    from pixelbrook.sources import tables

    data = riff(extended(2, 32, 16), ANIM, anmf(0, 0, 32, 16, 40, 0, chunk("VP8L", lossless(32, 16))))
    files = spark.createDataFrame([("a", data), ("b", b"junk"), ("c", None)], "path string, content binary")
    assert {(r.path, r.fourcc) for r in tables.chunks(files).collect()} == {("a", "VP8X"), ("a", "ANIM"), ("a", "ANMF"), ("b", None), ("c", None)}
    rows = {r.path: r for r in tables.features(files).collect()}
    assert rows["a"].frame_count == 1 and rows["a"].has_animation and rows["b"].error and rows["c"].error
    tables.register(spark)
    files.createOrReplaceTempView("files_")
    assert spark.sql("SELECT path, f.w, f.h FROM files_, LATERAL raster_frames(content, 'strict') f WHERE f.error IS NULL").collect() == [("a", 32, 16)]


def test_files_source_and_sink(spark, tmp_path):
    from pixelbrook.sources import tables

    tables.register(spark)
    data = riff(chunk("VP8L", lossless(3, 2)))
    spark.createDataFrame([("x.webp", data), ("y.webp", data)], "name string, content binary").write.format("raster").mode("append").save(str(tmp_path))
    back = tables.files(spark, str(tmp_path))
    assert back.count() == 2 and {bytes(r.content) for r in back.collect()} == {data}
