"""Little-endian fields and RIFF framing of BINARY columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_INPUT = 256 << 20
MAX_CHUNK = (1 << 32) - 10


def unsigned(data: Column, at, size: int) -> Column:
    """The ``size`` bytes from 0-based ``at``, least significant first, as BIGINT; null where they aren't all there."""
    at = at if isinstance(at, Column) else F.lit(at)
    parts = [F.substring(data, at + k + 1, F.lit(1)) for k in reversed(range(size))]
    value = F.conv(F.hex(F.concat(*parts)), 16, 10).cast("long")
    return F.when(F.length(data) >= at + size, value)


def little_endian(value: Column, size: int) -> Column:
    """The low ``size`` bytes of an integer as BINARY, least significant first."""
    value = value.cast("long")
    pairs = [F.lpad(F.hex(F.shiftright(value, 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)]
    return F.unhex(F.concat(*pairs))


def tail(data: Column, at) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.substring(data, at + 1, F.greatest(F.length(data) - at, F.lit(0)))


def padded(size: Column) -> Column:
    return size + size.bitwiseAND(1)


def chunk(fourcc: str | Column, payload: Column) -> Column:
    """A whole chunk: tag, size, payload and its pad byte."""
    tag = F.encode(F.lit(fourcc), "US-ASCII") if isinstance(fourcc, str) else F.encode(fourcc, "US-ASCII")
    pad = F.when(F.length(payload) % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    return F.concat(tag, little_endian(F.length(payload), 4), payload, pad)


def riff(*chunks: Column) -> Column:
    """A file of these chunks; null chunks are left out."""
    body = F.concat(*[F.coalesce(c, F.unhex(F.lit(""))) for c in chunks])
    return F.concat(F.encode(F.lit("RIFF"), "US-ASCII"), little_endian(F.length(body) + 4, 4), F.encode(F.lit("WEBP"), "US-ASCII"), body)


def riff_error(data: Column) -> Column:
    """Why the 12-byte file header is bad; null if it isn't."""
    size = unsigned(data, 4, 4)
    return (
        F.when(F.length(data) < 12, "truncated")
        .when(F.substring(data, 1, 4) != F.lit(b"RIFF"), "not a RIFF file")
        .when(size < 8, "not a RIFF file")
        .when(size > MAX_CHUNK, "file too large")
        .when(F.substring(data, 9, 4) != F.lit(b"WEBP"), "unknown form type")
    )


def fourcc(data: Column, at) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.decode(F.substring(data, at + 1, F.lit(4)), "ISO-8859-1")


def lossy_header(payload: Column) -> Column:
    """(width, height, error) of a lossy key frame's 10-byte header."""
    tag = unsigned(payload, 0, 3)
    error = (
        F.when(F.length(payload) < 10, "truncated")
        .when(tag.bitwiseAND(1) == 1, "not a key frame")
        .when(F.substring(payload, 4, 3) != F.lit(b"\x9d\x01\x2a"), "bad signature")
    )
    size = lambda at: unsigned(payload, at, 2).bitwiseAND(0x3FFF).cast("int")
    return F.struct(size(6).alias("width"), size(8).alias("height"), error.alias("error"))


def lossless_header(payload: Column) -> Column:
    """(width, height, has_alpha, error) of a lossless frame's 5-byte header."""
    word = unsigned(payload, 1, 4)
    error = (
        F.when(F.length(payload) < 5, "truncated")
        .when(F.substring(payload, 1, 1) != F.lit(b"\x2f"), "bad signature")
        .when(F.shiftright(word, 29) != 0, "bad version")
    )
    side = lambda k: (F.shiftright(word, k).bitwiseAND(0x3FFF) + 1).cast("int")
    return F.struct(side(0).alias("width"), side(14).alias("height"), (F.shiftright(word, 28).bitwiseAND(1) == 1).alias("has_alpha"), error.alias("error"))


def lossless_header_bytes(width: Column, height: Column, alpha: Column) -> Column:
    word = (width.cast("long") - 1) + F.shiftleft(height.cast("long") - 1, 14) + F.shiftleft(alpha.cast("long"), 28)
    return F.concat(F.unhex(F.lit("2F")), little_endian(word, 4))


def lossy_header_bytes(width: Column, height: Column) -> Column:
    return F.concat(F.unhex(F.lit("1000009D012A")), little_endian(width, 2), little_endian(height, 2))


def frame_header(payload: Column) -> Column:
    """Fields of an animation frame chunk's 16-byte prefix."""
    bits = unsigned(payload, 15, 1)
    return F.struct(
        (unsigned(payload, 0, 3) * 2).alias("x"), (unsigned(payload, 3, 3) * 2).alias("y"), (unsigned(payload, 6, 3) + 1).alias("w"), (unsigned(payload, 9, 3) + 1).alias("h"),
        unsigned(payload, 12, 3).alias("duration_ms"), bits.bitwiseAND(1).cast("int").alias("dispose"), F.shiftright(bits, 1).bitwiseAND(1).cast("int").alias("no_blend"),
    )


def frame_header_bytes(x: Column, y: Column, w: Column, h: Column, duration: Column, dispose: Column, no_blend: Column) -> Column:
    fields = [F.shiftright(x.cast("long"), 1), F.shiftright(y.cast("long"), 1), w - 1, h - 1, duration]
    return F.concat(*[little_endian(v, 3) for v in fields], little_endian(dispose.cast("long") + 2 * no_blend.cast("long"), 1))


#: Bits of the extended header's flags (format constants).
FLAGS = {"animation": 2, "xmp": 4, "exif": 8, "alpha": 16, "icc": 32}


def extended_flags(**present: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(p, FLAGS[n]).otherwise(0) for n, p in present.items()])


def extended_header_bytes(flags: Column, width: Column, height: Column) -> Column:
    return F.concat(little_endian(flags, 4), little_endian(width - 1, 3), little_endian(height - 1, 3))


def probe(data: Column) -> Column:
    """Features of a file of one image chunk, without decoding pixels; extended files need ``tables.frames``."""
    kind, size = fourcc(data, 12), unsigned(data, 16, 4)
    body = F.substring(data, F.lit(21), size.cast("int"))
    lossy, lossless = lossy_header(body), lossless_header(body)
    of = lambda name: F.when(kind == "VP8 ", lossy[name]).when(kind == "VP8L", lossless[name])
    error = F.coalesce(
        riff_error(data), F.when(F.length(data) < 20, "truncated"), F.when(~kind.isin("VP8 ", "VP8L", "VP8X"), "unknown chunk"), F.when(F.length(data) < size + 20, "truncated"),
        F.when(kind == "VP8 ", lossy["error"]).when(kind == "VP8L", lossless["error"]),
    )
    return F.struct(
        of("width").alias("width"), of("height").alias("height"), F.when(kind == "VP8L", lossless["has_alpha"]).otherwise(False).alias("has_alpha"),
        F.when(kind == "VP8 ", "lossy").when(kind == "VP8L", "lossless").when(kind == "VP8X", "extended").otherwise("unknown").alias("format"), error.alias("error"),
    )
