"""Assembling files from frames and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binary as B

# Least and most of the fields that the format bounds.
BOUNDS = {"loop": (0, 65535), "duration": (0, 0xFFFFFF), "canvas": (0, 1 << 24)}
MAX_FRAMES, MAX_AREA = 10_000, 1 << 30


def clamped(value: Column, field: str) -> Column:
    low, high = BOUNDS[field]
    return F.least(F.greatest(value, F.lit(low)), F.lit(high)).cast("long")


def split_alpha(data: Column) -> tuple[Column, Column]:
    """(payload of a leading alpha chunk or null, the bitstream) of a frame's bytes."""
    size = B.unsigned(data, 4, 4)
    has = (B.fourcc(data, 0) == "ALPH") & (F.length(data) >= size + 8)
    return F.when(has, F.substring(data, F.lit(9), size.cast("int"))), F.when(has, B.tail(data, (8 + B.padded(size)).cast("int"))).otherwise(data)


def bitstream_kind(data: Column) -> Column:
    return F.when(F.substring(data, 1, 1) == F.lit(b"\x2f"), "VP8L").otherwise("VP8 ")


def still(data: Column, width: Column, height: Column, icc: Column | None = None, exif: Column | None = None, xmp: Column | None = None) -> Column:
    """A file of one image; extended only if it has alpha beside a lossy image, or metadata. Null if it is beyond 32-bit sizes."""
    alpha, image = split_alpha(data)
    none = F.lit(None).cast("binary")
    icc, exif, xmp = (none if m is None else m for m in (icc, exif, xmp))
    kind = bitstream_kind(image)
    has_alpha = alpha.isNotNull() | ((kind == "VP8L") & F.coalesce(B.lossless_header(image)["has_alpha"], F.lit(False)))
    head = B.extended_header_bytes(B.extended_flags(xmp=xmp.isNotNull(), exif=exif.isNotNull(), alpha=has_alpha, icc=icc.isNotNull()), width, height)
    extended = B.riff(B.chunk("VP8X", head), B.chunk("ICCP", icc), B.chunk("ALPH", alpha), B.chunk(kind, image), B.chunk("EXIF", exif), B.chunk("XMP ", xmp))
    size = sum((F.coalesce(F.length(m), F.lit(0)).cast("long") + 9 for m in (data, icc, exif, xmp)), F.lit(30).cast("long"))
    out = F.when(alpha.isNull() & icc.isNull() & exif.isNull() & xmp.isNull(), B.riff(B.chunk(kind, image))).otherwise(extended)
    return F.when(size <= B.MAX_CHUNK, out)


def animated(frames: DataFrame, loop: int = 0, background: int = 0, canvas: tuple[int, int] | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """``frames(anim_id, frame_idx, x, y, w, h, duration_ms, dispose, no_blend, data)``, ``metadata(anim_id, icc, exif, xmp)`` ->
    ``(anim_id, content, error)``. The canvas is the given one, which all frames must fit, or that of all frames.

    A file is one value, so its frames meet in one row; the format's own bounds (10 000 frames, 32-bit size) bound it, and
    a count before the bytes are gathered turns longer animations into an error row without gathering them.
    """
    alpha, image = split_alpha(F.col("data"))
    head = B.frame_header_bytes(F.col("x"), F.col("y"), F.col("w"), F.col("h"), clamped(F.col("duration_ms"), "duration"), F.col("dispose").cast("int"), F.col("no_blend").cast("int"))
    body = F.concat(head, F.coalesce(B.chunk("ALPH", alpha), F.unhex(F.lit(""))), B.chunk(bitstream_kind(image), image))
    has_alpha = alpha.isNotNull() | F.coalesce(B.lossless_header(image)["has_alpha"], F.lit(False))
    size = frames.groupBy("anim_id").agg(F.count("*").alias("n"), F.max(F.col("x") + F.col("w")).alias("cw"), F.max(F.col("y") + F.col("h")).alias("ch"), F.sum(F.length("data")).alias("bytes"), F.bool_or(F.coalesce(F.length("data"), F.lit(0)) == 0).alias("empty"), F.max(F.col("w").cast("long") * F.col("h")).alias("area"))
    cw, ch = (F.lit(clamp) if canvas else F.greatest(c, F.lit(1)) for clamp, c in zip(canvas or (0, 0), ("cw", "ch")))
    error = (
        F.when(F.col("empty"), "empty frame").when(F.col("n") > MAX_FRAMES, "too many frames").when((F.col("cw") > cw) | (F.col("ch") > ch), "frame outside the canvas")
        .when((cw > BOUNDS["canvas"][1]) | (ch > BOUNDS["canvas"][1]) | (cw.cast("long") * ch >= MAX_AREA) | (F.col("area") >= MAX_AREA), "canvas too large")
        .when(F.col("bytes") > B.MAX_INPUT, "file too large")
    )
    size = size.withColumn("error", error)
    good = frames.join(size.where("error is null").select("anim_id"), "anim_id", "left_semi")
    rows = good.select("anim_id", "frame_idx", F.hex(B.chunk("ANMF", body)).alias("c"), has_alpha.alias("alpha"))
    # joined once: adding frame to frame would copy the file as often as it has frames
    lists = rows.groupBy("anim_id").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "c"))).alias("cs"), F.bool_or("alpha").alias("alpha"))
    joined = F.unhex(F.array_join(F.transform("cs", lambda c: c["c"]), ""))
    params = F.concat(B.little_endian(F.lit(background), 4), B.little_endian(clamped(F.lit(loop), "loop"), 2))
    out = size.join(lists.select("anim_id", "alpha", joined.alias("frames")), "anim_id", "left")
    none = F.lit(None).cast("binary")
    out = out.join(metadata.select("anim_id", "icc", "exif", "xmp"), "anim_id", "left") if metadata is not None else out.withColumns({c: none for c in ("icc", "exif", "xmp")})
    flags = B.extended_flags(animation=F.lit(True), alpha=F.col("alpha"), icc=F.col("icc").isNotNull(), exif=F.col("exif").isNotNull(), xmp=F.col("xmp").isNotNull())
    content = B.riff(B.chunk("VP8X", B.extended_header_bytes(flags, cw, ch)), B.chunk("ICCP", F.col("icc")), B.chunk("ANIM", params), F.col("frames"), B.chunk("EXIF", F.col("exif")), B.chunk("XMP ", F.col("xmp")))
    return out.select("anim_id", F.when(F.col("error").isNull(), content).alias("content"), "error")


def closed(animations: DataFrame, stills: DataFrame) -> DataFrame:
    """An animation of one frame goes as a still file if that is smaller: ``animations(anim_id, n_frames, content)`` and
    ``stills(anim_id, still)`` -> ``(anim_id, content)``."""
    both = animations.join(stills, "anim_id", "left")
    smaller = (F.col("n_frames") == 1) & F.coalesce(F.length("still") < F.length("content"), F.lit(False))
    return both.select("anim_id", F.when(smaller, F.col("still")).otherwise(F.col("content")).alias("content"))
