"""Kernels over tables: one Arrow pass each, or one for several in a row, a row of images in, a row out. A bad file gives an error, not a failed job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.container import Bad, parse
from . import alpha, lossless, lossy
from .bits import Corrupt

IMAGE = "width int, height int, data binary, error string"


def rgba(px: np.ndarray) -> bytes:
    """ARGB words to row-major R, G, B, A bytes."""
    return np.stack([(px >> np.uint32(n) & np.uint32(255)).astype(np.uint8) for n in (16, 8, 0, 24)], -1).tobytes()


def argb(data: bytes, width: int, height: int) -> np.ndarray:
    p = np.frombuffer(data, np.uint8).reshape(height, width, 4).astype(np.uint32)
    return p[..., 3] << np.uint32(24) | p[..., 0] << np.uint32(16) | p[..., 1] << np.uint32(8) | p[..., 2]


def decode_frame(data: bytes | None, alpha_data: bytes | None, lossless_: bool | None, tables: lossy.Tables | None = None) -> tuple:
    """(width, height, RGBA bytes, error) of a frame's bitstream; lossy ones need the format's probability tables."""
    if not data:
        return None, None, None, "frame without image"
    if not lossless_ and tables is None:
        return None, None, None, "lossy images need probability tables"
    try:
        if lossless_:
            px = lossless.decode(data)
            return px.shape[1], px.shape[0], rgba(px), None
        width, height, *planes = lossy.decode(data, tables)
        out = np.full((height, width, 4), 255, np.uint8)
        out[..., :3] = lossy.to_rgb(*planes)
        if alpha_data is not None:
            out[..., 3] = alpha.decode(alpha_data, width, height)
        return width, height, out.tobytes(), None
    except (Corrupt, Bad, IndexError, ValueError) as e:
        return None, None, None, str(e) or type(e).__name__


def decode_image(content: bytes | None, tables: lossy.Tables | None = None) -> tuple:
    """(width, height, RGBA bytes, error) of a file's first frame."""
    f = parse(content, "strict", max_frames=1)
    if f.error:
        return None, None, None, f.error
    if not f.frames:
        return None, None, None, "no frames"
    frame = f.frames[0]
    out = decode_frame(frame.data, frame.alpha_data, frame.lossless, tables)
    return out if out[0] is not None or not frame.data else (frame.w, frame.h, *out[2:])


def encode_image(data: bytes | None, width: int | None, height: int | None, quality: float = 75.0) -> tuple:
    """(file, error) of RGBA bytes; transparent pixels lose their colour."""
    if data is None or width is None or height is None:
        return None, "no image"
    if not (1 <= width <= 16383 and 1 <= height <= 16383):
        return None, "bad dimensions"
    if len(data) != 4 * width * height:
        return None, "size differs from the dimensions"
    px = argb(data, width, height).copy()
    px[px >> np.uint32(24) == 0] = 0
    body = lossless.encode(px, quality)
    body += b"\0" * (len(body) & 1)
    size = len(body)
    return b"RIFF" + (size + 12).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + body, None


def encode_lossy(data: bytes | None, width: int | None, height: int | None, quality: float, tables: lossy.Tables, alpha_quality: int = 100) -> tuple:
    """(file, error) of RGBA bytes: a lossy frame, and an alpha plane beside it if a pixel isn't opaque."""
    if data is None or width is None or height is None:
        return None, "no image"
    if not (1 <= width <= 16383 and 1 <= height <= 16383):
        return None, "bad dimensions"
    if len(data) != 4 * width * height:
        return None, "size differs from the dimensions"
    px = np.frombuffer(data, np.uint8).reshape(height, width, 4)
    q = lossy.quality_index(quality)
    frame = lossy.encode(*lossy.to_planes(px[..., :3]), q, tables, level=min(63, q // 3))
    chunk = lambda kind, body: kind + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    if (px[..., 3] == 255).all():
        body = chunk(b"VP8 ", frame)
    else:
        head = (16).to_bytes(4, "little") + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
        body = chunk(b"VP8X", head) + chunk(b"ALPH", alpha.encode(px[..., 3], alpha_quality)) + chunk(b"VP8 ", frame)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body, None


def kernel(df: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """``run`` over Arrow batches of these columns. On what another kernel gave it runs in that one's worker, batch by batch: a
    task has one worker for a row of kernels, and images don't pass through the JVM in between."""
    before = df.__dict__.get("_kernel")
    if before is None or df.is_cached or not set(columns) <= set(df.columns):
        rows, f = df.select(*columns), run
    else:
        rows, first = before

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return run(batch.select(columns) for batch in first(batches))

    out = rows.mapInArrow(f, schema)
    out._kernel = rows, f
    return out


def _each(df: DataFrame, key: str, columns: list[str], schema: str, kinds: list[pa.DataType], f) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # an image at a time: pixels are larger than files
                row = f(*(batch.column(1 + j)[k].as_py() for j in range(len(columns))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *(pa.array([v], t) for v, t in zip(row, kinds))], [key, *names])

    return kernel(df, [key, *columns], run, f"`{key}` {df.schema[key].dataType.simpleString()}, {schema}")


def decoded(files: DataFrame, key: str = "path", tables: lossy.Tables | None = None) -> DataFrame:
    """``files(key, content)`` -> ``(key, width, height, data, error)``."""
    return _each(files, key, ["content"], IMAGE, [pa.int32(), pa.int32(), pa.binary(), pa.string()], lambda c: decode_image(c, tables))


def frames_decoded(frames: DataFrame, tables: lossy.Tables | None = None) -> DataFrame:
    """``frames(anim_id, frame_idx, x, y, w, h, duration_ms, dispose, no_blend, lossless, data, alpha_data)``, as ``tables.frames``
    gives them, with RGBA bytes in ``data`` and ``to_background``; an image of another size than its frame's is an error."""
    kept = ["anim_id", "frame_idx", "x", "y", "w", "h", "duration_ms", "no_blend", F.col("dispose").cast("boolean").alias("to_background")]
    rows = frames.select(F.struct(*kept).alias("f"), "data", "alpha_data", "lossless", "w", "h")

    def one(data, alpha_data, lossless_, w, h):
        width, height, out, error = decode_frame(data, alpha_data, lossless_, tables)
        if error is None and (width, height) != (w, h):
            out, error = None, "frame size differs from its image"
        return out, error

    out = _each(rows, "f", ["data", "alpha_data", "lossless", "w", "h"], "data binary, error string", [pa.binary(), pa.string()], one)
    return out.select("f.*", "data", "error")


def encoded(images: DataFrame, key: str, quality: float = 75.0, tables: lossy.Tables | None = None) -> DataFrame:
    """``images(key, data, width, height)`` -> ``(key, content, error)``: lossless, or lossy if tables are given."""
    one = (lambda d, w, h: encode_image(d, w, h, quality)) if tables is None else (lambda d, w, h: encode_lossy(d, w, h, quality, tables))
    return _each(images, key, ["data", "width", "height"], "content binary, error string", [pa.binary(), pa.string()], one)


def alpha_encoded(planes: DataFrame, key: str, quality: int = 100, filtering: int = 1) -> DataFrame:
    """``planes(key, data, width, height)`` of one byte a pixel -> ``(key, alpha)``."""
    return _each(planes, key, ["data", "width", "height"], "alpha binary", [pa.binary()], lambda d, w, h: (alpha.encode(np.frombuffer(d, np.uint8).reshape(h, w), quality, 1, filtering),))


def alpha_decoded(planes: DataFrame, key: str) -> DataFrame:
    """``planes(key, alpha, width, height)`` -> ``(key, data, error)``."""
    def one(data, w, h):
        try:
            return alpha.decode(data or b"", w, h).tobytes(), None
        except (Corrupt, IndexError, ValueError) as e:
            return None, str(e) or type(e).__name__

    return _each(planes, key, ["alpha", "width", "height"], "data binary, error string", [pa.binary(), pa.string()], one)


def pixel_rows(images: DataFrame, key: str) -> DataFrame:
    """``images(key, width, height, data)`` -> ``(key, y, x, r, g, b, a)``, for analysis in SQL."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                w, h, data = (batch.column(j)[k].as_py() for j in (1, 2, 3))
                if data is None:
                    continue
                p = np.frombuffer(data, np.uint8).reshape(h * w, 4).astype(np.int32)
                for a in range(0, h * w, 65536):
                    at = np.arange(a, min(a + 65536, h * w))
                    keys = batch.column(0).take(pa.array(np.full(len(at), k)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(at // w), pa.array(at % w), *(pa.array(np.ascontiguousarray(p[at, c])) for c in range(4))], [key, "y", "x", "r", "g", "b", "a"])

    return kernel(images, [key, "width", "height", "data"], run, f"`{key}` {images.schema[key].dataType.simpleString()}, y long, x long, r int, g int, b int, a int")


def images_of(pixels: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Dense images of ``pixels(key, y, x, r, g, b, a)`` with unique places; places without a pixel are 0. An image's pixels come
    sorted to one task and are filled in; a row holds one image, so that bounds its memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, image = None, np.zeros(width * height, np.uint32)

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([held, pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([image.tobytes()], pa.binary())], [key, "width", "height", "data"])

        for batch in batches:
            keys = batch.column(0)
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0, np.int64)
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
            at, word = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint32)
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                one = keys.slice(a, 1)
                if held is None or one[0].as_py() != held[0].as_py():
                    if held is not None:
                        yield full()
                    held, image = one, np.zeros(width * height, np.uint32)
                image[at[a:b]] = word[a:b]
        if held is not None:
            yield full()

    channel = lambda c, n: F.col(c).cast("long") * (1 << n)  # noqa: E731  little-endian words are R, G, B, A bytes
    rows = pixels.select(key, (F.col("y") * width + F.col("x")).cast("int").alias("at"), (channel("r", 0) + channel("g", 8) + channel("b", 16) + channel("a", 24)).alias("word"))
    kind = rows.schema[key].dataType.simpleString()
    return kernel(rows.repartition(key).sortWithinPartitions(key, "at"), [key, "at", "word"], run, f"`{key}` {kind}, width int, height int, data binary")
