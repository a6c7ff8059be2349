"""Files as tables: reading, chunks, frames and features as DataFrames, the same as lateral table functions for SQL, and a
sink that writes one file for each row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..codec.columns import kernel
from .container import MAX_INPUT, metadata as payload_of, parse

CHUNK = "idx int, fourcc string, offset long, size long, data binary, error string"
FRAME = "frame_idx int, x int, y int, w int, h int, duration_ms long, dispose int, no_blend int, has_alpha boolean, lossless boolean, data binary, alpha_data binary, error string"
FEATURES = "width int, height int, has_alpha boolean, has_animation boolean, format string, loop_count int, frame_count int, background long, error string"


def files(spark: SparkSession, path: str, pattern: str = "*.webp", most: int = MAX_INPUT) -> DataFrame:
    """``(path, length, content)``; the bound on length is pushed down, so larger files aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most).select("path", "length", "content")


def _chunk_rows(data: bytes | None, mode: str):
    f = parse(data, mode)
    rows = [(i, k, at, n, p, None) for i, k, at, n, p in f.chunks]
    return rows + [(len(rows), None, None, None, None, f.error)] if f.error and (mode == "strict" or not rows) else rows


def _frame_rows(data: bytes | None, mode: str, most: int | None):
    f = parse(data, mode, most)
    rows = [(i, r.x, r.y, r.w, r.h, r.duration_ms, r.dispose, r.no_blend, r.has_alpha, r.lossless, r.data or None, r.alpha_data, None) for i, r in enumerate(f.frames)]
    return rows + [(len(rows), *[None] * 11, f.error)] if f.error else rows


def _feature_rows(data: bytes | None, mode: str):
    f = parse(data, mode)
    return [(f.width, f.height, f.has_alpha, f.animated, f.format, f.loop, len(f.frames), f.background, f.error)]


def _lateral(df: DataFrame, key: str, schema: str, rows) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time: cells are large
                found = rows(batch.column(1)[k].as_py())
                keys = batch.column(0).take(pa.array([k] * len(found), pa.int64()))
                cols = zip(*found) if found else [()] * len(names)
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(cols, types))], [key, *names])

    return kernel(df, [key, "content"], run, f"`{key}` {df.schema[key].dataType.simpleString()}, {schema}")


def chunks(df: DataFrame, key: str = "path", mode: str = "lenient") -> DataFrame:
    return _lateral(df, key, CHUNK, lambda data: _chunk_rows(data, mode))


def frames(df: DataFrame, key: str = "path", mode: str = "strict", max_frames: int | None = None) -> DataFrame:
    return _lateral(df, key, FRAME, lambda data: _frame_rows(data, mode, max_frames))


def features(df: DataFrame, key: str = "path", mode: str = "strict") -> DataFrame:
    return _lateral(df, key, FEATURES, lambda data: _feature_rows(data, mode))


def metadata(df: DataFrame, *fourccs: str, key: str = "path", mode: str = "strict") -> DataFrame:
    """``(key, fourcc, data)``: the payloads of these chunks of each file, without those that it lacks."""
    def rows(data: bytes | None):
        f = parse(data, mode)
        return [(c, p) for c in fourccs if (p := payload_of(f, c)) is not None]

    return _lateral(df, key, "fourcc string, data binary", rows)


def config(df: DataFrame, key: str = "path") -> DataFrame:
    """``(key, colour_model, width, height, error)`` of what decoding would give, from headers alone: planes for a lossy image
    without alpha, else RGBA."""
    def rows(data: bytes | None):
        f = parse(data, "strict", 1)
        if f.error:
            return [(None, None, None, f.error)]
        plain = not f.frames[0].lossless and f.frames[0].alpha_data is None if f.frames else not f.has_alpha
        return [("ycbcr" if plain else "rgba", f.width, f.height, None)]

    return _lateral(df, key, "colour_model string, width int, height int, error string", rows)


class _Chunks:
    def eval(self, content: bytes, mode: str):
        yield from _chunk_rows(content, mode or "strict")


class _Frames:
    def eval(self, content: bytes, mode: str):
        yield from _frame_rows(content, mode or "strict", None)


class _Features:
    def eval(self, content: bytes, mode: str):
        yield from _feature_rows(content, mode or "strict")


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool):
        self.folder, self.names = folder, schema.names

    def write(self, iterator) -> WriterCommitMessage:
        import os

        name, content = self.names.index("name"), self.names.index("content")
        for row in iterator:
            if row[content] is None:
                continue
            parts = [p for p in row[name].split("/") if p]
            if ".." in parts or not parts:
                raise ValueError(f"not a name below the folder: {row[name]!r}")
            target = os.path.join(self.folder, *parts)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(f"{target}.part", "wb") as f:
                f.write(row[content])
            os.replace(f"{target}.part", target)  # a task that is run again leaves the same file
        return WriterCommitMessage()


class ImageFiles(DataSource):
    """``df.write.format("raster").mode("append").save(folder)``: rows ``(name, content)``, one file each; a name may have folders
    of its own, and a file of the same name is replaced. The folder must be one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """SQL names: ``SELECT f.* FROM files, LATERAL raster_frames(content, 'strict') f``."""
    for name, cls, schema in (("raster_chunks", _Chunks, CHUNK), ("raster_frames", _Frames, FRAME), ("raster_features", _Features, FEATURES)):
        spark.udtf.register(name, F.udtf(cls, returnType=schema.replace(" long", " bigint")))
    spark.dataSource.register(ImageFiles)
