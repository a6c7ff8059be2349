"""Jobs over folders of images: ``python -m pixelbrook enc|dec|info INPUT [OUTPUT] [--quality Q] [--tables FILE] [--master URL]``.

``enc`` turns PNG files into lossless ones (lossy ones with ``--tables``, the lossy format's probability tables), ``dec`` the
other way, ``info`` prints a line for each file. Each file is a row, so a folder is worked on by as many tasks as Spark has; files
keep their folders below the input; a bad file is reported and doesn't stop the job.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import columns, lossy
from .sources import png, tables


def _converted(files: DataFrame, suffix: str, convert, below: str = "") -> DataFrame:
    """``files(path, content)`` -> ``(name, content, error)``; names keep what follows the folder ``below``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = os.path.splitext(relative(path, below))[0] + suffix
                out, error = convert(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out], pa.binary()), pa.array([error], pa.string())], ["name", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "name string, content binary, error string")


def relative(path: str, below: str) -> str:
    """What follows the folder ``below`` in a path or URL of a file in it."""
    plain = lambda p: unquote(urlsplit(p).path if "://" in p or p.startswith("file:") else p)
    path, below = plain(path), os.path.abspath(plain(below)).rstrip("/") + "/"
    return path[len(below) :] if path.startswith(below) else os.path.basename(path)


def from_png(quality: float, probabilities: lossy.Tables | None = None):
    def convert(content: bytes):
        try:
            width, height, data = png.read(content)
        except (png.BadPng, ValueError) as e:
            return None, str(e)
        if probabilities is not None:
            return columns.encode_lossy(data, width, height, quality, probabilities)
        return columns.encode_image(data, width, height, quality)

    return convert


def to_png(probabilities: lossy.Tables | None = None):
    def convert(content: bytes):
        width, height, data, error = columns.decode_image(content, probabilities)
        return (png.write(width, height, data), None) if error is None else (None, error)

    return convert


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pixelbrook", description=__doc__)
    parser.add_argument("job", choices=("enc", "dec", "info"))
    parser.add_argument("input")
    parser.add_argument("output", nargs="?")
    parser.add_argument("--quality", type=float, default=75.0)
    parser.add_argument("--tables", help="JSON file of the lossy format's probability tables")
    parser.add_argument("--master")
    a = parser.parse_args(args)
    if a.job != "info" and not a.output:
        parser.error("an output folder is needed")
    if not 0 <= a.quality <= 100:
        parser.error("quality must be 0-100")
    if spark is None:
        builder = SparkSession.builder.appName("pixelbrook")
        spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    if a.job == "info":
        for r in tables.features(tables.files(spark, a.input)).orderBy("path").toLocalIterator():
            print(f"{r.path}: {r.error}" if r.error else f"{r.path}: {r.format}, {r.width} x {r.height}, alpha {r.has_alpha}, {r.frame_count} frame(s), loop {r.loop_count}")
        return 0
    tables.register(spark)
    probabilities = lossy.Tables.read(a.tables) if a.tables else None
    pattern, suffix, convert = ("*.png", ".webp", from_png(a.quality, probabilities)) if a.job == "enc" else ("*.webp", ".png", to_png(probabilities))
    done = _converted(tables.files(spark, a.input, pattern), suffix, convert, a.input).persist()
    done.where("error is null").select("name", "content").write.format("raster").mode("append").save(a.output)
    bad = 0
    for r in done.where(F.col("error").isNotNull()).select("name", "error").toLocalIterator():
        print(f"{r.name}: {r.error}", file=sys.stderr)
        bad = 1
    done.unpersist()
    return bad


if __name__ == "__main__":
    sys.exit(main())
