"""A folder of image files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.container import MAX_INPUT
from ..sources.tables import features

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*.webp", per_trigger: int = 1000) -> DataFrame:
    """``(path, modificationTime, length, content)`` of new files, at most ``per_trigger`` of them in a batch."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder).where(F.col("length") <= MAX_INPUT)


def probed(stream: DataFrame, mode: str = "strict") -> DataFrame:
    """Features of each arriving file; stateless, so any output mode and any sink will do."""
    return features(stream, "path", mode)


def format_counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes by arrival window; the watermark bounds the state."""
    return stream.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
