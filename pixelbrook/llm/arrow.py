"""Helpers shared by the operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def blocks(batch: pa.RecordBatch, name: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of ``name`` each (a longer value has a slice of its own)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


@contextmanager
def small_batches(spark, most: int = BLOCK_BYTES) -> Iterator[None]:
    """For jobs that run meanwhile, batches that go to Python end with the row that brings them to ``most`` bytes; otherwise
    they may hold 10,000 rows of any length, and the JVM and Python have a copy each, outside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The values' UTF-8 bytes."""
    return column(batch, name).cast(pa.binary()).to_pylist()


def joined_bytes(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All values' bytes in one array, and where each starts and the last ends (null: empty)."""
    values = pc.fill_null(column(batch, name).cast(pa.binary()), b"")
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 on division by 3; such rows' labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    k, out = 0, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def read(spark, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df
