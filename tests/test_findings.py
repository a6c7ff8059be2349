"""Rows on which queries once differed from their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pixelbrook.codec import columns
from pixelbrook.plans import queries


def same_as_sql(spark, folder, table, name):
    duck = duckdb.connect()
    duck.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    df, rel = queries.QUERIES[name](spark, str(folder)), duck.sql(queries.ORACLE_SQL[name])
    found = df.select(*rel.columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, rel.fetchall()))


@pytest.fixture(scope="module")
def vectors(tmp_path_factory):
    """Hundredths, which single precision takes to a whole number a hundred times over, and short and missing vectors."""
    folder = tmp_path_factory.mktemp("vectors")
    rows = [np.arange(k, k + 32).astype(np.float32) / np.float32(100) for k in (-60, -16, 0, 29, 57)] + [np.full(16, 0.29, np.float32), np.full(3, 0.29, np.float32), [], None]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["block_dct", "dct_roundtrip", "texture_distortion", "walsh_hadamard"])
def test_vectors_in_single_precision(spark, vectors, name):
    same_as_sql(spark, vectors, "embeddings", name)


def test_frame_headers_are_made_once(spark):
    """Each header has six fields of bytes; made anew for each byte that is read, they took minutes for 600,000 rows."""
    plan = queries.QUERIES["frame_header_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unhex(") == 6


def test_kernels_in_a_row_share_a_worker(spark):
    """Each kernel by itself had a Python process of its own in each running task."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    df = queries.QUERIES["lossless_roundtrip"](spark, "/root/testdata/sf0.001")
    assert plan(df).count("MapInArrow") == 1
    kept = columns.encoded(columns.images_of(queries.tiles(spark, "/root/testdata/sf0.001"), "image_id", 16, 16), "image_id").cache()
    both = columns.decoded(kept, "image_id")
    assert "InMemoryRelation" in both._jdf.queryExecution().withCachedData().toString()  # what is cached isn't made again
    assert both.where("error is null").count() == kept.count() > 0
    kept.unpersist()
