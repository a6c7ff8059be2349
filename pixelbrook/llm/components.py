"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Every step is a join and a min-aggregation, so no node's neighbours are ever gathered in one place; a hub is split by
Spark's skew-join handling. Lineage is cut with ``checkpoint()`` into the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint_dir(spark) -> None:
    """Take the cluster's ``spark.checkpoint.dir``. Where none is set, a folder of this machine serves only if executors share
    it with the driver, that is in local mode; a cluster without the setting is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = "/tmp/checkpoints"
        context.setCheckpointDir(path)


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table_path(spark) -> str:
    """A new path in the session's checkpoint folder, which goes as its checkpoints do."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: more compact than a checkpoint, and as safe to read again."""
    spark, path = df.sparkSession, table_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of orderable ids -> ``(node, root)`` for every node of an edge, ``root`` the smallest node of its
    component. Loops and repeated edges are allowed; nulls are dropped."""
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's smaller neighbours are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        edges = checkpointed(small)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
