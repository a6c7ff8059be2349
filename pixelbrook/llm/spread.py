"""Equi-joins whose keys may be hot, spread over tasks whatever the size thresholds of the engine.

The keys that hold more than a ``SHARE``-th of all rows are fewer than ``SHARE``, at any size of the input: that bound lets
their list be broadcast. Rows of such a key are dealt over as many salts as it has such shares, and the other side's row is
repeated once for each. Keys below it can't fill a task by themselves, and are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys in the broadcast list are fewer than this.
SHARE = 100_000
#: Rows of a key that never count as many.
LEAST = 1000


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", total: int | None = None, least: int | None = None) -> DataFrame | None:
    """``(keys..., salts)`` of the hot keys of ``counts(keys..., n)``, which is read twice; None if there are none. ``counts``
    may leave out keys of up to ``LEAST`` rows if it is told the ``total`` of rows."""
    if total is None:
        total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    most = max(LEAST if least is None else least, -(-total // SHARE))
    hot = counts.where(F.col(n) > most).select(*keys, F.ceil(F.col(n) / most).cast("int").alias("salts"))
    return None if hot.isEmpty() else hot


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` on ``keys``; rows of hot keys are dealt out by the columns ``by``. Keys aren't null. Neither
    side has columns ``salt`` or ``salts``."""
    if hot is None:
        return rows.join(table, keys, how)
    few = F.broadcast(hot)
    rows = rows.join(few, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    table = table.join(few, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
    return rows.join(table, [*keys, "salt"], how).drop("salt")
