"""Token counts from an exact length histogram.

Documents are encoded where they lie and aggregated, before any shuffle, to rows (length, documents). The histogram has
one row for each length that occurs. Suffix sums over it answer everything: totals, quantiles, and how many tokens
are left when every document is cut to a context limit. They are taken in two levels (blocks of lengths, then lengths in
a block), so no task gets more rows than a block holds or there are blocks.

Defined results: null and empty texts have length 0; repeated rows count each; texts are encoded whole, whatever their length;
other columns, whatever their names, are ignored; an empty table has an empty histogram.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import blocks, utf8
from .components import written

#: A rank file of a byte-level BPE, by default that of the public tokenizers' package.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The way that vocabulary's words are split before merging (a fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 512
_encoders: dict[tuple[str, str], object] = {}


def encoder(path: str = RANKS, pattern: str = PATTERN):
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def lengths(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``docs(text)`` -> ``(n_tokens, n_docs)``, a row for each length and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode_ordinary
        seen: Counter[int] = Counter()
        for batch in batches:
            for part in blocks(batch):
                seen.update(len(encode(t.decode())) if t else 0 for t in utf8(part))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (list(seen.keys()), list(seen.values()))], ["n_tokens", "n_docs"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "n_tokens long, n_docs long")


def histogram(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    return lengths(docs, path, pattern).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """``hist(n_tokens, n_docs)`` with, for the context limit L = n_tokens: ``docs_over`` and ``tokens_over`` (documents longer
    than L and their tokens), ``tokens_at_limit`` (all tokens, each document cut to L), ``tokens_lost`` (those cut off),
    ``docs_total``, ``tokens_total``, and ``quantile`` (share of documents of at most L tokens)."""
    hist = written(hist)  # small, and read twice: texts are encoded once
    hist = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / block).alias("block"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    sums = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are blocks
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    sums = sums.select("block", F.coalesce(F.sum("d").over(later), zero).alias("d"), F.coalesce(F.sum("t").over(later), zero).alias("t"), F.sum("d").over(every).alias("docs_total"), F.sum("t").over(every).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        hist.join(sums, "block")
        .withColumn("docs_over", F.col("d") + F.coalesce(F.sum("n_docs").over(inside), zero))
        .withColumn("tokens_over", F.col("t") + F.coalesce(F.sum("tokens").over(inside), zero))
        .withColumn("tokens_lost", F.col("tokens_over") - F.col("docs_over") * F.col("n_tokens"))
        .select(
            "n_tokens", "n_docs", "docs_over", "tokens_over", (F.col("tokens_total") - F.col("tokens_lost")).alias("tokens_at_limit"), "tokens_lost", "docs_total", "tokens_total",
            (1 - F.col("docs_over") / F.col("docs_total")).alias("quantile"),
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``(context_limit, docs_over, tokens_at_limit)`` for any limits, whether or not a document has that length."""
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    above = sums.join(F.broadcast(wanted), F.col("n_tokens") > F.col("context_limit")).groupBy("context_limit").agg(F.sum("n_docs").alias("docs_over"), F.sum((F.col("n_tokens") - F.col("context_limit")) * F.col("n_docs")).alias("lost"))
    total = sums.agg(F.coalesce(F.max("tokens_total"), F.lit(0)).alias("tokens_total"))
    zero = F.lit(0).cast("long")
    return wanted.join(above, "context_limit", "left").join(F.broadcast(total)).select("context_limit", F.coalesce("docs_over", zero).alias("docs_over"), (F.col("tokens_total") - F.coalesce("lost", zero)).alias("tokens_at_limit"))


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of all documents don't exceed."""
    return sums.where((F.col("docs_total") - F.col("docs_over")) >= F.ceil(F.lit(float(share)) * F.col("docs_total"))).agg(F.min("n_tokens").alias("n_tokens"))
