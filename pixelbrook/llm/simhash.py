"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a self-join of binary tries.

1. ``fingerprints``: one Arrow pass; XXH64 of each shingle, majority of each bit.
2. Documents of equal fingerprint are one class from here on.
3. ``links``: two fingerprints within 3 bits agree in at least one of four 16-bit blocks, so each class goes to four
   shards, one for each block; in a shard the tries below that block are joined with themselves: pairs of nodes are
   traversed together, the bits in which their paths differ are summed and pairs over the budget are pruned. A shard
   returns a spanning forest of the links that it found, so a large group gives as many rows as it has members. A shard of
   over ``SHARD_KEYS`` keys (there are 4 * 65536 shards, so their counts are bounded) is dealt out by the pairs of nodes that
   lie so many levels further down, each pair within the budget to a task of its own.
4. ``components`` joins the forests of all shards.

Defined results: null or blank text has fingerprint zero, linked like any other; repeated rows each get a row; a null
doc_id keeps its row and never becomes a component_id (null if a component has no other); texts are read whole, whatever
their length. Other columns are ignored, and keep their values in ``distinct_documents``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, column, unused, utf8
from .components import checkpointed, components

BITS, BLOCK_BITS, BUDGET, SEED, SHINGLE = 64, 16, 3, 42, 3
#: Most keys of a shard that one task joins, and most levels by which a larger one is dealt out.
SHARD_KEYS, DEEPER = 1 << 17, 12
#: Node pairs of at most so many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 16
#: Node pairs traversed at once.
FRONTIER = 1 << 19


def shingle_hashes(text: bytes | None) -> list[int]:
    words = text.lower().split() if text else []
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return [h(joined, SEED)]
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[: -SHINGLE]]
    return [h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list of shingle hashes."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    first = 0
    while first < len(hashes):  # some 100k shingles at once; a longer text in parts
        last, n = first + 1, sizes[first]
        while last < len(hashes) and n + sizes[last] <= 100_000:
            n += sizes[last]
            last += 1
        rows = [i for i in range(first, last) if sizes[i]]
        if rows:
            counts = np.zeros((len(rows), BITS), np.int64)
            if len(rows) == 1:
                flat = np.array(hashes[rows[0]], np.uint64)
                for a in range(0, len(flat), 100_000):
                    counts[0] += _bits(flat[a : a + 100_000]).sum(0, dtype=np.int64)
            else:
                flat = np.fromiter((x for i in rows for x in hashes[i]), np.uint64, int(n))
                starts = np.concatenate(([0], np.cumsum(sizes[rows])[:-1]))
                counts = np.add.reduceat(_bits(flat), starts, axis=0, dtype=np.int32)
            over = 2 * counts > sizes[rows][:, None]
            out[rows] = (over * weights).sum(1, dtype=np.uint64)
        first = last
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, body, fp)``, body a hash of the text, fp a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                fp = majority([shingle_hashes(t) for t in utf8(part)])
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "body"), pa.array(fp.view(np.int64))], ["doc_id", "body", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("body"), text.alias("text")).mapInArrow(run, "doc_id long, body long, fp long")


def trie_self_join(keys: np.ndarray, shared: int = BLOCK_BITS, budget: int = BUDGET, nodes: tuple[int, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``keys``: sorted distinct uint64. Index pairs i < j that share their first ``shared`` bits and differ in at most
    ``budget`` others. A trie node is a range of the sorted keys. With ``nodes`` only those are joined: two values of the
    first ``shared`` bits, or one with itself."""
    n = len(keys)
    if n < 2:
        return
    ones = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            bit = (keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
        return ones[depth]

    top = keys >> np.uint64(BITS - shared)
    if nodes is None:
        cuts = np.flatnonzero(top[1:] != top[:-1]) + 1
        lo, hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [n]))
        some = hi - lo > 1
        lo, hi = lo[some], hi[some]
        stack = [(shared, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))] if len(lo) else []
    else:
        ends = [int(np.searchsorted(top, np.uint64(x), side)) for x in nodes for side in ("left", "right")]
        stack = [(shared, np.array([[*ends, (nodes[0] ^ nodes[1]).bit_count()]]).T)] if ends[0] < ends[1] and ends[2] < ends[3] else []
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            stack += [(depth, pairs[:, i : i + FRONTIER]) for i in range(0, pairs.shape[1], FRONTIER)]
            continue
        a0, a1, b0, b1, err = pairs
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (depth == BITS)
        if small.any():
            i, j = _rectangles(a0[small], a1[small], b0[small], b1[small])
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, err = pairs[:, ~small]
        if not len(a0):
            continue
        s = ones_before(depth)
        am, bm = a1 - (s[a1] - s[a0]), b1 - (s[b1] - s[b0])
        same = a0 == b0  # a node with itself: one of the two crossings is enough
        cross = np.stack([am, a1, b0, bm, err + 1])[:, ~same]
        child = np.concatenate([np.stack([a0, am, b0, bm, err]), np.stack([am, a1, bm, b1, err]), np.stack([a0, am, bm, b1, err + 1]), cross], axis=1)
        live = (child[4] <= budget) & (child[1] > child[0]) & (child[3] > child[2]) & ~((child[0] == child[2]) & (child[1] - child[0] == 1))
        if live.any():
            stack.append((depth + 1, child[:, live]))


def _rectangles(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
    wide = b1 - b0
    size = (a1 - a0) * wide
    start = np.repeat(np.cumsum(size) - size, size)
    k = np.arange(size.sum()) - start
    wide = np.repeat(wide, size)
    i, j = np.repeat(a0, size) + k // wide, np.repeat(b0, size) + k % wide
    some = i < j
    return i[some], j[some]


def spanning_forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n indices is linked to, through any number of pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def deeper_by(n: int, most: int) -> int:
    """Levels after which a pair of nodes has about ``most`` of n keys at most."""
    return 0 if n <= most else min(DEEPER, max(1, math.ceil(math.log2(2 * n / most))))


def _turned(fp: np.ndarray, k: int) -> np.ndarray:
    turn = np.uint64(k * BLOCK_BITS)
    return (fp << turn) | (fp >> (np.uint64(BITS) - turn)) if k else fp


def _shard_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BITS // BLOCK_BITS << BLOCK_BITS, np.int64)
    for batch in batches:
        fp = column(batch, "fp").to_numpy().view(np.uint64)
        for k in range(BITS // BLOCK_BITS):
            counts += np.bincount((_turned(fp, k) >> np.uint64(BITS - BLOCK_BITS)).astype(np.int64) | k << BLOCK_BITS, minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["shard", "n"])


def _shards(levels):
    """Keys with their shard and, in a large one, each pair of deeper nodes that theirs is one of, as levels << 32 | a << 16 | b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = {d: np.array([x for x in range(1 << d) if x.bit_count() <= BUDGET], np.int64) for d in set(levels.value.values())}
        for batch in batches:
            fp = column(batch, "fp").to_numpy().view(np.uint64)
            for k in range(BITS // BLOCK_BITS):
                key = _turned(fp, k)
                shard = (key >> np.uint64(BITS - BLOCK_BITS)).astype(np.int64) | k << BLOCK_BITS
                pair = np.zeros(len(key), np.int64)
                parts = [(shard, pair, key)]
                if levels.value:
                    depth = np.array([levels.value.get(x, 0) for x in shard.tolist()], np.int64)
                    parts = [(shard[depth == 0], pair[depth == 0], key[depth == 0])]
                    for d in np.unique(depth[depth > 0]).tolist():
                        here = depth == d
                        own = (key[here] >> np.uint64(BITS - BLOCK_BITS - d)).astype(np.int64) & ((1 << d) - 1)
                        other = own[:, None] ^ near[d]
                        pairs = d << 32 | np.minimum(own[:, None], other) << 16 | np.maximum(own[:, None], other)
                        parts.append((np.repeat(shard[here], len(near[d])), pairs.ravel(), np.repeat(key[here], len(near[d]))))
                for a, b, c in parts:
                    # flipping the sign bit makes Spark's signed order that of the unsigned keys
                    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b), pa.array((c ^ np.uint64(1 << 63)).view(np.int64))], ["shard", "pair", "key"])

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, pair and key; whole shards are joined together, some 100k keys at a time, pairs of deeper
    nodes one by one."""
    held: list[np.ndarray] = []

    def found(block: int, key: np.ndarray, pairs: Iterator) -> pa.RecordBatch:
        root = spanning_forest(len(key), pairs)
        some = np.flatnonzero(root != np.arange(len(key)))
        turn = np.uint64(block * BLOCK_BITS)
        back = lambda x: ((x >> turn) | (x << (np.uint64(BITS) - turn)) if turn else x).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(back(key[some])), pa.array(back(key[root[some]]))], ["u", "v"])

    def joined(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = rows[2].view(np.uint64) ^ np.uint64(1 << 63)
        plain = rows[1] == 0
        for block in np.unique(rows[0][plain] >> BLOCK_BITS).tolist():  # keys of different blocks are turned differently
            key = keys[plain & (rows[0] >> BLOCK_BITS == block)]
            yield found(block, key, trie_self_join(key))
        rest = np.flatnonzero(~plain)
        cuts = np.flatnonzero((np.diff(rows[0, rest]) != 0) | (np.diff(rows[1, rest]) != 0)) + 1
        for one in np.split(rest, cuts) if len(rest) else ():
            shard, pair = int(rows[0, one[0]]), int(rows[1, one[0]])
            depth, top = pair >> 32, (shard & ((1 << BLOCK_BITS) - 1)) << (pair >> 32)
            nodes = top | pair >> 16 & 0xFFFF, top | pair & 0xFFFF
            yield found(shard >> BLOCK_BITS, keys[one], trie_self_join(keys[one], BLOCK_BITS + depth, nodes=nodes))

    for batch in batches:
        held.append(np.stack([column(batch, c).to_numpy().astype(np.int64) for c in ("shard", "pair", "key")]))
        if sum(x.shape[1] for x in held) >= 100_000:
            rows = np.concatenate(held, axis=1)
            whole = int(np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))[-1]) + 1 if (rows[:2] != rows[:2, -1:]).any() else 0
            if whole:
                yield from joined(rows[:, :whole])
            held = [rows[:, whole:]]
    if held and sum(x.shape[1] for x in held):
        yield from joined(np.concatenate(held, axis=1))


def links(classes: DataFrame, most: int = SHARD_KEYS) -> DataFrame:
    """Distinct ``classes(fp)`` -> edges ``(u, v)`` with the same connected components as all links within the budget."""
    sizes = classes.select("fp").mapInArrow(_shard_sizes, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    levels = classes.sparkSession.sparkContext.broadcast({r.shard: deeper_by(r.n, most) for r in sizes.collect()})
    shards = classes.select("fp").mapInArrow(_shards(levels), "shard int, pair long, key long")
    return shards.repartition("shard", "pair").sortWithinPartitions("shard", "pair", "key").mapInArrow(_forest, "u long, v long")


def classes_named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, body, fp)`` of each document, body a hash of its text, and ``(class, root)`` of each fingerprint."""
    fps = checkpointed(fingerprints(docs))
    classes = fps.select("fp").distinct()
    roots = components(links(classes))
    return fps, classes.join(roots, classes.fp == roots.node, "left").select(F.col("fp").alias("class"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fingerprint, component_id)``, one row per document."""
    fps, named = classes_named(docs)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = named.join(first, F.col("class") == first.fp).select("class", "root", "first")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("class", "component_id")
    return fps.join(named, fps.fp == named["class"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of each group, all columns kept: that of the smallest doc_id (null last), then of the least hash of the text."""
    fps, named = classes_named(docs)
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("first")
    first = fps.groupBy("fp").agg(order)
    kept_id, kept_body, of = (unused(docs, n) for n in ("kept_id", "kept_body", "of"))
    kept = first.join(named, first.fp == named["class"]).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(kept_id), F.col("first.body").alias(kept_body))
    body = F.xxhash64(F.col("text").cast("string"))
    kept = docs.withColumn(of, body).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(of) == F.col(kept_body)), "left_semi")
    return kept.dropDuplicates(["doc_id", of]).drop(of)
