"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over whole documents.

A window is 13 consecutive words of an item, or all words of a shorter item. Words are ids of the benchmark's
vocabulary; a document's runs of known words are hashed window by window, looked up, and a hit is verified word by word.

The set is broadcast only up to ``SET_BYTES`` of benchmark text. A larger benchmark is dealt into parts of at most that
size, for which the documents are read one part after the other; only hits are written, and joined to the documents at the
end, by two 64-bit hashes of id and text.

Defined results: null or wordless documents have no words and no hits; a null item text has no window; a null item_id counts as
an item named by the empty text; items of equal text all count; repeated rows each get a row; texts are scanned whole; other
columns are ignored by ``report`` and keep their values in ``scan`` and ``remove``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, column, unused, utf8
from .components import written

WINDOW = 13
#: Most bytes of benchmark text whose windows are broadcast at once.
SET_BYTES = 16 << 20
#: A document goes if at least one in so many of its words is hit.
SHARE = 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

_HIT, _ITEMS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string())
NAMES = ("n_words", "hit", "items")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WindowSet:
    """The windows of some items: ``ids`` of the vocabulary, and by length the sorted hashes and the exact windows."""

    def __init__(self, items: list[tuple[str, bytes | None]]):
        self.ids: dict[bytes, int] = {}
        self.exact: dict[int, dict[bytes, list[str]]] = {}
        for item, text in items:
            w = np.array([self.ids.setdefault(x, len(self.ids)) for x in words(text)], np.int32)
            if n := min(WINDOW, len(w)):
                windows = self.exact.setdefault(n, {})
                for i in range(len(w) - n + 1):
                    found = windows.setdefault(w[i : i + n].tobytes(), [])
                    if item not in found:
                        found.append(item)
        self.hashes = {n: np.unique(rolling(np.frombuffer(b"".join(x), np.int32), n)[::n]) for n, x in self.exact.items()}

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, length, items) of each occurrence in a sequence of ids, -1 where a word isn't known."""
        known = np.concatenate(([0], np.cumsum(ids >= 0, dtype=np.int32)))
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(starts):
                continue
            h = rolling_at(ids, starts, n)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            exact = self.exact[n]
            for i in starts[hashes[at] == h].tolist():
                if found := exact.get(ids[i : i + n].tobytes()):
                    yield i, n, found


def rolling_at(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for k in range(n):
        h = (h + ids[starts + k].astype(np.uint64) + np.uint64(1)) * _BASE
        h ^= h >> np.uint64(29)
    return h


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    return rolling_at(ids, np.arange(len(ids) - n + 1), n)


def leaked(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def _found(windows: WindowSet, seqs: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Merged hits and items of each sequence of words."""
    get = windows.ids.get
    sizes = np.array([len(s) for s in seqs], np.int64)
    ends = np.cumsum(sizes + 1)
    ids = np.full(int(ends[-1]), -1, np.int32)  # a stop after each document
    starts = ends - sizes - 1
    for a, s in zip(starts.tolist(), seqs):
        ids[a : a + len(s)] = [get(w, -1) for w in s]
    hit: list[list[tuple[int, int]]] = [[] for _ in seqs]
    items: list[set[str]] = [set() for _ in seqs]
    for at, n, found in windows.find(ids):
        k = int(np.searchsorted(ends, at, side="right"))
        hit[k].append((at - int(starts[k]), at - int(starts[k]) + n))
        items[k].update(found)
    return [merged(h) for h in hit], items


def _hits(hit: list[list[tuple[int, int]]], items: list[set[str]]) -> tuple[pa.Array, pa.Array]:
    return pa.array([[{"start": a, "stop": b} for a, b in h] for h in hit], _HIT), pa.array([sorted(x) for x in items], _ITEMS)


def _scan_batches(shared, names: tuple[str, str, str], cut: bool):
    """Adds the hits of a set, or, without one, those that come with the rows (columns ``names[1:]``); with ``cut``, hit words are
    cut from texts that aren't leaked as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                seqs = [words(t) for t in utf8(part)]
                if shared is not None:
                    hit, items = _found(shared.value, seqs)
                else:
                    hit = [merged([(x["start"], x["stop"]) for x in v or ()]) for v in column(part, names[1]).to_pylist()]
                    items = [set(v or ()) for v in column(part, names[2]).to_pylist()]
                out = {c: column(part, c) for c in part.schema.names if c not in names}
                if cut and any(hit):
                    texts = out["text"].to_pylist()
                    for k, h in enumerate(hit):
                        if h and not leaked(sum(b - a for a, b in h), len(seqs[k])):
                            texts[k] = cut_spans(texts[k], h)
                    out["text"] = pa.array(texts, part.schema.field("text").type)
                out[names[0]] = pa.array([len(s) for s in seqs], pa.int64())
                out[names[1]], out[names[2]] = _hits(hit, items)
                yield pa.RecordBatch.from_pydict(out)

    return run


def _only_hits(shared):
    """``(row1, row2, text)`` -> ``(row1, row2, hit, items)`` of rows with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                hit, items = _found(shared.value, [words(t) for t in utf8(part)])
                some = pa.array([k for k, h in enumerate(hit) if h], pa.int64())
                yield pa.RecordBatch.from_arrays([*(x.take(some) for x in (column(part, "row1"), column(part, "row2"), *_hits(hit, items)))], ["row1", "row2", "hit", "items"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_parts(benchmark: DataFrame, most: int = SET_BYTES) -> Iterator[tuple[int, list[tuple[str, bytes | None]]]]:
    """The number of parts, and the items in parts of about ``most`` bytes, one at a time on the driver."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").cast("binary").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // most)) if total > most else 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield n, [(r.item if r.item is not None else "", bytes(r.text)) for r in part.collect()]


def scan(docs: DataFrame, benchmark: DataFrame, most: int = SET_BYTES, cut: bool = False, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the number of words, the merged ranges of hit word numbers and the items added, under these
    ``names``, one of which in ``docs`` already is an error; with ``cut``, texts that aren't leaked as a whole come without
    their hit words."""
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    spark = docs.sparkSession
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{names[0]}` long, `{names[1]}` array<struct<start:int,stop:int>>, `{names[2]}` array<string>"])
    text, doc_id = F.col("text").cast("string"), F.col("doc_id")
    key = (F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), doc_id, text))
    found = None
    for n, part in benchmark_parts(benchmark, most):
        shared = spark.sparkContext.broadcast(WindowSet(part))
        if n == 1:
            return docs.mapInArrow(_scan_batches(shared, names, cut), schema)
        here = docs.select(key[0].alias("row1"), key[1].alias("row2"), text.alias("text"))
        here = written(here.mapInArrow(_only_hits(shared), "row1 long, row2 long, hit array<struct<start:int,stop:int>>, items array<string>"))
        shared.destroy()
        found = here if found is None else found.unionByName(here)
    rows = tuple(unused(docs, c) for c in ("row1", "row2"))
    lists = (F.flatten(F.collect_list("hit")).alias(names[1]), F.flatten(F.collect_list("items")).alias(names[2]))
    found = found.groupBy(F.col("row1").alias(rows[0]), F.col("row2").alias(rows[1])).agg(*lists)
    joined = docs.withColumns(dict(zip(rows, key))).join(found, list(rows), "left").drop(*rows)
    return joined.mapInArrow(_scan_batches(None, names, cut), schema)


def remove(docs: DataFrame, benchmark: DataFrame, most: int = SET_BYTES) -> DataFrame:
    """Documents of which at least one word in ``SHARE`` is hit go. Others stay, with all columns; their hit words, from the
    first to the last of each range, are cut and ``n_chars``, where there is one, is counted anew."""
    names = tuple(unused(docs, n) for n in NAMES)
    hit = _n_hit(names[1])
    kept = scan(docs, benchmark, most, True, names).where(~((hit > 0) & (SHARE * hit >= F.col(names[0]))))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.size(names[1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.drop(*names)


def cut_spans(text: str, hit: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each range."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, done = [], 0
    for a, b in hit:
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return (b"".join(out) + raw[done:]).decode()


def _n_hit(name: str = "hit"):
    return F.aggregate(name, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    n_hit = F.col("n_hit")
    return (
        scan(docs.select("doc_id", F.col("text").cast("string")), benchmark)
        .select("doc_id", "n_words", _n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
        .withColumn("contaminated", (n_hit > 0) & (SHARE * n_hit >= F.col("n_words")))
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> list[tuple]:
    """The same rows from the definition, for tests."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text in docs:
        w = split(text)
        hit, found = set(), set()
        for item, t in items:
            v = split(t)
            n = min(WINDOW, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and SHARE * len(hit) >= len(w)))
    return out
