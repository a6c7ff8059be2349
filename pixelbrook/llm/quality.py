"""Quality by nearest-neighbour voting among broadcast labelled vectors of a latent-semantic space.

A text's terms are its words (lower-cased, in ``WORDS`` hashed buckets) and the pairs of neighbouring words' shapes (runs of
capitals, other letters, digits and signs; a word like the one before and a line that came before have shapes of their own, in
``SHAPES`` buckets), so that texts are near each other in what they speak of and in how they are made. Weights
log(1 + tf) * idf, of unit length for words and for shapes, of a bounded sample of labelled rows are reduced by a truncated SVD
to ``RANK`` axes. The sample's vectors and labels are broadcast (at most ``SAMPLE`` x ``RANK`` floats); every document's vector is
multiplied with all of them, block by block, and its ``NEIGHBOURS`` most similar ones vote with weights that rise with the cosine.
Texts of the sample with the same terms vote as one, with their mean label; of equally similar ones the first by
label and terms votes.

Defined results: null and empty texts, and those without any term of the sample, score the sample's share of label 1; null
labels and label rows without document teach nothing; several labels of a document count as the highest; without labels
every score is 0.5; repeated rows each get a row; texts of any length are read whole; labels, lang, source and doc_id are
never inputs of a score; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, column, held_out, utf8
from .toxicity import training_rows

#: Most labelled rows that are learned from, axes, and voters.
SAMPLE, RANK, NEIGHBOURS = 4000, 64, 15
#: A voter's weight is this power of its cosine (a power of two).
SHARPNESS = 8
WORDS, SHAPES = 1 << 14, 1 << 12
TERMS = WORDS + SHAPES
_RUNS = re.compile(rb"([A-Z])[A-Z]*|([a-z\x80-\xff])[a-z\x80-\xff]*|([0-9])[0-9]*|(.)\4*", re.S)
_SAME, _LINE, _AGAIN = 1, 2, 3


def coded(word: bytes) -> int:
    """The word's bucket and a number of its shape."""
    shape = b"".join(b"A" if m[1] else b"a" if m[2] else b"9" if m[3] else m[4] for m in _RUNS.finditer(word[:64]))[:8]
    return zlib.crc32(word.lower()) % WORDS << 16 | 4 + zlib.crc32(shape) % 65_000


class Counts:
    """Sparse counts: document d has the terms ``term[begin[d] : begin[d + 1]]``, sorted."""

    def __init__(self, begin: np.ndarray, term: np.ndarray, n: np.ndarray):
        self.begin, self.term, self.n = begin, term, n

    def __len__(self) -> int:
        return len(self.begin) - 1


def term_counts(texts: list[bytes | None], memo: dict[bytes, int]) -> Counts:
    if len(memo) > 300_000:
        memo.clear()
    keys = []
    for d, text in enumerate(texts):
        if not text:
            continue
        seen, codes = set(), []
        for line in text.split(b"\n"):
            words = line.split()
            if not words:
                continue
            codes.append(_AGAIN if line in seen else _LINE)
            seen.add(line)
            for w in words:
                c = memo.get(w)
                if c is None:
                    c = memo[w] = coded(w)
                codes.append(c)
        if not codes:
            continue
        codes = np.array(codes, np.int64)
        shapes = codes & 0xFFFF
        shapes[1:][codes[1:] == codes[:-1]] = _SAME
        pairs = (shapes[:-1] << 16 | shapes[1:]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)
        keys.append(d * TERMS + np.concatenate(((codes >> 16)[codes > _AGAIN], WORDS + pairs.astype(np.int64))))
    every, n = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
    return Counts(np.searchsorted(every, np.arange(len(texts) + 1) * TERMS), every % TERMS, n.astype(np.float32))


class Space:
    def __init__(self, counts: Counts, labels: np.ndarray, rank: int = RANK):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = np.bincount(counts.term, minlength=TERMS)
        self.idf = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) * (seen > 0)
        weight = self.weighed(counts)
        y = np.random.default_rng(7).standard_normal((TERMS, rank + 8)).astype(np.float32)
        for _ in range(4):
            y = np.linalg.qr(self._back(counts, weight, product(counts, weight, y)))[0]
        y = y @ np.linalg.svd(product(counts, weight, y), full_matrices=False)[2].T if len(counts) else y
        self.axes = np.ascontiguousarray(y[:, :rank])
        self.vectors, self.labels = unit(product(counts, weight, self.axes)), labels.astype(np.float32)

    def weighed(self, counts: Counts) -> np.ndarray:
        w = np.log1p(counts.n) * self.idf[counts.term]
        doc = np.repeat(np.arange(len(counts)), np.diff(counts.begin))
        part = 2 * doc + (counts.term >= WORDS)
        norm = np.sqrt(np.bincount(part, w * w, minlength=2 * len(counts)))
        return (w / np.maximum(norm[part], 1e-12)).astype(np.float32)

    @staticmethod
    def _back(counts: Counts, weight: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The transposed matrix times y."""
        out = np.zeros((TERMS, y.shape[1]), np.float32)
        for d in range(len(counts)):
            a, b = counts.begin[d], counts.begin[d + 1]
            out[counts.term[a:b]] += weight[a:b, None] * y[d]
        return out

    def score(self, counts: Counts) -> np.ndarray:
        z = unit(product(counts, self.weighed(counts), self.axes))
        out = np.full(len(z), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(z) if k else 0, 256):
            cosine = z[a : a + 256] @ self.vectors.T
            least = np.partition(cosine, -k, axis=1)[:, -k, None]
            tied = cosine == least
            votes = (cosine > least) | tied & (np.cumsum(tied, axis=1) <= k - (cosine > least).sum(1, keepdims=True))
            w = np.where(votes, np.maximum(cosine, 0.0), 0.0)
            for _ in range(SHARPNESS.bit_length() - 1):
                w *= w
            total = w.sum(1, dtype=np.float64)
            some = total > 0
            out[a : a + 256][some] = (w.astype(np.float64) @ self.labels)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def product(counts: Counts, weight: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sparse matrix times y, some documents at a time."""
    out = np.zeros((len(counts), y.shape[1]), np.float32)
    cuts = sorted({0, len(counts), *np.searchsorted(counts.begin[:-1], np.arange(0, counts.begin[-1] + 1, 1 << 15)).tolist()})
    for a, b in zip(cuts, cuts[1:]):
        first, last = counts.begin[a], counts.begin[b]
        some = np.flatnonzero(np.diff(counts.begin[a : b + 1])) + a
        if len(some):
            out[some] = np.add.reduceat(weight[first:last, None] * y[counts.term[first:last]], counts.begin[some] - first)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def space(rows: list[tuple[int, list[int], list[float]]], rank: int = RANK) -> Space:
    """Of labelled (label, terms, counts), in any order."""
    same: dict[tuple, list[int]] = {}
    for label, term, n in rows:
        if len(term):
            same.setdefault((tuple(term), tuple(n)), []).append(label)
    voters = sorted((sum(v) / len(v), *k) for k, v in same.items())
    begin = np.cumsum([0, *(len(v[1]) for v in voters)])
    flat = lambda k, kind: np.fromiter((x for v in voters for x in v[k]), kind, int(begin[-1]))
    out = Space(Counts(begin, flat(1, np.int64), flat(2, np.float32)), np.array([v[0] for v in voters]), rank)
    out.prior = sum(r[0] for r in rows) / len(rows) if rows else 0.5
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space:
    """The sample's term counts are made where its rows lie; the driver gets at most ``sample`` sparse rows of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            for part in blocks(batch, most=1 << 20):
                c = term_counts(utf8(part), memo)
                at = pa.array(c.begin.astype(np.int32))
                yield pa.RecordBatch.from_arrays([column(part, "label"), pa.ListArray.from_arrays(at, pa.array(c.term.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(c.n))], ["label", "term", "n"])

    rows = training_rows(docs, labels, "quality", sample).mapInArrow(run, "label int, term array<int>, n array<float>").toArrow()
    return space(list(zip(*(rows[c].to_pylist() for c in ("label", "term", "n")))))


def scored(docs: DataFrame, model: Space) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, score)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            for part in blocks(batch, most=1 << 20):
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(shared.value.score(term_counts(utf8(part), memo)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return scored(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
