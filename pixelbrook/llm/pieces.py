"""Sampled segmentations into pieces, without replacement: Gumbel top-k by a perturbed A-star search over the lattice.

The lattice of a text has an edge for each piece of a SentencePiece model that occurs in it (a character without piece is an
edge of its UTF-8 bytes' pieces). A piece's weight is Zipf's: p ~ 1 / (1 + r) for the r-th piece by score, raised to
``theta``. No piece continues a word over a space, and none has a line end, so the lattice falls into units (spaces and the word after them, or a line end
and what follows it): edges and
the backward sums of units are computed once each, all new units of a block of documents side by side. A long unit (a text without
spaces) falls apart further where no piece goes over a place; what still holds together over more than ``TALL`` characters is
summed place by place, and its paths follow edges drawn for all its places at once, so time and memory grow with its length.

Search. A text's whole lattice is the first region of the queue; its perturbed bound is a Gumbel draw. The best region is
taken, its best path drawn downwards edge by edge, and at each node the edges not taken stay as a new region, whose bound
is a Gumbel draw of their total mass, truncated at the parent's (nodes far below a branching share one region until it is
the best, which draws from the same distribution). So each taken path is the next best of all paths'
perturbed scores, paths are distinct, and no path is ever weighed twice. The bound left in the queue after k paths is the
threshold from which each path's inclusion score follows: log(1 - exp(-exp(score - threshold))), 0 if nothing is left.

Every draw is a hash of seed, row key, sample and place, and is held against the chances of that place alone, so results don't
depend on how rows are dealt out (scores are rounded to 9 decimals, as sums over a block end in differing last digits).
``decode`` gives back the text exactly (a literal U+2581 goes as bytes).

Defined results: null and empty texts have one segmentation without pieces; a text with fewer than k segmentations has them
all; repeated rows repeat their samples; rows without doc_id are keyed by their text; texts are segmented whole whatever
their length; other columns are ignored. ``ids`` are packed, 4 bytes each (little-endian); ``unpacked`` gives them as arrays.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, column

#: A SentencePiece model file, by default that of the public tokenizers' package.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, THETA, SEED = 3, 1.0, 42
SPACE, ESCAPED, GOES_ON = "▁", "\ud800", "\ud801"  # no UTF-8 text has the latter: a literal U+2581, and a part of a unit
_UNIT = re.compile(f"\n[^{SPACE}\n]*|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_BLOCK = 1 << 18
#: Places that a worker's lattice grows to, and nodes from a branching on whose regions are kept apart at once.
PLACES, HEAD = 1_200_000, 96
#: Characters from which a unit is looked at for places where it falls apart, and those summed and drawn side by side.
LONG, TALL = 64, 256
_SLOTS = 20
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_vocabularies: dict[tuple[str, float], Vocabulary] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def uniform(*parts) -> np.ndarray:
    """Draws from the open interval (0, 1), one for each row of the parts."""
    x = np.uint64(0)
    for p in parts:
        x = mixed(x ^ np.asarray(p).astype(np.uint64))
    return as_uniform(x)


def as_uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class Vocabulary:
    def __init__(self, path: str = MODEL, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int64)
        self.spelling = [byte_of.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        self.flat = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.sizes = np.array([len(x) for x in self.spelling], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        text = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in text):
            raise ValueError("a piece goes on over a space; its lattice doesn't fall into words")
        if any("\n" in self.pieces[i] for i in text):
            raise ValueError("a piece has a line end; its lattice doesn't fall into lines")
        rank = {i: r for r, i in enumerate(sorted(text, key=lambda i: (-model.get_score(i), i)))}
        total = sum(1 / (1 + r) for r in range(n))
        self.weight = np.full(n + 1, -math.inf)
        for i, r in rank.items():
            self.weight[i] = -theta * (math.log(1 + r) + math.log(total))
        self.byte_weight = -theta * (math.log(1 + n) + math.log(total))
        self.longest = max(len(self.pieces[i]) for i in text)
        # an open table of hashes of the pieces' characters, and of the pieces' beginnings
        size = 1 << _SLOTS
        self.key, self.id = np.zeros(size, np.uint64), np.full(size, n, np.int32)
        self.probes = 1
        with np.errstate(over="ignore"):
            for i in text:
                h = np.uint64(0)
                for c in self.pieces[i]:
                    h = self.grown(h, np.uint64(ord(c)))
                    at, probes = int(h >> np.uint64(64 - _SLOTS)), 1
                    while self.key[at] and self.key[at] != h:
                        at, probes = (at + 1) % size, probes + 1
                    self.key[at], self.probes = h, max(probes, self.probes)
                self.id[at] = i

    @staticmethod
    def grown(h, c):
        h = (h ^ c) * _MIX[1]
        return (h ^ (h >> np.uint64(29))) * _MIX[2]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces with these hashes (their number where there is none), and which go on to longer pieces or are one."""
        at = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        key = self.key[at]
        known = key == h
        out = np.where(known, self.id[at], np.int32(len(self.pieces)))
        rest = np.flatnonzero(~known & (key != 0))
        for _ in range(self.probes - 1):
            at = (at[rest] + 1) % len(self.key) if len(at) == len(h) else (at + 1) % len(self.key)
            found = self.key[at] == h[rest]
            out[rest[found]] = self.id[at[found]]
            known[rest[found]] = True
            more = ~found & (self.key[at] != 0)
            at, rest = at[more], rest[more]
            if not len(rest):
                break
        return out, known

    def apart(self, unit: str) -> list[str]:
        """The parts of a unit between places that no piece goes over."""
        text = whole(unit)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes)
        reach = np.arange(1, n + 1)
        for a in range(0, n, _BLOCK):
            here, h = np.arange(a, min(a + _BLOCK, n)), np.zeros(min(_BLOCK, n - a), np.uint64)
            for k in range(self.longest):
                ok = here + k < n
                here, h = here[ok], h[ok]
                if not len(here):
                    break
                h = self.grown(h, codes[here + k])
                ids, known = self.find(h)
                reach[here[ids < len(self.pieces)]] = here[ids < len(self.pieces)] + k + 1
                here, h = here[known], h[known]
        reach = np.maximum.accumulate(reach)
        cuts = [0, *(np.flatnonzero(reach[:-1] <= np.arange(1, n)) + 1).tolist(), n]
        parts = [GOES_ON + text[a:b] for a, b in zip(cuts, cuts[1:])]
        return [parts[0][2 if text[0] == SPACE else 1 :], *parts[1:]]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text, without the space that encoding puts first."""
        return b"".join(map(self.spelling.__getitem__, ids))[1:]

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all these pieces one after the other, and how many there are before each and after the last."""
        size = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(ends[-1])
        at += np.repeat(self.begins[ids] - ends[:-1], size)
        return self.flat[at], ends


def vocabulary(path: str = MODEL, theta: float = THETA) -> Vocabulary:
    if (path, theta) not in _vocabularies:
        _vocabularies[path, theta] = Vocabulary(path, theta)
    return _vocabularies[path, theta]


def units(text: str) -> list[str]:
    """The text's units, each without the space that begins it (encoding puts one first); line ends begin units without one."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, ESCAPED)
    if text[0] not in " \n" and "  " not in text and " \n" not in text:
        return text.replace("\n", " \n").split(" ")
    return [u if u[0] == "\n" else u[1:] for u in _UNIT.findall(SPACE + text.replace(" ", SPACE))]


def whole(unit: str) -> str:
    first = unit[:1]
    return unit if first == "\n" else unit[1:] if first == GOES_ON else SPACE + unit


def in_parts(text: str, vocab: Vocabulary) -> list[str]:
    """The text's units, long ones in parts."""
    out = units(text)
    if len(text) > LONG and max(map(len, out)) > LONG:
        return [p for u in out for p in (vocab.apart(u) if len(u) > LONG else (u,))]
    return out


class Starts(dict):
    """Where each known unit starts; a new one is noted, and has minus its number in ``found`` until it is added."""

    def __init__(self):
        self.found: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.found.append(unit)
        self[unit] = -len(self.found)
        return -len(self.found)


class Lattice:
    """The edges of the units met so far. A unit's places (characters) are numbered by how many characters are left to its end,
    together with those of all units added with it, so that the backward sums go over slices. Edge e leads from place
    ``at[e]`` to ``go[e]`` (END at a unit's end) with log chance ``log[e]``; place i has the edges from first[i] to first[i + 1].
    It grows to ``PLACES`` places and is then begun anew."""

    END = 2**31 - 1

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear(PLACES)

    def clear(self, places: int) -> None:
        self.starts = Starts()
        self.n_places = self.n_edges = 0
        self.room = places, 4 * places
        self.tall: dict[int, np.ndarray] = {}  # all places of a tall unit, by its first
        self.log, self.others = np.empty(self.room[1]), np.empty(self.room[1])
        self.at, self.go, self.piece = (np.empty(self.room[1], np.int32) for _ in range(3))
        self.offset, self.best, self.first = np.empty(places, np.int32), np.empty(places, np.int32), np.zeros(places + 1, np.int32)
        self.codes, self.best_chance = np.empty(places, np.uint32), np.empty(places)

    def begin(self, units_of: list[list[str]]) -> np.ndarray:
        """The first place of each unit of these texts; new units are added."""
        n = sum(map(len, units_of))
        out = np.fromiter(map(self.starts.__getitem__, chain.from_iterable(units_of)), np.int64, n)
        found = self.starts.found
        need = len(found) + sum(map(len, found))
        # a place has at most as many edges as the longest piece has characters
        if found and (self.n_places + need > self.room[0] or self.n_edges + self.vocab.longest * need > self.room[1]):
            self.clear(0)
            out = np.fromiter(map(self.starts.__getitem__, chain.from_iterable(units_of)), np.int64, n)
            found = self.starts.found
            need = len(found) + sum(map(len, found))
            starts = self.starts
            self.clear(max(PLACES, -(-need * self.vocab.longest // 4)))
            self.starts = starts
        if found:
            start = self._add(list(map(whole, found)))
            self.starts.update(zip(found, start.tolist()))
            new = np.flatnonzero(out < 0)
            out[new] = start[-out[new] - 1]
            self.starts.found = []
        return out

    def _add(self, found: list[str]) -> np.ndarray:
        vocab, p0, e0 = self.vocab, self.n_places, self.n_edges
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        start = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, none, wide = len(codes), len(vocab.pieces), vocab.longest
        left = np.repeat(start + sizes, sizes) - np.arange(n)
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        # the places once more with a stop after each unit, from which an edge's end is read
        stopped = np.arange(n) + np.repeat(np.arange(len(found)), sizes)
        ahead = np.full(n + len(found), n, np.int64)
        ahead[stopped] = place
        piece = np.full(n * wide, none, np.uint16 if none < 1 << 16 else np.int32)
        h, here = np.zeros(n, np.uint64), np.arange(n)
        for k in range(wide):
            if k:
                ok = left[here] > k
                here, h = here[ok], h[ok]
            if not len(here):
                break
            h = vocab.grown(h, codes[here + k])
            ids, known = vocab.find(h)
            piece[place[here] * wide + k] = ids
            here, h = here[known], h[known]
        codes = codes[order]
        spelled = np.flatnonzero(piece[::wide] == none)  # characters without piece
        some = piece != none
        some[spelled * wide] = True
        some = np.flatnonzero(some)
        at = some // wide if wide & (wide - 1) else some >> (wide.bit_length() - 1)
        k = some - at * wide
        m = len(at)
        go = ahead[stopped[order][at] + k + 1]
        first = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=n))))
        ids = piece[some].astype(np.int64)
        weight = vocab.weight[ids]
        if len(spelled):
            c = np.where(codes[spelled] == ord(ESCAPED), ord(SPACE), codes[spelled])
            weight[first[spelled]] = vocab.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
            ascii_ = spelled[c < 0x80]
            ids[first[ascii_]] = vocab.byte_ids[codes[ascii_].astype(np.int64)]
        back = np.zeros(n + 1)
        levels = np.concatenate(([0], np.cumsum(np.bincount(left)[1:])))
        for a, b in zip(levels[:-1].tolist()[:TALL], levels[1:].tolist()):
            if a == b:
                continue
            s, t = int(first[a]), int(first[b])
            cuts, owner = first[a:b] - s, at[s:t] - a
            w = weight[s:t] + back[go[s:t]]
            most = np.maximum.reduceat(w, cuts)
            w -= most[owner]
            total = np.log(np.add.reduceat(np.exp(w), cuts))
            back[a:b] = most + total
            weight[s:t] = w - total[owner]
        if len(levels) > TALL + 1:
            self._tall(int(levels[TALL]), first, go, weight, back)
            for u in np.flatnonzero(sizes > TALL).tolist():
                mine = place[start[u] : start[u] + sizes[u]] + p0
                self.tall[int(mine[0])] = mine
        # each place's likeliest edge is tried first, then the others in order
        chance = np.exp(weight)
        best_chance = np.maximum.reduceat(chance, first[:-1])
        top = np.flatnonzero(chance == best_chance[at])[::-1]
        best = np.empty(n, np.int64)
        best[at[top]] = top
        others = chance
        others[best] = 0.0
        go[go == n] = self.END - p0
        go += p0
        edges, places = slice(e0, e0 + m), slice(p0, p0 + n)
        self.log[edges], self.others[edges], self.at[edges], self.go[edges], self.piece[edges] = weight, others, at + p0, go, ids
        self.offset[places], self.codes[places], self.best[places], self.best_chance[places] = (np.arange(n) - np.repeat(start, sizes))[order], codes, best + e0, best_chance
        self.first[p0 : p0 + n + 1] = first + e0
        self.n_places, self.n_edges = p0 + n, e0 + m
        return place[start] + p0

    @staticmethod
    def _tall(begin: int, first: np.ndarray, go: np.ndarray, weight: np.ndarray, back: np.ndarray) -> None:
        """Backward sums of the places from ``begin`` on, one after the other; ``weight`` becomes log chances."""
        s0 = int(first[begin])
        ends, to, w, sums = (first[begin:] - s0).tolist(), go[s0:].tolist(), weight[s0:].tolist(), back.tolist()
        log, exp = math.log, math.exp
        for i in range(len(ends) - 1):
            s, t = ends[i], ends[i + 1]
            if t == s + 1:
                sums[begin + i] = w[s] + sums[to[s]]
                w[s] = 0.0
                continue
            here = [w[e] + sums[to[e]] for e in range(s, t)]
            most = max(here)
            total = most + log(sum([exp(x - most) for x in here]))
            sums[begin + i] = total
            w[s:t] = [x - total for x in here]
        weight[s0:] = w

    def draw(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        most = self.best_chance[at]
        edge = self.best[at]
        miss = np.flatnonzero(u >= most)
        if len(miss):
            a = at[miss]
            begin = self.first[a]
            n = self.first[a + 1] - begin
            k = np.arange(n.max())
            chance = self.others[np.minimum(begin[:, None] + k, self.n_edges - 1)]
            chance[k >= n[:, None]] = 0.0
            cdf = np.cumsum(chance, axis=1)
            # rounding may leave a draw above all of them, or at an end of an edge without chance
            x = np.minimum(np.maximum(u[miss] - most[miss], 1e-300), cdf[:, -1])
            other = begin + (cdf < x[:, None]).sum(1)
            edge[miss] = np.where(cdf[:, -1] > 0, other, edge[miss])
        return edge

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """The pieces of these edges, spelled characters as the pieces of their bytes."""
        out = self.piece[edges]
        odd = np.flatnonzero(out == len(self.vocab.pieces))
        if not len(odd):
            return out
        c = self.codes[self.at[edges[odd]]].astype(np.int64)
        c[c == ord(ESCAPED)] = ord(SPACE)
        more = (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
        size = np.ones(len(out), np.int64)
        size[odd] += more
        begin = np.cumsum(size) - size
        full = np.empty(int(size.sum()), out.dtype)
        full[begin] = out
        begin = begin[odd]
        full[begin] = self.vocab.byte_ids[np.where(more == 0, c, np.array([0, 0xC0, 0xE0, 0xF0])[more] | c >> 6 * more)]
        for k in (1, 2, 3):
            has = np.flatnonzero(more >= k)
            full[begin[has] + k] = self.vocab.byte_ids[0x80 | c[has] >> 6 * (more[has] - k) & 0x3F]
        return full


class Path:
    """One drawn path for each text of a block: its edges in order, and what hangs off their nodes as regions. The regions far
    down a path have little mass; they stay one region (``tail``) until it is the best of all."""

    def __init__(self, word, edge, bound, barred, doc, tail, tail_from, n_docs):
        self.word, self.edge, self.bound, self.barred, self.doc, self.tail, self.tail_from = word, edge, bound, barred, doc, tail, tail_from
        counts = np.bincount(doc, minlength=n_docs)
        self.end = np.cumsum(counts)
        self.begin = self.end - counts

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text the highest bound and its node, -1 for the tail."""
        value = np.full(len(self.begin), -math.inf)
        node = np.zeros(len(self.begin), np.int64)
        some = np.flatnonzero(self.end > self.begin)
        if len(some):
            value[some] = np.maximum.reduceat(self.bound, self.begin[some])
            hit = np.flatnonzero(self.bound == value[self.doc])[::-1]
            node[self.doc[hit]] = hit  # the first of equals
        tail = self.tail > value
        return np.where(tail, self.tail, value), np.where(tail, -1, node)


def sampled(texts: list[str | None], keys: np.ndarray, lattice: Lattice, k: int = SAMPLES, seed: int = SEED) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its samples in order: (ids, score, inclusion score)."""
    split = [in_parts(t, lattice.vocab) if t else [] for t in texts]
    word_start = lattice.begin(split)
    sizes = np.array([len(s) for s in split], np.int64)
    n_docs, out = len(texts), [[] for _ in texts]
    first_word = np.cumsum(sizes) - sizes
    word_doc = np.repeat(np.arange(n_docs), sizes)
    word_place = np.arange(len(word_start)) - first_word[word_doc]
    row = keys.astype(np.uint64) ^ mixed(np.full(1, seed, np.uint64))

    def drawn(word: np.ndarray, at: np.ndarray, stream: int) -> np.ndarray:
        x = mixed(row + np.uint64(stream))[word_doc[word]]
        x ^= ((word_place[word] << 24) ^ lattice.offset[at]).view(np.uint64)
        x *= _MIX[1]
        x ^= x >> np.uint64(32)
        x *= _MIX[2]
        x ^= x >> np.uint64(29)
        x *= _MIX[0]
        return as_uniform(x)

    def downwards(word: np.ndarray, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Draw from each place to its unit's end: (word, edge)."""
        # words come in order; the n-th round draws the n-th edge of those that aren't at their end
        drawn_: list[tuple] = []
        here, begin = np.arange(len(word)), word
        while len(word) and len(drawn_) < TALL:
            edge = lattice.draw(at, drawn(word, at, 2 * t))
            drawn_.append((here, len(drawn_), edge))
            at = lattice.go[edge]
            rest = np.flatnonzero(at < lattice.END)
            word, at, here = word[rest], at[rest], here[rest]
        for w, a, i in zip(word.tolist(), at.tolist(), here.tolist()):
            # a tall unit: an edge for each of its places, then those that follow each other
            places = lattice.tall[int(word_start[w])][int(lattice.offset[a]) :]
            edges = lattice.draw(places, drawn(np.full(len(places), w), places, 2 * t))
            to = lattice.go[edges]
            on = to < lattice.END
            to[on] = lattice.offset[to[on]] - lattice.offset[a]
            to[~on] = len(places)
            to, x, path_of = to.tolist(), 0, []
            while x < len(to):
                path_of.append(x)
                x = to[x]
            drawn_.append((np.full(len(path_of), i), TALL + np.arange(len(path_of)), edges[path_of]))
        if not drawn_:
            return (np.zeros(0, np.int64),) * 2
        count = np.bincount(np.concatenate([h for h, _, _ in drawn_]), minlength=len(begin))
        place = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for h, n, e in drawn_:
            out[place[h] + n] = e
        return np.repeat(begin, count), out

    def truncated(mass: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Gumbel draws of regions of this log mass, truncated at the parent's."""
        with np.errstate(over="ignore", divide="ignore"):
            return mass - np.log(np.exp(mass - limit) - np.log(u))

    def row_chances(at: np.ndarray) -> np.ndarray:
        """Chances of the edges at each place, one row for each."""
        begin, n = lattice.first[at], lattice.first[at + 1] - lattice.first[at]
        k = np.arange(lattice.vocab.longest)
        return np.where(k < n[:, None], np.exp(lattice.log[np.minimum(begin[:, None] + k, lattice.n_edges - 1)]), 0.0)

    def shut(chances: np.ndarray, barred: np.ndarray) -> np.ndarray:
        return np.where((barred[:, None] >> np.arange(chances.shape[1])) & 1, 0.0, chances)

    def rest_mass(edge: np.ndarray, barred: np.ndarray) -> np.ndarray:
        """Log chance of the edges of a node that are neither taken nor barred."""
        at = lattice.at[edge]
        left = -np.expm1(lattice.log[edge])
        left[lattice.first[at + 1] - lattice.first[at] == 1] = 0.0
        odd = np.flatnonzero(barred)
        if len(odd):
            left[odd] = shut(row_chances(at[odd]), barred[odd] | (np.int64(1) << (edge[odd] - lattice.first[at[odd]]))).sum(1)
        return np.where(left > 1e-13, np.log(np.maximum(left, 1e-300)), -math.inf)

    def bounds(word, edge, barred, mass, limit, t) -> np.ndarray:
        mass = mass + rest_mass(edge, barred)
        out = np.full(len(word), -math.inf)
        some = np.flatnonzero(mass > -math.inf)
        out[some] = truncated(mass[some], limit[some], drawn(word[some], lattice.at[edge[some]], 2 * t + 1))
        return out

    def path(word, edge, barred, begin, limit, t) -> Path:
        """``begin``: of each text's nodes the first that has regions (that of the last branching)."""
        doc = word_doc[word]
        log = lattice.log[edge]
        total = np.concatenate(([0.0], np.cumsum(log)))
        end = np.cumsum(np.bincount(doc, minlength=n_docs))
        top = np.concatenate(([0], end[:-1]))
        cut = np.minimum(begin + HEAD, end)
        head = _ranges(begin, cut)
        bound = np.full(len(word), -math.inf)
        d = doc[head]
        bound[head] = bounds(word[head], edge[head], barred[head], total[head] - total[top[d]], limit[d], t)
        rest = np.minimum(total[end] - total[cut], 0.0)
        with np.errstate(divide="ignore"):
            mass = np.where(cut < end, total[cut] - total[top] + np.log(-np.expm1(rest)), -math.inf)
        tail = np.full(n_docs, -math.inf)
        some = np.flatnonzero(mass > -math.inf)
        tail[some] = truncated(mass[some], limit[some], uniform(row[some] + np.uint64(2 * t + 1), np.full(len(some), 1 << 62)))
        return Path(word, edge, bound, barred, doc, tail, cut, n_docs)

    def unfolded(p: Path, d: int, t: int) -> None:
        """Regions of a tail: one of them, by mass, has the tail's bound, the others are truncated at it."""
        nodes = np.arange(p.tail_from[d], p.end[d])
        above = np.concatenate(([0.0], np.cumsum(lattice.log[p.edge[p.begin[d] : p.end[d]]])))[nodes - p.begin[d]]
        mass = above + rest_mass(p.edge[nodes], p.barred[nodes])
        cdf = np.exp(mass - mass.max()).cumsum()
        u = uniform(row[d : d + 1] + np.uint64(2 * t + 1), np.full(1, 1 << 61))[0]
        limit = np.full(len(nodes), p.tail[d])
        p.bound[nodes] = bounds(p.word[nodes], p.edge[nodes], p.barred[nodes], above, limit, t)
        p.bound[nodes[min(int(np.searchsorted(cdf, u * cdf[-1])), len(nodes) - 1)]] = p.tail[d]
        p.tail[d] = -math.inf

    limit = -np.log(-np.log(uniform(row, np.full(n_docs, 1 << 40))))
    word, edge = downwards(np.arange(len(word_start)), word_start, 0)
    ends = np.cumsum(np.bincount(word_doc[word], minlength=n_docs))
    paths = [path(word, edge, np.zeros(len(word), np.int64), np.concatenate(([0], ends[:-1])), limit, 0)]
    taken = [np.ones(n_docs, bool)]
    for t in range(1, k + 1):
        tops = [p.best() for p in paths]
        value = np.stack([v for v, _ in tops])
        which = value.argmax(0)
        limit = value.max(0)
        going = np.isfinite(limit)
        if t == k or not going.any():
            break
        for p_no, p in enumerate(paths):
            docs = np.flatnonzero(going & (which == p_no))
            tails = docs[tops[p_no][1][docs] < 0]
            for d in tails.tolist():
                unfolded(p, d, p_no)
            if len(tails):
                tops[p_no] = p.best()
        taken.append(going)
        parts: list[tuple[np.ndarray, ...]] = []
        begin = np.zeros(n_docs, np.int64)
        for p_no, p in enumerate(paths):
            docs = np.flatnonzero(going & (which == p_no))
            if not len(docs):
                continue
            node = tops[p_no][1][docs]
            above = _ranges(p.begin[docs], node)
            parts.append((p.word[above], p.edge[above], p.barred[above]))
            begin[docs] = node - p.begin[docs]
            # the taken region: another edge at the node, by the chances of those that aren't barred
            w, at = p.word[node], lattice.at[p.edge[node]]
            barred = p.barred[node] | (np.int64(1) << (p.edge[node] - lattice.first[at]))
            cdf = shut(row_chances(at), barred).cumsum(1)
            edge = lattice.first[at] + (cdf < (drawn(w, at, 2 * t) * cdf[:, -1])[:, None]).sum(1)
            parts.append((w, edge, barred))
            p.bound[node] = -math.inf
            # what is left of the unit, and all later ones: a word that is at its end already is passed over
            after = lattice.go[edge]
            later = _ranges(w, first_word[docs] + sizes[docs])
            at = word_start[later]
            own = np.flatnonzero(np.concatenate(([True], word_doc[later[1:]] != word_doc[later[:-1]])))
            at[own] = after
            go_on = at < lattice.END
            below = downwards(later[go_on], at[go_on], t)
            parts.append((*below, np.zeros(len(below[0]), np.int64)))
        # each part is in order; of a text's parts the first comes first
        sizes_of = [np.bincount(word_doc[x[0]], minlength=n_docs) for x in parts]
        total = np.cumsum(np.sum(sizes_of, axis=0))
        base = np.concatenate(([0], total[:-1]))
        word, edge, barred = (np.empty(int(total[-1]), np.int64) for _ in range(3))
        for (w, e, x), size in zip(parts, sizes_of):
            place = np.arange(len(w)) + np.repeat(base - (np.cumsum(size) - size), size)
            word[place], edge[place], barred[place] = w, e, x
            base = base + size
        ends = np.cumsum(np.bincount(word_doc[word], minlength=n_docs))
        paths.append(path(word, edge, barred, np.concatenate(([0], ends[:-1])) + begin, limit, t))
    threshold = np.stack([p.best()[0] for p in paths]).max(0)
    for p, has in zip(paths, taken):
        score = np.bincount(p.doc, lattice.log[p.edge], minlength=n_docs)
        ids = lattice.piece[p.edge]
        odd = np.zeros(n_docs, bool)  # texts with characters that are spelled with several pieces
        odd[p.doc[ids == len(lattice.vocab.pieces)]] = True
        for d in np.flatnonzero(has).tolist():
            a, b = p.begin[d], p.end[d]
            gap = score[d] - threshold[d]
            inclusion = 0.0 if gap > 700 or threshold[d] == -math.inf else gap if gap < -30 else math.log(-math.expm1(-math.exp(gap)))
            out[d].append((lattice.ids(p.edge[a:b]) if odd[d] else ids[a:b], float(score[d]), float(inclusion)))
    return out


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of each range, one range after the other."""
    n = np.maximum(end - begin, 0)
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def row_keys(doc_ids: list[int | None], texts: list[str | None]) -> np.ndarray:
    """Of the id; of the text where there is none."""
    return np.array([xxhash.xxh64_intdigest(str(i) if i is not None else "\0" + (t or ""), SEED) for i, t in zip(doc_ids, texts)], np.uint64)


def samples(docs: DataFrame, k: int = SAMPLES, theta: float = THETA, seed: int = SEED, path: str = MODEL) -> DataFrame:
    """``docs(doc_id, text)`` -> a row for each sample: ``(doc_id, sample, n_pieces, score, log_inclusion, ids_sha256,
    round_trip, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, theta)
        lattice = Lattice(vocab)
        for batch in batches:
            for part in blocks(batch, most=_BLOCK):
                doc_ids, texts = column(part, "doc_id").to_pylist(), column(part, "text").to_pylist()
                found = sampled(texts, row_keys(doc_ids, texts), lattice, k, seed)
                every = [x for f in found for x, _, _ in f]
                flat = np.concatenate([np.zeros(0, np.int32), *every]).astype("<i4")
                ends = np.concatenate(([0], np.cumsum([len(x) for x in every], dtype=np.int64)))
                spelt, before = vocab.decode_all(flat)
                spelt, raw, rows, s = memoryview(spelt), memoryview(flat.tobytes()), [], 0
                for i, t, f in zip(doc_ids, texts, found):
                    want = (" " + t).encode() if t else b""
                    for j, (x, score, inclusion) in enumerate(f):
                        a, b = int(ends[s]), int(ends[s + 1])
                        rows.append((i, j, b - a, round(score, 9), round(inclusion, 9), hashlib.sha256(raw[4 * a : 4 * b]).hexdigest(), spelt[before[a] : before[b]] == want))
                        s += 1
                cols = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
                arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds)]
                packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*arrays, packed], ["doc_id", "sample", "n_pieces", "score", "log_inclusion", "ids_sha256", "round_trip", "ids"])

    schema = "doc_id long, sample int, n_pieces long, score double, log_inclusion double, ids_sha256 string, round_trip boolean, ids binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def report(docs: DataFrame, k: int = SAMPLES) -> DataFrame:
    return samples(docs, k)


def unpacked(rows: DataFrame) -> DataFrame:
    """``rows(ids, ...)`` with ``ids`` as arrays of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([None if x is None else np.frombuffer(x, "<i4") for x in column(batch, "ids").to_pylist()], pa.list_(pa.int32()))
            k = batch.schema.get_field_index("ids")
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], ids, *batch.columns[k + 1 :]], batch.schema.names)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in rows.schema))


def decoded(rows: DataFrame, path: str = MODEL, name: str = "text") -> DataFrame:
    """``rows(ids, ...)`` with the ids' text added as column ``name``, which is an error if there is one already."""
    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, THETA)
        for batch in batches:
            texts = pa.array([None if x is None else vocab.decode(np.frombuffer(x, "<i4").tolist()).decode("utf-8", "replace") for x in column(batch, "ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{name}` string"]))
