"""Bits, least significant first, and canonical prefix codes."""

from __future__ import annotations

import heapq

import numpy as np


class Corrupt(ValueError):
    """The bitstream is cut short or not legal."""


class Reader:
    """Reads from a window of a few bytes that moves along the data; reading past the end gives zeros, and is noticed by
    ``check``."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, 8 * at
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        byte = at >> 3
        value = int.from_bytes(self.data[byte : byte + 8], "little") >> (at & 7)
        self.at = at + n
        return value & ((1 << n) - 1)

    def check(self) -> None:
        if self.at > self.end:
            raise Corrupt("truncated")


class Writer:
    """Collects (value, bits) pairs and arrays of them; ``getvalue`` packs them all at once."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, value: int, bits: int) -> None:
        self.put_all(np.array([value], np.uint64), np.array([bits], np.int64))

    def put_all(self, values: np.ndarray, bits: np.ndarray) -> None:
        self.values.append(values.astype(np.uint64))
        self.sizes.append(bits.astype(np.int64))

    def getvalue(self) -> bytes:
        sizes = np.concatenate([np.zeros(0, np.int64), *self.sizes])
        values = np.concatenate([np.zeros(0, np.uint64), *self.values])
        some = sizes > 0
        sizes, values = sizes[some], values[some]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = ends - sizes
        words = np.zeros(total // 32 + 3, np.uint64)
        shifted = values << (at & 31).astype(np.uint64)  # values have at most 32 bits
        np.add.at(words, at >> 5, shifted & np.uint64(0xFFFFFFFF))
        np.add.at(words, (at >> 5) + 1, shifted >> np.uint64(32))
        return words.astype("<u4").tobytes()[: (total + 7) // 8]


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits; one used symbol has length 1, none have 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    least = 1
    while True:  # flatter counts until the code is shallow enough
        heap = [(max(int(counts[s]), least), k, (int(s),)) for k, s in enumerate(used)]
        heapq.heapify(heap)
        depth = dict.fromkeys(used.tolist(), 0)
        parent: dict[int, int] = {}
        nodes, k = {}, len(heap)
        heap = [(w, i) for i, (w, _, _) in enumerate(sorted(heap, key=lambda x: x[1]))]
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = k
            heapq.heappush(heap, (a + b, k))
            k += 1
        nodes[k - 1] = 0
        for n in range(k - 2, -1, -1):
            nodes[n] = nodes[parent[n]] + 1
        lengths = [nodes[i] for i in range(len(used))]
        if max(lengths) <= limit:
            del depth
            out[used] = lengths
            return out
        least *= 2


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, its bits reversed for writing least significant first."""
    codes = np.zeros(len(lengths), np.uint64)
    code = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        for s in np.flatnonzero(lengths == n).tolist():
            codes[s] = int(format(code, f"0{n}b")[::-1], 2)
            code += 1
        code <<= 1
    return codes


def lookup(lengths: list[int] | np.ndarray) -> tuple[list[int], int]:
    """(table, bits): entry at the next ``bits`` bits of input is symbol << 4 | length. A code of one symbol takes no bits."""
    lengths = np.asarray(lengths, np.int64)
    used = np.flatnonzero(lengths)
    if not len(used):
        raise Corrupt("empty code")
    if len(used) == 1:
        return [int(used[0]) << 4], 0
    bits = int(lengths.max())
    if (1 << bits) != int((1 << (bits - lengths[used])).sum()):
        raise Corrupt("incomplete code")
    codes = canonical(lengths)
    table = np.zeros(1 << bits, np.int64)
    for s in used.tolist():
        table[int(codes[s]) :: 1 << int(lengths[s])] = s << 4 | int(lengths[s])
    return table.tolist(), bits
