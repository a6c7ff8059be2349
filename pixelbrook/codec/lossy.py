"""The lossy bitstream: key frames of 4:2:0 planes.

Three of the format's probability tables have about a thousand values each that no rule gives. They are a parameter,
``Tables``, read from a JSON file with the keys ``coefficients`` (4 x 8 x 3 x 11), ``updates`` (the same) and ``modes``
(10 x 10 x 9), as the format's public specification lists them. Everything else is here.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

from .bits import Corrupt
from .boolean import BoolReader, BoolWriter

# Fixed values of the format.
# Steps of the quantisers of DC and AC coefficients by index.
DC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17,
    18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28,
    29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43,
    44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58,
    59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74,
    75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89,
    91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118,
    122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
)
AC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19,
    20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35,
    36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51,
    52, 53, 54, 55, 56, 57, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76,
    78, 80, 82, 84, 86, 88, 90, 92, 94, 96, 98, 100, 102, 104, 106, 108,
    110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137, 140, 143, 146, 149, 152,
    155, 158, 161, 164, 167, 170, 173, 177, 181, 185, 189, 193, 197, 201, 205, 209,
    213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
)
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7, 0)
LARGE = ((173, 148, 140), (176, 155, 140, 135), (180, 157, 141, 134, 130), (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129))
DC, VERTICAL, HORIZONTAL, MOTION, BLOCKS = range(5)
#: Modes of 4 x 4 blocks: DC, true motion, vertical, horizontal, and the diagonals down-left, down-right, vertical-right,
#: vertical-left, horizontal-down, horizontal-up; and the one that stands for each mode of a whole macroblock.
B_DC, B_TM, B_VE, B_HE, B_LD, B_RD, B_VR, B_VL, B_HD, B_HU = range(10)
IMPLIED = (B_DC, B_VE, B_HE, B_TM)
_BLOCK_TREE = (-B_DC, 2, -B_TM, 4, -B_VE, 6, 8, 12, -B_HE, 10, -B_RD, -B_VR, -B_LD, 14, -B_VL, 16, -B_HD, -B_HU)
LUMA_AFTER_DC, LUMA_DC, CHROMA, LUMA = range(4)


@dataclass(frozen=True)
class Tables:
    coefficients: list
    updates: list
    modes: list

    @classmethod
    def read(cls, path: str) -> Tables:
        with open(path) as f:
            return cls(**json.load(f))


def steps(q: int, deltas: tuple[int, int, int, int, int]) -> dict[int, tuple[int, int]]:
    """(DC, AC) steps of each kind of block."""
    at = lambda d, most=127: min(max(q + d, 0), most)
    y_dc, y2_dc, y2_ac, uv_dc, uv_ac = deltas
    y = DC_STEPS[at(y_dc)], AC_STEPS[at(0)]
    return {LUMA: y, LUMA_AFTER_DC: y, LUMA_DC: (2 * DC_STEPS[at(y2_dc)], max(8, AC_STEPS[at(y2_ac)] * 101581 >> 16)), CHROMA: (DC_STEPS[at(uv_dc, 117)], AC_STEPS[at(uv_ac)])}


# ---------------------------------------------------------------- transforms and prediction


def inverse_dct(c: list[int]) -> np.ndarray:
    """4 x 4 differences."""
    x = np.array(c, np.int64).reshape(4, 4)
    one, two = (lambda v: (v * 20091 >> 16) + v), (lambda v: v * 35468 >> 16)
    a, b, p, q = x[0] + x[2], x[0] - x[2], two(x[1]) - one(x[3]), one(x[1]) + two(x[3])
    x = np.stack([a + q, b + p, b - p, a - q]).T  # rows are now columns
    x[0] += 4
    a, b, p, q = x[0] + x[2], x[0] - x[2], two(x[1]) - one(x[3]), one(x[1]) + two(x[3])
    return np.stack([a + q, b + p, b - p, a - q]).T >> 3


def forward_dct(d: np.ndarray) -> np.ndarray:
    d = d.astype(np.int64)
    a, b, c, e = d[:, 0] + d[:, 3], d[:, 1] + d[:, 2], d[:, 1] - d[:, 2], d[:, 0] - d[:, 3]
    m = np.stack([(a + b) * 8, c * 2217 + e * 5352 + 1812 >> 9, (a - b) * 8, e * 2217 - c * 5352 + 937 >> 9], 1)
    a, b, c, e = m[0] + m[3], m[1] + m[2], m[1] - m[2], m[0] - m[3]
    return np.stack([a + b + 7 >> 4, (c * 2217 + e * 5352 + 12000 >> 16) + (e != 0), a - b + 7 >> 4, e * 2217 - c * 5352 + 51000 >> 16])


def inverse_wht(c: list[int]) -> list[int]:
    x = np.array(c, np.int64).reshape(4, 4)
    a, b, p, q = x[0] + x[3], x[1] + x[2], x[1] - x[2], x[0] - x[3]
    x = np.stack([a + b, q + p, a - b, q - p])
    d = x[:, 0] + 3
    a, b, p, q = d + x[:, 3], x[:, 1] + x[:, 2], x[:, 1] - x[:, 2], d - x[:, 3]
    return (np.stack([a + b, q + p, a - b, q - p], 1) >> 3).ravel().tolist()


def forward_wht(dc: np.ndarray) -> np.ndarray:
    x = dc.astype(np.int64).reshape(4, 4)
    for _ in range(2):
        a, b, p, q = x[:, 0] + x[:, 2], x[:, 1] + x[:, 3], x[:, 1] - x[:, 3], x[:, 0] - x[:, 2]
        x = np.stack([a + b, q + p, q - p, a - b], 1).T
    return (x >> 1).ravel()


def predicted(plane: np.ndarray, y: int, x: int, size: int, mode: int) -> np.ndarray:
    """A macroblock's plane from its borders. ``plane`` has a border row on top and a border column at the left."""
    top, left, corner = plane[y, x + 1 : x + 1 + size].astype(np.int64), plane[y + 1 : y + 1 + size, x].astype(np.int64), int(plane[y, x])
    if mode == VERTICAL:
        return np.repeat(top[None], size, 0)
    if mode == HORIZONTAL:
        return np.repeat(left[:, None], size, 1)
    if mode == MOTION:
        return np.clip(left[:, None] + top[None] - corner, 0, 255)
    there = [s for s, ok in ((top, y > 0), (left, x > 0)) if ok]
    n = size * len(there)
    return np.full((size, size), (sum(int(s.sum()) for s in there) + n // 2) // n if n else 128)


def _three(e, i):
    return (int(e[i]) + 2 * int(e[i + 1]) + int(e[i + 2]) + 2) >> 2


def _two(e, i):
    return (int(e[i]) + int(e[i + 1]) + 1) >> 1


#: For the six modes along an edge: what each of the 16 values is, row by row; a number below 16 is the mean of three from there
#: on, one from 16 on the mean of two from that less 16.
_EDGE = {
    B_LD: [min(r + c, 6) for r in range(4) for c in range(4)],
    B_RD: [3 - r + c for r in range(4) for c in range(4)],
    B_VR: [20, 21, 22, 23, 3, 4, 5, 6, 2, 20, 21, 22, 1, 3, 4, 5],
    B_VL: [16, 17, 18, 19, 0, 1, 2, 3, 17, 18, 19, 4, 1, 2, 3, 5],
    B_HD: [19, 3, 4, 5, 18, 2, 19, 3, 17, 1, 18, 2, 16, 0, 17, 1],
    B_HU: [16, 0, 17, 1, 17, 1, 18, 2, 18, 2, 20, 20, 20, 20, 20, 20],
}


def predicted_block(top: np.ndarray, left: np.ndarray, corner: int, mode: int) -> np.ndarray:
    """A 4 x 4 block from 8 values above (four of them to the right), 4 at the left and the corner."""
    a, l = top.tolist(), left.tolist()
    if mode == B_DC:
        return np.full((4, 4), (sum(a[:4]) + sum(l) + 4) >> 3)
    if mode == B_TM:
        return np.clip(left.astype(np.int64)[:, None] + top[:4].astype(np.int64) - corner, 0, 255)
    if mode == B_VE:
        e = [corner, *a]
        return np.repeat(np.array([[_three(e, k) for k in range(4)]]), 4, 0)
    if mode == B_HE:
        e = [corner, *l, l[3]]
        return np.repeat(np.array([[_three(e, k)] for k in range(4)]), 4, 1)
    if mode in (B_LD, B_VL):
        e = [*a, a[7]]
    elif mode == B_HU:
        e = [*l, l[3], l[3]]
    else:
        e = [*reversed(l), corner, *a]
    return np.array([_three(e, k) if k < 16 else _two(e, k - 16) for k in _EDGE[mode]]).reshape(4, 4)


# ---------------------------------------------------------------- decoding


class _Frame:
    def __init__(self, width: int, height: int):
        self.mw, self.mh = (width + 15) >> 4, (height + 15) >> 4
        self.y, self.u, self.v = (self._plane(16 * self.mh // k, 16 * self.mw // k) for k in (1, 2, 2))

    @staticmethod
    def _plane(height: int, width: int) -> np.ndarray:
        p = np.zeros((height + 1, width + 5), np.uint8)  # four more at the right, for what lies above and right of a block
        p[:, 0] = 129
        p[0] = 127
        return p


def _tokens(r: BoolReader, chances: list, context: int, first: int, step: tuple[int, int], out: list[int]) -> int:
    """One block's coefficients, and how far it goes."""
    i, p, bit = first, chances[BANDS[first]][context], r.bit
    while i < 16:
        if not bit(p[0]):
            return i
        while not bit(p[1]):
            i += 1
            if i == 16:
                return 16
            p = chances[BANDS[i]][0]
        if not bit(p[2]):
            v, context = 1, 1
        else:
            context = 2
            if not bit(p[3]):
                v = 2 if not bit(p[4]) else 3 + bit(p[5])
            elif not bit(p[6]):
                v = 5 + bit(159) if not bit(p[7]) else 7 + 2 * bit(165) + bit(145)
            else:
                kind = bit(p[8])
                kind = 2 * kind + bit(p[9 + kind])
                v = 0
                for chance in LARGE[kind]:
                    v = 2 * v + bit(chance)
                v += 3 + (8 << kind)
        out[ZIGZAG[i]] = (-v if bit(128) else v) * step[i > 0]
        i += 1
        p = chances[BANDS[i]][context]
    return 16


def _tree(r: BoolReader, chances: list) -> int:
    at = 0
    while True:
        at = _BLOCK_TREE[at + r.bit(chances[at >> 1])]
        if at <= 0:
            return -at


@dataclass
class _Block:
    segment: int = 0
    skip: bool = False
    mode: int = DC
    chroma: int = DC
    blocks: list | None = None
    inner: bool = True


def decode(data: bytes, tables: Tables) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(width, height, Y, U, V) of a key frame; chroma planes have half the size, rounded up."""
    if len(data) < 10:
        raise Corrupt("truncated")
    tag = int.from_bytes(data[:3], "little")
    if tag & 1 or data[3:6] != b"\x9d\x01\x2a" or tag >> 1 & 7 > 3:
        raise Corrupt("not a key frame")
    size = tag >> 5
    width, height = int.from_bytes(data[6:8], "little") & 0x3FFF, int.from_bytes(data[8:10], "little") & 0x3FFF
    if not width or not height or 10 + size > len(data):
        raise Corrupt("truncated")
    r = BoolReader(data[10 : 10 + size])
    r.bits(2)  # colour space and clamping
    map_probs, quant, strength, absolute, segmented, mapped = [255] * 3, [0] * 4, [0] * 4, 1, r.bits(1), 0
    if segmented:
        mapped, given = r.bits(1), r.bits(1)
        if given:
            absolute = r.bits(1)
            quant, strength = [r.optional(7) for _ in range(4)], [r.optional(6) for _ in range(4)]
        if mapped:
            map_probs = [r.bits(8) if r.bits(1) else 255 for _ in range(3)]
    simple, level, sharpness = r.bits(1), r.bits(6), r.bits(3)
    ref, by_mode, adjusted = [0] * 4, [0] * 4, r.bits(1)
    if adjusted and r.bits(1):
        ref, by_mode = [r.optional(6) for _ in range(4)], [r.optional(6) for _ in range(4)]
    parts = 1 << r.bits(2)
    base = r.bits(7)
    deltas = tuple(r.optional(4) for _ in range(5))
    r.bits(1)  # whether probabilities outlive the frame
    chances = [[[[r.bits(8) if r.bit(u) else c for u, c in zip(us, cs)] for us, cs in zip(ub, cb)] for ub, cb in zip(ut, ct)] for ut, ct in zip(tables.updates, tables.coefficients)]
    skip_chance = r.bits(8) if r.bits(1) else None
    r.check()
    levels = [q if segmented and absolute else base + q if segmented else base for q in quant]
    scale = [steps(min(max(q, 0), 127), deltas) for q in levels]
    at = 10 + size + 3 * (parts - 1)
    readers = []
    for k in range(parts):
        n = int.from_bytes(data[10 + size + 3 * k : 13 + size + 3 * k], "little") if k < parts - 1 else len(data) - at
        readers.append(BoolReader(data[at : at + max(0, n)]))
        at += n
    f = _Frame(width, height)
    above_modes = [B_DC] * (4 * f.mw)
    above_set = [[0] * 9 for _ in range(f.mw)]  # Y x 4, U x 2, V x 2, Y2
    found: list[list[_Block]] = []
    for my in range(f.mh):
        left_modes, left_set, row = [B_DC] * 4, [0] * 9, []
        for mx in range(f.mw):
            b = _Block()
            if mapped:
                b.segment = 2 + r.bit(map_probs[2]) if r.bit(map_probs[0]) else r.bit(map_probs[1])
            b.skip = bool(skip_chance is not None and r.bit(skip_chance))
            if not r.bit(145):
                b.mode, b.blocks = BLOCKS, []
                for y in range(4):
                    for x in range(4):
                        m = _tree(r, tables.modes[above_modes[4 * mx + x]][left_modes[y]])
                        above_modes[4 * mx + x] = left_modes[y] = m
                        b.blocks.append(m)
            else:
                b.mode = (MOTION if r.bit(128) else HORIZONTAL) if r.bit(156) else (VERTICAL if r.bit(163) else DC)
                above_modes[4 * mx : 4 * mx + 4] = left_modes[:] = [IMPLIED[b.mode]] * 4
            b.chroma = DC if not r.bit(142) else VERTICAL if not r.bit(114) else MOTION if r.bit(183) else HORIZONTAL
            coefficients = _residual(readers[my & (parts - 1)], chances, scale[b.segment], b, above_set[mx], left_set)
            _reconstruct(f, my, mx, b, coefficients)
            row.append(b)
        r.check()
        found.append(row)
    for reader in readers:
        reader.check()
    if level or any(strength):
        _filtered(f, found, simple, level, sharpness, segmented, absolute, strength, adjusted, ref, by_mode)
    crop = lambda p, w, h: p[1 : h + 1, 1 : w + 1].copy()
    return width, height, crop(f.y, width, height), crop(f.u, (width + 1) // 2, (height + 1) // 2), crop(f.v, (width + 1) // 2, (height + 1) // 2)


def _residual(r: BoolReader, chances: list, scale: dict, b: _Block, above: list[int], left: list[int]) -> list[list[int] | None]:
    """Coefficients of the 16 + 4 + 4 blocks; None where all are 0."""
    out: list[list[int] | None] = [None] * 24
    whole = b.mode != BLOCKS
    if b.skip:
        keep = above[8], left[8]
        above[:], left[:] = [0] * 9, [0] * 9
        if not whole:
            above[8], left[8] = keep
        b.inner = not whole
        return out
    kind, first, dc, some = LUMA, 0, None, False
    if whole:
        c = [0] * 16
        n = _tokens(r, chances[LUMA_DC], above[8] + left[8], 0, scale[LUMA_DC], c)
        above[8] = left[8] = int(n > 0)
        some |= n > 0
        dc, kind, first = inverse_wht(c), LUMA_AFTER_DC, 1
    for k in range(24):
        if k < 16:
            x, y, what, start = k & 3, k >> 2, kind, first
        else:
            x, y, what, start = 4 + 2 * (k >= 20) + (k & 1), 4 + 2 * (k >= 20) + (k >> 1 & 1), CHROMA, 0
        c = [0] * 16
        n = _tokens(r, chances[what], above[x] + left[y], start, scale[what], c)
        above[x] = left[y] = int(n > start)
        some |= n > start
        if k < 16 and dc is not None:
            c[0] = dc[k]
        if n > start or c[0]:
            out[k] = c
    b.inner = some or not whole
    b.skip = not some
    return out


def _reconstruct(f: _Frame, my: int, mx: int, b: _Block, coefficients: list[list[int] | None]) -> None:
    y0, x0 = 16 * my, 16 * mx
    if b.mode == BLOCKS:
        right = f.y[y0, x0 + 17 : x0 + 21] if my == 0 or mx + 1 < f.mw else np.repeat(f.y[y0, x0 + 16], 4)
        right = right.copy()
        for k, m in enumerate(b.blocks):
            y, x = y0 + 4 * (k >> 2), x0 + 4 * (k & 3)
            top = f.y[y, x + 1 : x + 9].copy()
            if k & 3 == 3:
                top[4:] = right
            block = predicted_block(top, f.y[y + 1 : y + 5, x], int(f.y[y, x]), m)
            if coefficients[k] is not None:
                block = block + inverse_dct(coefficients[k])
            f.y[y + 1 : y + 5, x + 1 : x + 5] = np.clip(block, 0, 255)
    else:
        whole = predicted(f.y, y0, x0, 16, b.mode)
        _added(whole, coefficients[:16], 4)
        f.y[y0 + 1 : y0 + 17, x0 + 1 : x0 + 17] = np.clip(whole, 0, 255)
    for plane, part in ((f.u, coefficients[16:20]), (f.v, coefficients[20:])):
        whole = predicted(plane, 8 * my, 8 * mx, 8, b.chroma)
        _added(whole, part, 2)
        plane[8 * my + 1 : 8 * my + 9, 8 * mx + 1 : 8 * mx + 9] = np.clip(whole, 0, 255)


def _added(whole: np.ndarray, part: list[list[int] | None], wide: int) -> None:
    for k, c in enumerate(part):
        if c is not None:
            y, x = 4 * (k // wide), 4 * (k % wide)
            whole[y : y + 4, x : x + 4] += inverse_dct(c)


# ---------------------------------------------------------------- loop filter


def _edge(p: np.ndarray, at: int, limit: int, inner: int, hev: int, kind: str) -> None:
    """Filter across one edge: ``p`` has lines across it as rows, ``at`` is the first column behind it. Works in place."""
    s = lambda v: np.clip(v, -128, 127)
    q = p[:, at - 4 : at + 4].astype(np.int64)
    p3, p2, p1, p0, q0, q1, q2, q3 = q.T
    go = 4 * np.abs(p0 - q0) + np.abs(p1 - q1) <= 2 * limit + 1
    if kind != "simple":
        for a, b in ((p3, p2), (p2, p1), (p1, p0), (q1, q0), (q2, q1), (q3, q2)):
            go &= np.abs(a - b) <= inner
        high = (np.abs(p1 - p0) > hev) | (np.abs(q1 - q0) > hev)
    else:
        high = np.ones(len(p), bool)
    new = q.copy()
    two = go & high
    if two.any():
        a = 3 * (q0 - p0) + s(p1 - q1)
        new[two, 3] = (p0 + (np.clip(a + 3 >> 3, -16, 15)))[two]
        new[two, 4] = (q0 - (np.clip(a + 4 >> 3, -16, 15)))[two]
    rest = go & ~high
    if rest.any() and kind == "inner":
        a = 3 * (q0 - p0)
        a1, a2 = np.clip(a + 4 >> 3, -16, 15), np.clip(a + 3 >> 3, -16, 15)
        a3 = a1 + 1 >> 1
        for k, v in ((2, p1 + a3), (3, p0 + a2), (4, q0 - a1), (5, q1 - a3)):
            new[rest, k] = v[rest]
    elif rest.any():
        a = s(3 * (q0 - p0) + s(p1 - q1))
        for k, (x, y, f) in enumerate(((p2, q2, 9), (p1, q1, 18), (p0, q0, 27))):
            d = f * a + 63 >> 7
            new[rest, 1 + k] = (x + d)[rest]
            new[rest, 6 - k] = (y - d)[rest]
    p[:, at - 4 : at + 4] = np.clip(new, 0, 255)


def _filtered(f: _Frame, found: list[list[_Block]], simple: int, base: int, sharpness: int, segmented: int, absolute: int, strength: list[int], adjusted: int, ref: list[int], by_mode: list[int]) -> None:
    for my, row in enumerate(found):
        for mx, b in enumerate(row):
            level = (strength[b.segment] + (0 if absolute else base)) if segmented else base
            if adjusted:
                level += ref[0] + (by_mode[0] if b.mode == BLOCKS else 0)
            level = min(max(level, 0), 63)
            if not level:
                continue
            inner = level
            if sharpness:
                inner = min(level >> (2 if sharpness > 4 else 1), 9 - sharpness)
            inner = max(inner, 1)
            hev = 2 if level >= 40 else 1 if level >= 15 else 0
            limit = 2 * level + inner
            for plane, size in ((f.y, 16), *(() if simple else ((f.u, 8), (f.v, 8)))):
                y, x = size * my + 1, size * mx + 1
                kinds = ("simple", "simple") if simple else ("outer", "inner")
                across, down = plane[y : y + size], plane[:, x : x + size].T
                if mx:
                    _edge(across, x, limit + 4, inner, hev, kinds[0])
                if b.inner:
                    for k in range(4, size, 4):
                        _edge(across, x + k, limit, inner, hev, kinds[1])
                if my:
                    _edge(down, y, limit + 4, inner, hev, kinds[0])
                if b.inner:
                    for k in range(4, size, 4):
                        _edge(down, y + k, limit, inner, hev, kinds[1])


# ---------------------------------------------------------------- encoding


def _write_tokens(w: BoolWriter, chances: list, context: int, first: int, c: list[int]) -> int:
    """One block's quantised coefficients, in zigzag order; whether it has any."""
    last = max((i for i in range(first, 16) if c[i]), default=-1)
    p = chances[BANDS[first]][context]
    i = first
    while i <= last:
        w.bit(1, p[0])
        while not c[i]:
            w.bit(0, p[1])
            i += 1
            p = chances[BANDS[i]][0]
        w.bit(1, p[1])
        v = abs(c[i])
        w.bit(int(v > 1), p[2])
        if v > 1:
            w.bit(int(v > 4), p[3])
            if v <= 4:
                w.bit(int(v > 2), p[4])
                if v > 2:
                    w.bit(v - 3, p[5])
            else:
                w.bit(int(v > 10), p[6])
                if v <= 10:
                    w.bit(int(v > 6), p[7])
                    if v <= 6:
                        w.bit(v - 5, 159)
                    else:
                        w.bit(v - 7 >> 1, 165)
                        w.bit(v - 7 & 1, 145)
                else:
                    kind = max(k for k in range(4) if v >= 3 + (8 << k))
                    w.bit(kind >> 1, p[8])
                    w.bit(kind & 1, p[9 + (kind >> 1)])
                    rest = v - 3 - (8 << kind)
                    for k, chance in enumerate(LARGE[kind]):
                        w.bit(rest >> (len(LARGE[kind]) - 1 - k) & 1, chance)
        w.bit(int(c[i] < 0), 128)
        i += 1
        p = chances[BANDS[i]][1 if v == 1 else 2]
    if i < 16:
        w.bit(0, p[0])
    return int(last >= first)


def _quantised(c: np.ndarray, step: tuple[int, int], first: int = 0) -> list[int]:
    """In zigzag order, rounded to the nearest; values before ``first`` are 0."""
    s = np.full(16, step[1])
    s[0] = step[0]
    q = np.sign(c) * ((np.abs(c) + s // 2 - s // 8) // s)
    q = np.clip(q, -2047, 2047)[list(ZIGZAG)]
    q[:first] = 0
    return q.tolist()


def _back(q: list[int], step: tuple[int, int]) -> list[int]:
    out = [0] * 16
    for i, v in enumerate(q):
        out[ZIGZAG[i]] = v * step[i > 0]
    return out


def encode(y: np.ndarray, u: np.ndarray, v: np.ndarray, q: int, tables: Tables, level: int = 0, sharpness: int = 0, simple: bool = False) -> bytes:
    """Planes to a key frame at quantiser index q 0..127. Each macroblock takes the whole-block mode of least squared error."""
    height, width = y.shape
    f = _Frame(width, height)
    pad = lambda p, n: np.pad(p, ((0, n * f.mh - p.shape[0]), (0, n * f.mw - p.shape[1])), mode="edge").astype(np.int64)
    planes = [pad(y, 16), pad(u, 8), pad(v, 8)]
    scale, w, t = steps(q, (0,) * 5), BoolWriter(), BoolWriter()
    w.bits(0, 2)
    w.bits(0, 1)  # no segments
    w.bits(int(simple), 1)
    w.bits(level, 6)
    w.bits(sharpness, 3)
    w.bits(0, 1)  # no adjustments
    w.bits(0, 2)  # one partition of tokens
    w.bits(q, 7)
    for _ in range(5):
        w.bits(0, 1)
    w.bits(1, 1)
    for kind in tables.updates:
        for band in kind:
            for context in band:
                for chance in context:
                    w.bit(0, chance)
    w.bits(1, 1)
    skip_chance = 128
    w.bits(skip_chance, 8)
    above = [[0] * 9 for _ in range(f.mw)]
    for my in range(f.mh):
        left = [0] * 9
        for mx in range(f.mw):
            mode, blocks, dc = _best(f.y, planes[0], my, mx, 16, scale)
            chroma, parts = _best_chroma(f, planes, my, mx, scale)
            empty = not any(map(any, [dc, *blocks, *parts]))
            w.bit(int(empty), skip_chance)
            w.bit(1, 145)
            w.bit(int(mode in (HORIZONTAL, MOTION)), 156)
            w.bit(int(mode in (VERTICAL, MOTION)), 163 if mode in (DC, VERTICAL) else 128)
            w.bit(int(chroma != DC), 142)
            if chroma != DC:
                w.bit(int(chroma != VERTICAL), 114)
                if chroma != VERTICAL:
                    w.bit(int(chroma == MOTION), 183)
            if empty:
                above[mx][:], left[:] = [0] * 9, [0] * 9
            else:
                above[mx][8] = left[8] = _write_tokens(t, tables.coefficients[LUMA_DC], above[mx][8] + left[8], 0, dc)
                for k, c in enumerate([*blocks, *parts]):
                    a, b = (k & 3, k >> 2) if k < 16 else (4 + 2 * (k >= 20) + (k & 1), 4 + 2 * (k >= 20) + (k >> 1 & 1))
                    kind, first = (LUMA_AFTER_DC, 1) if k < 16 else (CHROMA, 0)
                    above[mx][a] = left[b] = _write_tokens(t, tables.coefficients[kind], above[mx][a] + left[b], first, c)
            spread = inverse_wht(_back(dc, scale[LUMA_DC]))
            all_ = [_back(c, scale[LUMA_AFTER_DC]) for c in blocks]
            for c, d in zip(all_, spread):
                c[0] = d
            _reconstruct(f, my, mx, _Block(mode=mode, chroma=chroma), [*all_, *(_back(c, scale[CHROMA]) for c in parts)])
    first, tokens = w.getvalue(), t.getvalue()
    tag = (1 << 4 | len(first) << 5).to_bytes(3, "little")
    return tag + b"\x9d\x01\x2a" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + first + tokens


def _differences(plane: np.ndarray, source: np.ndarray, my: int, mx: int, size: int) -> tuple[int, np.ndarray]:
    want = source[size * my : size * (my + 1), size * mx : size * (mx + 1)]
    tries = [want - predicted(plane, size * my, size * mx, size, m) for m in (DC, VERTICAL, HORIZONTAL, MOTION)]
    best = min(range(4), key=lambda m: int((tries[m] ** 2).sum()))
    return best, tries[best]


def _best(plane, source, my, mx, size, scale):
    mode, d = _differences(plane, source, my, mx, size)
    c = np.stack([forward_dct(d[4 * (k >> 2) : 4 * (k >> 2) + 4, 4 * (k & 3) : 4 * (k & 3) + 4]).ravel() for k in range(16)])
    dc = _quantised(forward_wht(c[:, 0]), scale[LUMA_DC])
    return mode, [_quantised(x, scale[LUMA_AFTER_DC], 1) for x in c], dc


def _best_chroma(f: _Frame, planes, my: int, mx: int, scale):
    want = [(f.u, planes[1]), (f.v, planes[2])]
    cut = lambda s: s[8 * my : 8 * my + 8, 8 * mx : 8 * mx + 8]
    tries = [[cut(s) - predicted(p, 8 * my, 8 * mx, 8, m) for p, s in want] for m in (DC, VERTICAL, HORIZONTAL, MOTION)]
    mode = min(range(4), key=lambda m: sum(int((d**2).sum()) for d in tries[m]))
    return mode, [_quantised(forward_dct(d[4 * (k >> 1) : 4 * (k >> 1) + 4, 4 * (k & 1) : 4 * (k & 1) + 4]).ravel(), scale[CHROMA]) for d in tries[mode] for k in range(4)]


# ---------------------------------------------------------------- colours


def quality_index(quality: float) -> int:
    c = quality / 100
    if c <= 0 or c >= 1:
        return 127 if c <= 0 else 0
    return min(max(int(127 * (1 - (c * 2 / 3 if c < 0.75 else 2 * c - 1) ** (1 / 3))), 0), 127)


def to_planes(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(height, width, 3) to Y, U, V in video range; chroma of the sum of four pixels, the border repeated."""
    p = rgb.astype(np.int64)
    y = (p @ np.array([16839, 33059, 6420]) + (1 << 15) + (16 << 16)) >> 16
    p = np.pad(p, ((0, p.shape[0] & 1), (0, p.shape[1] & 1), (0, 0)), mode="edge")
    four = p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]
    u, v = (np.clip((four @ np.array(row) + (1 << 17) + (128 << 18)) >> 18, 0, 255) for row in ((-9719, -19081, 28800), (28800, -24116, -4684)))
    return y.astype(np.uint8), u.astype(np.uint8), v.astype(np.uint8)


def doubled(c: np.ndarray, height: int, width: int) -> np.ndarray:
    """A chroma plane at full size: (9, 3, 3, 1) / 16 of the nearest four values."""
    p = np.pad(c.astype(np.int64), 1, mode="edge")
    mid = p[1:-1, 1:-1]
    out = np.empty((2 * c.shape[0], 2 * c.shape[1]), np.int64)
    for dy in (0, 1):
        for dx in (0, 1):
            rows, cols = slice(2 * dy, 2 * dy + c.shape[0]), slice(2 * dx, 2 * dx + c.shape[1])
            out[dy::2, dx::2] = (9 * mid + 3 * p[rows, 1:-1] + 3 * p[1:-1, cols] + p[rows, cols] + 8) >> 4
    return out[:height, :width]


def to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(height, width, 3) from planes in video range, 14-bit fixed point."""
    height, width = y.shape
    u, v, high = doubled(u, height, width), doubled(v, height, width), lambda c, k: c * k >> 8
    l = high(y.astype(np.int64), 19077)
    out = [l + high(v, 26149) - 14234, l - high(u, 6419) - high(v, 13320) + 8708, l + high(u, 33050) - 17685]
    return np.stack([np.clip(c, 0, 16383) >> 6 for c in out], -1).astype(np.uint8)
