"""The lossless bitstream: ARGB words to bytes and back.

Decoding is serial by nature and runs on plain integers; everything that isn't (transforms' inverses by row, palettes,
statistics, all of encoding) runs on whole arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .bits import Corrupt, Reader, Writer, canonical, code_lengths, lookup

PREDICTOR, CROSS_COLOUR, GREEN, PALETTE = range(4)
MAX_PIXELS = 1 << 28
# Fixed values of the format: order of the code-length code's lengths, and sizes of the alphabets.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
N_LITERALS, N_LENGTHS, N_DISTANCES = 256, 24, 40


def near_distances() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distance codes: places above, and to the left in the row, by squared distance; of equals
    those higher up first unless the offset to the side is larger, right before left."""
    found = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy > 0 or dx > 0]
    found.sort(key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
    return found[:120]


def plane_distance(width: int, code: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = near_distances_cached[code - 1]
    return max(1, dy * width + dx)


near_distances_cached = near_distances()


# ---------------------------------------------------------------- decoding


@dataclass
class Group:
    green: tuple[list[int], int]
    red: tuple[list[int], int]
    blue: tuple[list[int], int]
    alpha: tuple[list[int], int]
    distance: tuple[list[int], int]


def _symbol(r: Reader, code: tuple[list[int], int]) -> int:
    table, bits = code
    data, at = r.data, r.at
    byte = at >> 3
    entry = table[(int.from_bytes(data[byte : byte + 4], "little") >> (at & 7)) & ((1 << bits) - 1)]
    r.at = at + (entry & 15)
    return entry >> 4


def _read_code(r: Reader, size: int) -> tuple[list[int], int]:
    lengths = [0] * size
    if r.read(1):
        n = r.read(1) + 1
        first = r.read(8 if r.read(1) else 1)
        symbols = [first] + ([r.read(8)] if n == 2 else [])
        for s in symbols:
            if s >= size:
                raise Corrupt("symbol out of range")
            lengths[s] = 1
        r.check()
        return lookup(lengths)
    n = r.read(4) + 4
    of_lengths = [0] * 19
    for k in range(n):
        of_lengths[LENGTH_ORDER[k]] = r.read(3)
    code = lookup(of_lengths)
    most = size
    if r.read(1):
        most = 2 + r.read(2 + 2 * r.read(3))
        if most > size:
            raise Corrupt("too many code lengths")
    at, before = 0, 8
    while at < size and most > 0:
        most -= 1
        s = _symbol(r, code)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        value, bits, least = ((before, 2, 3), (0, 3, 3), (0, 7, 11))[s - 16]
        count = least + r.read(bits)
        if at + count > size:
            raise Corrupt("too many code lengths")
        lengths[at : at + count] = [value] * count
        at += count
    r.check()
    return lookup(lengths)


def _prefix_value(r: Reader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    bits = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << bits) + r.read(bits) + 1


def _entropy_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = 0
    if r.read(1):
        cache_bits = r.read(4)
        if not 1 <= cache_bits <= 11:
            raise Corrupt("bad colour cache")
    meta, meta_bits, n_groups = None, 0, 1
    if main and r.read(1):
        meta_bits = r.read(3) + 2
        mw, mh = (width + (1 << meta_bits) - 1) >> meta_bits, (height + (1 << meta_bits) - 1) >> meta_bits
        meta = ((_entropy_image(r, mw, mh, False) >> 8) & 0xFFFF).reshape(mh, mw)
        n_groups = int(meta.max()) + 1
    used = set(range(n_groups)) if meta is None else set(np.unique(meta).tolist())
    groups: dict[int, Group] = {}
    for g in range(n_groups):
        codes = [_read_code(r, n) for n in (N_LITERALS + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)]
        if g in used:
            groups[g] = Group(*codes)
    r.check()
    return _pixels(r, width, height, cache_bits, meta, meta_bits, groups)


def _pixels(r: Reader, width: int, height: int, cache_bits: int, meta, meta_bits: int, groups: dict[int, Group]) -> np.ndarray:
    total = width * height
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift, cached = 32 - cache_bits, 0
    data, end = r.data, r.end
    window, base = 0, -1  # bits of the data from bit ``base`` on, at least 64 of them
    at, i = r.at, 0
    rows = meta.tolist() if meta is not None else None
    x = 0
    tile = (1 << meta_bits) - 1
    group = None
    while i < total:
        if group is None or (rows is not None and not x & tile):
            group = groups[rows[i // width >> meta_bits][x >> meta_bits] if rows is not None else 0]
            (green, gb), (red, rb), (blue, bb), (alpha, ab) = group.green, group.red, group.blue, group.alpha
            gm, rm, bm, am = (1 << gb) - 1, (1 << rb) - 1, (1 << bb) - 1, (1 << ab) - 1
        if base < 0 or at - base > 960:
            if at > end:
                raise Corrupt("truncated")
            base = at & ~7
            window = int.from_bytes(data[base >> 3 : (base >> 3) + 136], "little")
        v = window >> (at - base)
        e = green[v & gm]
        n = e & 15
        s = e >> 4
        if s < 256:
            v >>= n
            e = red[v & rm]
            k = e & 15
            n += k
            v >>= k
            f = blue[v & bm]
            k = f & 15
            n += k
            g = alpha[(v >> k) & am]
            at += n + (g & 15)
            out[i] = g >> 4 << 24 | e >> 4 << 16 | s << 8 | f >> 4
            i += 1
            x += 1
            if x == width:
                x = 0
        elif s < 280:
            r.at = at + n
            length = _prefix_value(r, s - 256)
            distance = plane_distance(width, _prefix_value(r, _symbol(r, group.distance)))
            at = r.at
            if distance > i or i + length > total:
                raise Corrupt("bad back reference")
            if distance >= length:
                out[i : i + length] = out[i - distance : i - distance + length]
            else:
                part = out[i - distance : i]
                out[i : i + length] = (part * (length // distance + 1))[:length]
            i += length
            x = i % width
            if rows is not None and i < total:
                group = None
        else:
            if cache is None or s - 280 >= len(cache):
                raise Corrupt("bad cache symbol")
            while cached < i:  # insertions wait until a look-up needs them
                c = out[cached]
                cache[(c * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = c
                cached += 1
            at += n
            out[i] = cache[s - 280]
            i += 1
            x += 1
            if x == width:
                x = 0
    r.at = at
    r.check()
    return np.array(out, np.uint32)


def decode(data: bytes, size: tuple[int, int] | None = None) -> np.ndarray:
    """(height, width) ARGB words. ``size`` (width, height): the data has no header, as alpha planes have none."""
    r = Reader(data)
    if size is None:
        if len(data) < 5 or r.read(8) != 0x2F:
            raise Corrupt("bad signature")
        width, height = r.read(14) + 1, r.read(14) + 1
        r.read(1)
        if r.read(3):
            raise Corrupt("bad version")
    else:
        width, height = size
    if width * height > MAX_PIXELS:
        raise Corrupt("too large")
    transforms, w = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in {k for k, *_ in transforms}:
            raise Corrupt("transform given twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            tw, th = (w + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            transforms.append((kind, w, bits, _entropy_image(r, tw, th, False).reshape(th, tw)))
        elif kind == PALETTE:
            n = r.read(8) + 1
            colours = added(_entropy_image(r, n, 1, False))
            bits = 0 if n > 16 else 1 if n > 4 else 2 if n > 2 else 3
            transforms.append((kind, w, bits, colours))
            w = (w + (1 << bits) - 1) >> bits
        else:
            transforms.append((kind, w, 0, None))
        r.check()
    px = _entropy_image(r, w, height, True).reshape(height, w)
    for kind, tw, bits, extra in reversed(transforms):
        if kind == GREEN:
            px = shifted_green(px, 1)
        elif kind == PALETTE:
            px = unpacked(px, tw, bits, extra)
        elif kind == CROSS_COLOUR:
            px = crossed(px, bits, extra, True)
        else:
            px = unpredicted(px, bits, extra)
    return px


def planes(px: np.ndarray) -> list[np.ndarray]:
    """Channels a, r, g, b."""
    return [(px >> np.uint32(n) & np.uint32(255)).astype(np.int32) for n in (24, 16, 8, 0)]


def words(a, r, g, b) -> np.ndarray:
    return ((a & 255).astype(np.uint32) << np.uint32(24)) | ((r & 255).astype(np.uint32) << np.uint32(16)) | ((g & 255).astype(np.uint32) << np.uint32(8)) | (b & 255).astype(np.uint32)


def added(px: np.ndarray) -> np.ndarray:
    """Running sums of each channel, modulo 256."""
    return words(*(np.cumsum(c) for c in planes(px)))


def shifted_green(px: np.ndarray, sign: int) -> np.ndarray:
    a, r, g, b = planes(px)
    return words(a, r + sign * g, g, b + sign * g)


def unpacked(px: np.ndarray, width: int, bits: int, colours: np.ndarray) -> np.ndarray:
    index = (px >> np.uint32(8)) & np.uint32(255)
    if bits:
        per, each = 1 << bits, 8 >> bits
        index = ((index[..., None] >> (np.arange(per, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)).reshape(len(px), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index]


def _tiles(tile: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(tile, 1 << bits, 0)[:height], 1 << bits, 1)[:, :width]


def crossed(px: np.ndarray, bits: int, tile: np.ndarray, undo: bool) -> np.ndarray:
    signed = lambda v: ((v & 255) ^ 128) - 128
    a, r, g, b = planes(px)
    _, r2b, g2b, g2r = (signed(_tiles(c, bits, *px.shape)) for c in planes(tile))
    to_red, to_blue = signed(g) * g2r >> 5, signed(g) * g2b >> 5
    if undo:
        red = r + to_red & 255
        return words(a, red, g, b + to_blue + (signed(red) * r2b >> 5))
    return words(a, r - to_red, g, b - to_blue - (signed(r) * r2b >> 5))


def _half(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _sum(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _select(left: int, top: int, corner: int) -> int:
    d = 0
    for n in (24, 16, 8, 0):
        c = corner >> n & 255
        d += abs((top >> n & 255) - c) - abs((left >> n & 255) - c)
    # the sum of distances of left + top - corner to left is that of top to corner
    return left if d < 0 else top


def _clamped(left: int, top: int, corner: int, halved: bool) -> int:
    out = 0
    for n in (24, 16, 8, 0):
        a, b, c = left >> n & 255, top >> n & 255, corner >> n & 255
        if halved:
            a = (a + b) >> 1
            d = a - c
            v = a + (d // 2 if d >= 0 else -(-d // 2))
        else:
            v = a + b - c
        out |= (0 if v < 0 else 255 if v > 255 else v) << n
    return out


_PREDICT = {
    1: lambda l, t, c, q: l, 5: lambda l, t, c, q: _half(_half(l, q), t), 6: lambda l, t, c, q: _half(l, c), 7: lambda l, t, c, q: _half(l, t),
    10: lambda l, t, c, q: _half(_half(l, c), _half(t, q)), 11: lambda l, t, c, q: _select(l, t, c), 12: lambda l, t, c, q: _clamped(l, t, c, False), 13: lambda l, t, c, q: _clamped(l, t, c, True),
}
BLACK = 0xFF000000


def unpredicted(px: np.ndarray, bits: int, tile: np.ndarray) -> np.ndarray:
    """Modes that don't look left are undone for a whole run of pixels at once, the others pixel by pixel."""
    height, width = px.shape
    out = np.empty_like(px)
    first = px[0].copy()
    first[0] = _sum(int(px[0, 0]), BLACK)
    out[0] = added(first)
    modes = (tile >> np.uint32(8) & np.uint32(15)).tolist()
    for y in range(1, height):
        res, row = px[y], out[y]
        row[0] = _sum(int(res[0]), int(out[y - 1, 0]))
        top = out[y - 1]
        right = np.concatenate((top[1:], row[:1]))  # of the last pixel: the first of its own row
        tops = None
        for t, mode in enumerate(modes[y >> bits]):
            a, b = max(1, t << bits), min(width, (t + 1) << bits)
            if a >= b:
                continue
            if mode in _PREDICT:
                if tops is None:
                    tops, rights = top.tolist(), right.tolist()
                f, left, done = _PREDICT[mode], int(row[a - 1]), []
                for x, v in zip(range(a, b), res[a:b].tolist()):
                    left = _sum(v, f(left, tops[x], tops[x - 1], rights[x]))
                    done.append(left)
                row[a:b] = done
            else:
                row[a:b] = _added_to(res[a:b], _from_above(mode, top[a:b], top[a - 1 : b - 1], right[a:b]))
    return out


def _halves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((a ^ b) & np.uint32(0xFEFEFEFE)) >> np.uint32(1)) + (a & b)


def _from_above(mode: int, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 8:
        return _halves(corner, top)
    if mode == 9:
        return _halves(top, right)
    return np.full_like(top, BLACK)  # 0, and the two unused modes


def _added_to(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    return words(*(x + sign * y for x, y in zip(planes(a), planes(b))))


# ---------------------------------------------------------------- encoding


def predictions(px: np.ndarray) -> np.ndarray:
    """(14, height, width): what each mode predicts from the original pixels; borders as the format has them."""
    left = np.empty_like(px)
    left[:, 1:], left[:, 0] = px[:, :-1], BLACK
    top = np.empty_like(px)
    top[1:], top[0] = px[:-1], BLACK
    corner = np.empty_like(px)
    corner[1:, 1:] = px[:-1, :-1]
    corner[0], corner[:, 0] = BLACK, BLACK
    right = np.empty_like(px)
    right[1:, :-1] = px[:-1, 1:]
    right[1:, -1], right[0] = px[1:, 0], BLACK
    L, T, C = planes(left), planes(top), planes(corner)
    far = lambda p: sum(np.abs(a - c) for a, c in zip(p, C))
    half = [(a + b) >> 1 for a, b in zip(L, T)]
    trunc = lambda d: np.where(d >= 0, d // 2, -(-d // 2))
    return np.stack([
        np.full_like(px, BLACK), left, top, right, corner, _halves(_halves(left, right), top), _halves(left, corner), _halves(left, top), _halves(corner, top), _halves(top, right), _halves(_halves(left, corner), _halves(top, right)),
        np.where(far(T) < far(L), left, top), words(*(np.clip(a + b - c, 0, 255) for a, b, c in zip(L, T, C))), words(*(np.clip(h + trunc(h - c), 0, 255) for h, c in zip(half, C))),
    ])


def predicted(px: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(tile image of the modes with the least sum of residuals, residuals)."""
    height, width = px.shape
    guess = predictions(px)
    th, tw = (height + (1 << bits) - 1) >> bits, (width + (1 << bits) - 1) >> bits
    cost = np.empty((14, th, tw), np.int64)
    for m in range(14):
        size = sum(np.abs(((a - b + 128) & 255) - 128) for a, b in zip(planes(px), planes(guess[m])))
        padded = np.zeros((th << bits, tw << bits), np.int64)
        padded[:height, :width] = size
        cost[m] = padded.reshape(th, 1 << bits, tw, 1 << bits).sum((1, 3))
    modes = cost.argmin(0)
    mode = _tiles(modes, bits, height, width).copy()
    mode[0], mode[:, 0] = 1, 2
    mode[0, 0] = 0
    best = np.take_along_axis(guess, mode[None], 0)[0]
    return words(np.full(modes.shape, 255), np.zeros_like(modes), modes, np.zeros_like(modes)), _added_to(px, best, -1)


def cross_multipliers(px: np.ndarray, bits: int) -> np.ndarray:
    """Tile image of multipliers by least squares: red and blue against green, then blue's rest against red."""
    height, width = px.shape
    signed = lambda v: ((v & 255) ^ 128) - 128
    _, r, g, b = (signed(c).astype(np.float64) for c in planes(px))
    th, tw = (height + (1 << bits) - 1) >> bits, (width + (1 << bits) - 1) >> bits

    def sums(v):
        padded = np.zeros((th << bits, tw << bits))
        padded[:height, :width] = v
        return padded.reshape(th, 1 << bits, tw, 1 << bits).sum((1, 3))

    gg, rr = np.maximum(sums(g * g), 1), np.maximum(sums(r * r), 1)
    q = lambda v: np.clip(np.round(32 * v), -128, 127).astype(np.int64)
    g2r, g2b = q(sums(g * r) / gg), q(sums(g * b) / gg)
    rest = b - _tiles(g2b, bits, height, width) * g / 32
    r2b = q(sums(r * rest) / rr)
    return words(np.full(g2r.shape, 255), r2b, g2b, g2r)


def _runs(same: np.ndarray) -> np.ndarray:
    """How many places from each on are true without a break."""
    breaks = np.flatnonzero(~same)
    at = np.arange(len(same))
    return np.concatenate((breaks, [len(same)]))[np.searchsorted(breaks, at)] - at


def _earlier(keys: np.ndarray) -> np.ndarray:
    """The last place before each that has the same key, -1 where there is none."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1)
    again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]]) + 1
    out[order[again]] = order[again - 1]
    return out


def distance_codes(width: int) -> dict[int, int]:
    """The short code of each distance that has one, the least where it has several."""
    return {plane_distance(width, c): c for c in range(120, 0, -1)}


def _matches(px: np.ndarray, search: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a flat image: (start, length, distance code), code 0 for a literal. Repeats of the pixel to the left and of the
    row above are found for all pixels at once; with ``search``, so are those of the last place where the next four pixels
    were the same (a match goes on as long as its distance does). The longest is taken, from left to right."""
    height, width = px.shape
    flat = px.ravel()
    n = len(flat)
    left = np.zeros(n, bool)
    left[1:] = flat[1:] == flat[:-1]
    above = np.zeros(n, bool)
    above[width:] = flat[width:] == flat[:-width]
    a, b = _runs(left), _runs(above)
    longest, code = np.maximum(a, b), np.where(b >= a, 1, 2)  # short distance codes of (0, 1) and (1, 0)
    if search and n > 8:
        h = flat.astype(np.uint64)
        h = (h[:-3] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:-2] * np.uint64(0xBF58476D1CE4E5B9)) ^ (h[2:-1] * np.uint64(0x94D049BB133111EB)) ^ h[3:]
        before = _earlier(h)
        distance = np.full(n, 0)
        distance[: n - 3] = np.where(before >= 0, np.arange(n - 3) - before, 0)
        far = np.flatnonzero(distance)
        same = np.zeros(n, bool)
        same[far] = flat[far] == flat[far - distance[far]]
        goes_on = same.copy()
        goes_on[:-1] &= distance[1:] == distance[:-1]  # the next place matches at the same distance
        c = np.minimum(_runs(goes_on) + 1, n - np.arange(n))
        c[~same] = 0
        c = np.where((c > 0) & (distance < (1 << 20) - 120), c, 0)
        better = c > longest + 2
        short = distance_codes(width)
        kinds, at = np.unique(distance[better], return_inverse=True)
        longest = np.where(better, c, longest)
        code[better] = np.array([short.get(int(d), int(d) + 120) for d in kinds], np.int64)[at] if len(kinds) else 0
    longest = np.minimum(longest, 4096)
    out_at, out_n, out_c = [], [], []
    starts = np.flatnonzero(longest >= 4)
    i = 0
    while True:
        k = int(np.searchsorted(starts, i))
        nxt = int(starts[k]) if k < len(starts) else n
        if nxt > i:
            out_at.append(np.arange(i, nxt))
            out_n.append(np.ones(nxt - i, np.int64))
            out_c.append(np.zeros(nxt - i, np.int64))
        if nxt >= n:
            break
        out_at.append(np.array([nxt]))
        out_n.append(longest[nxt : nxt + 1])
        out_c.append(code[nxt : nxt + 1])
        i = nxt + int(longest[nxt])
    return np.concatenate(out_at), np.concatenate(out_n), np.concatenate(out_c)


def cache_hits(flat: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, hit) of each pixel in a colour cache that every pixel before it has entered."""
    slot = ((flat.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)
    before = _earlier(slot)
    return slot, (before >= 0) & (flat[before] == flat)


def prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their value) of values of at least 1."""
    v = v.astype(np.int64) - 1
    high = np.where(v > 0, np.floor(np.log2(np.maximum(v, 1) + 0.0)).astype(np.int64), 0)
    bits = np.maximum(high - 1, 0)
    symbol = np.where(v < 2, v, 2 * high + (v >> bits & 1))
    return symbol, np.where(v < 2, 0, bits), np.where(v < 2, 0, v & ((1 << bits) - 1))


def _write_code(w: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write an alphabet's code; (codes, lengths) for its use. A code of one symbol takes no bits."""
    used = np.flatnonzero(counts)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(int(symbols[0] > 1), 1)
        w.put(symbols[0], 8 if symbols[0] > 1 else 1)
        lengths = np.zeros(len(counts), np.int64)
        if len(symbols) == 2:
            w.put(symbols[1], 8)
            lengths[symbols] = 1
        return canonical(lengths), lengths
    lengths = code_lengths(counts, 15)
    tokens = []  # (symbol, extra value, extra bits)
    i, n, before = 0, len(lengths), 8
    while i < n:
        v = int(lengths[i])
        run = 1
        while i + run < n and lengths[i + run] == v:
            run += 1
        i += run
        if v == 0:
            while run >= 11:
                k = min(run, 138)
                tokens.append((18, k - 11, 7))
                run -= k
            if run >= 3:
                tokens.append((17, run - 3, 3))
                run = 0
            tokens += [(0, 0, 0)] * run
            continue
        if v != before:
            tokens.append((v, 0, 0))
            before, run = v, run - 1
        while run >= 3:
            k = min(run, 6)
            tokens.append((16, k - 3, 2))
            run -= k
        tokens += [(v, 0, 0)] * run
    of_lengths = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes = canonical(of_lengths)
    shown = max([4, *(k + 1 for k, s in enumerate(LENGTH_ORDER) if of_lengths[s])])
    w.put(0, 1)
    w.put(shown - 4, 4)
    for s in LENGTH_ORDER[:shown]:
        w.put(int(of_lengths[s]), 3)
    w.put(0, 1)
    alone = np.count_nonzero(of_lengths) == 1
    for s, extra, bits in tokens:
        w.put(int(codes[s]), 0 if alone else int(of_lengths[s]))
        w.put(extra, bits)
    if np.count_nonzero(lengths) == 1:
        lengths = np.zeros_like(lengths)
    return canonical(lengths) if lengths.any() else np.zeros(len(counts), np.uint64), lengths


def _bits(counts: np.ndarray) -> float:
    """What an optimal code spends on these symbols, and about what its lengths take."""
    used = counts[counts > 0].astype(np.float64)
    return float((used * np.log2(used.sum() / used)).sum()) + 3 * len(used) if len(used) > 1 else 0.0


def _write_image(w: Writer, px: np.ndarray, main: bool, search: bool = False) -> None:
    at, n, code = _matches(px, search)
    flat = px.ravel()
    a, r, g, b = (c.ravel()[at] for c in planes(px))
    single = code == 0
    symbol, bits, extra = prefix(n)
    d_symbol, d_bits, d_extra = prefix(np.maximum(code, 1))
    count = lambda v, size: np.bincount(v, minlength=size)
    best = None
    for cache in (0, 4, 8) if search else (0,):
        slot, hit = cache_hits(flat, cache) if cache else (np.zeros(len(flat), np.int64), np.zeros(len(flat), bool))
        hit = hit[at] & single
        literal = single & ~hit
        first = np.where(literal, g, np.where(hit, 280 + slot[at], 256 + symbol))
        counts = (count(first, N_LITERALS + N_LENGTHS + (1 << cache if cache else 0)), count(r[literal], 256), count(b[literal], 256), count(a[literal], 256), count(d_symbol[~single], N_DISTANCES))
        size = sum(map(_bits, counts))
        if best is None or size < best[0]:
            best = size, cache, literal, first, counts
    _, cache, literal, first, counts = best
    w.put(int(cache > 0), 1)
    if cache:
        w.put(cache, 4)
    if main:
        w.put(0, 1)  # one group of codes
    codes = [_write_code(w, c) for c in counts]
    pick = lambda k, s: (codes[k][0][s], codes[k][1][s])
    columns = [pick(0, first)]
    for k, v, v_extra, v_bits in ((1, r, extra, bits), (2, b, d_symbol, None), (3, a, d_extra, d_bits)):
        lit_code, lit_size = pick(k, v)
        if v_bits is None:
            other, other_size = pick(4, v_extra)
        else:
            other, other_size = v_extra.astype(np.uint64), v_bits
        other_size = np.where(single, 0, other_size)  # what the cache holds has no more to say
        columns.append((np.where(literal, lit_code, other), np.where(literal, lit_size, other_size)))
    w.put_all(np.stack([c for c, _ in columns], 1).ravel(), np.stack([s for _, s in columns], 1).ravel())


def _palette_packed(px: np.ndarray) -> tuple[np.ndarray, np.ndarray, int] | None:
    colours = np.unique(px)
    n = len(colours)
    if n > 256:
        return None
    bits = 0 if n > 16 else 1 if n > 4 else 2 if n > 2 else 3
    index = np.searchsorted(colours, px)
    if bits:
        per, each = 1 << bits, 8 >> bits
        padded = np.zeros((px.shape[0], -(-px.shape[1] // per) * per), np.int64)
        padded[:, : px.shape[1]] = index
        index = (padded.reshape(px.shape[0], -1, per) << (np.arange(per) * each)).sum(2)
    return colours, words(np.full(index.shape, 255), np.zeros_like(index), index, np.zeros_like(index)), bits


def transforms_for(n_colours: int, quality: float) -> tuple[bool, bool, bool, bool]:
    """(palette, green, predictor, cross colour)."""
    if n_colours <= 256:
        return True, False, False, False
    return False, quality >= 25, quality >= 10, quality >= 50


def encode(px: np.ndarray, quality: float = 75.0, header: bool = True) -> bytes:
    """(height, width) ARGB words to a bitstream."""
    px = np.ascontiguousarray(px, np.uint32)
    height, width = px.shape
    w = Writer()
    if header:
        for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
            w.put(value, bits)
    found = _palette_packed(px)
    _, green, predictor, cross = transforms_for(len(found[0]) if found else 257, quality)
    if found:
        colours, px, _ = found
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(colours) - 1, 8)
        steps = words(*(np.diff(c, prepend=0) for c in planes(colours)))
        _write_image(w, steps.reshape(1, -1), False)
    else:
        if green:
            w.put(1, 1)
            w.put(GREEN, 2)
            px = shifted_green(px, -1)
        if predictor:
            tile, px = predicted(px, 4)
            w.put(1, 1)
            w.put(PREDICTOR, 2)
            w.put(4 - 2, 3)
            _write_image(w, tile, False)
        if cross:
            tile = cross_multipliers(px, 5)
            px = crossed(px, 5, tile, False)
            w.put(1, 1)
            w.put(CROSS_COLOUR, 2)
            w.put(5 - 2, 3)
            _write_image(w, tile, False)
    w.put(0, 1)
    _write_image(w, px, True, quality >= 25)
    return w.getvalue()
