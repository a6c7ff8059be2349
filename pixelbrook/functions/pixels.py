"""Arithmetic on pixels held in integer columns. ARGB words are BIGINT, so that bit 31 isn't a sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(v: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def shr(v: Column, n: int) -> Column:
    return F.shiftright(v, n)


def argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    long = lambda c, n: F.shiftleft(c.cast("long"), n)
    return long(a, 24) + long(r, 16) + long(g, 8) + b.cast("long")


def channels(word: Column) -> dict[str, Column]:
    return {c: shr(word, n).bitwiseAND(255).cast("int") for c, n in (("a", 24), ("r", 16), ("g", 8), ("b", 0))}


# Rows of the colour matrices in 16-bit fixed point (Y, U, V; each with R, G, B and an offset).
MATRICES = {
    "native": ((16839, 33059, 6420, 16 << 16), (-9719, -19081, 28800, 128 << 16), (28800, -24116, -4684, 128 << 16)),
    "rec601_limited": ((16829, 33039, 6416, 16 << 16), (-9714, -19071, 28784, 128 << 16), (28784, -24103, -4681, 128 << 16)),
    "rec601_full": ((19595, 38470, 7471, 0), (-11058, -21710, 32768, 128 << 16), (32768, -27439, -5329, 128 << 16)),
    "rec709_limited": ((11966, 40254, 4064, 16 << 16), (-6596, -22189, 28784, 128 << 16), (28784, -26145, -2639, 128 << 16)),
    "rec709_full": ((13933, 46871, 4732, 0), (-7509, -25259, 32768, 128 << 16), (32768, -29763, -3005, 128 << 16)),
}


def matrix_row(r: Column, g: Column, b: Column, row: tuple[int, int, int, int]) -> Column:
    return shr(r * row[0] + g * row[1] + b * row[2] + (row[3] + (1 << 15)), 16)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Video-range luma of one pixel."""
    return matrix_row(r, g, b, MATRICES["native"][0])


def chroma(r4: Column, g4: Column, b4: Column, which: str) -> Column:
    """U or V from the sums of four pixels."""
    row = MATRICES["native"]["yuv".index(which)]
    return clip(shr(r4 * row[0] + g4 * row[1] + b4 * row[2] + ((1 << 17) + (128 << 18)), 18))


def video_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """YUV to RGB, video range, 14-bit fixed point."""
    high = lambda c, k: shr(c * k, 8)
    out = lambda c: clip(shr(clip(c, 0, (256 << 6) - 1), 6))
    y = high(y, 19077)
    return out(y + high(v, 26149) - 14234), out(y - high(u, 6419) - high(v, 13320) + 8708), out(y + high(u, 33050) - 17685)


def jfif_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """YUV to RGB, full range, as the animation path has it (16-bit fixed point)."""
    y, u, v = y * 0x10101, u - 128, v - 128
    out = lambda c: clip(shr(c, 16))
    return out(y + 91881 * v), out(y - 22554 * u - 46802 * v), out(y + 116130 * u)


def yuv_to_rgb(y: Column, u: Column, v: Column, range: str = "video") -> tuple[Column, Column, Column]:
    return {"video": video_rgb, "jfif": jfif_rgb}[range](y, u, v)


def source_over(src: dict[str, Column], dst: dict[str, Column]) -> dict[str, Column]:
    """Non-premultiplied source-over in integers."""
    long = {k: v.cast("long") for k, v in src.items()}
    below = shr(dst["a"].cast("long") * (256 - long["a"]), 8)
    alpha = long["a"] + below
    scale = F.expr("1L << 24") / F.greatest(alpha, F.lit(1))
    scale = F.floor(scale)
    mix = {c: F.least(shr((long[c] * long["a"] + dst[c].cast("long") * below) * scale, 24), F.lit(255)) for c in "rgb"} | {"a": alpha}
    return {c: F.when(src["a"] == 0, dst[c]).when((src["a"] == 255) | (dst["a"] == 0), src[c]).otherwise(mix[c]).cast("int") for c in "argb"}


def most_difference(quality: Column) -> Column:
    root = F.sqrt(quality / 100.0)
    return F.floor(31.0 * (1.0 - root) + root + 0.5).cast("int")


def similar(src: dict[str, Column], dst: dict[str, Column], most: Column) -> Column:
    near = lambda c: F.abs(src[c] - dst[c]) * dst["a"] <= most * 255
    return (src["a"] == dst["a"]) & near("r") & near("g") & near("b")


def even_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, ...]:
    """A rectangle (ends exclusive) moved to an even origin, grown on that side."""
    return x0 - x0.bitwiseAND(1), y0 - y0.bitwiseAND(1), x1, y1


def minus_green(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    return (r - g).bitwiseAND(255), (b - g).bitwiseAND(255)


def plus_green(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    return (r + g).bitwiseAND(255), (b + g).bitwiseAND(255)


def _signed(v: Column) -> Column:
    v = v.bitwiseAND(255)
    return v - F.when(v > 127, 256).otherwise(0)


def _delta(multiplier: Column, channel: Column) -> Column:
    return shr(_signed(multiplier) * _signed(channel), 5)


def cross_colour(r: Column, g: Column, b: Column, g2r: Column, g2b: Column, r2b: Column) -> tuple[Column, Column]:
    """Red and blue left after what green and red predict of them."""
    return (r - _delta(g2r, g)).bitwiseAND(255), (b - _delta(g2b, g) - _delta(r2b, r)).bitwiseAND(255)


def uncross_colour(r: Column, g: Column, b: Column, g2r: Column, g2b: Column, r2b: Column) -> tuple[Column, Column]:
    red = (r + _delta(g2r, g)).bitwiseAND(255)
    return red, (b + _delta(g2b, g) + _delta(r2b, red)).bitwiseAND(255)


def predicted(mode: int, left: Column, top: Column, corner: Column, right: Column) -> Column:
    """One channel's prediction from the pixels beside it (modes 11, select, needs whole pixels: ``selects_left``)."""
    half = lambda a, b: shr(a + b, 1)
    return {
        0: F.lit(0), 1: left, 2: top, 3: right, 4: corner, 5: half(half(left, right), top), 6: half(left, corner), 7: half(left, top), 8: half(corner, top), 9: half(top, right),
        10: half(half(left, corner), half(top, right)), 12: clip(left + top - corner),
    }[mode] if mode != 13 else clip(half(left, top) + ((half(left, top) - corner) / 2).cast("int"))


def selects_left(left: dict[str, Column], top: dict[str, Column], corner: dict[str, Column]) -> Column:
    """Whether the select predictor takes the left pixel: the sum of channels' distances to left + top - corner is less."""
    far = lambda one: sum(F.abs(one[c] - corner[c]) for c in "argb")
    return far(top) < far(left)


def cache_slot(word: Column, bits: int) -> Column:
    return shr((word * 0x1E35A7BD).bitwiseAND(0xFFFFFFFF), 32 - bits)


def prefix_code(value: Column) -> tuple[Column, Column, Column]:
    """(code, extra bits, their value) of a length or distance of at least 1."""
    v = value.cast("long") - 1
    high = (F.length(F.bin(v)) - 1).cast("int")
    second = F.expr("1") * F.when(v >= 2, F.expr("0")).otherwise(0)
    shift = F.greatest(high - 1, F.lit(0))
    second = F.floor(v / F.pow(F.lit(2.0), shift)).cast("long").bitwiseAND(1)
    code = F.when(v < 2, v).otherwise(2 * high + second).cast("int")
    bits = F.when(v < 2, 0).otherwise(shift).cast("int")
    return code, bits, (v - F.floor(v / F.pow(F.lit(2.0), bits)).cast("long") * F.pow(F.lit(2.0), bits).cast("long")).cast("long")


def quality_index(quality: Column) -> Column:
    """Quantiser index 0..127 of a lossy quality 0..100."""
    c = quality / 100.0
    linear = F.when(c < 0.75, c * (2.0 / 3.0)).otherwise(2.0 * c - 1.0)
    index = F.floor(127.0 * (1.0 - F.pow(linear, F.lit(1.0 / 3.0)))).cast("int")
    return F.when(quality <= 0, 127).when(quality >= 100, 0).otherwise(clip(index, 0, 127))


def alpha_levels(quality: Column) -> Column:
    return F.when(quality >= 100, 256).when(quality <= 70, 2 + F.floor(quality / 5)).otherwise(16 + (quality - 70) * 8).cast("int")


def unmultiplied(c: Column, a: Column) -> Column:
    """A premultiplied channel's own value, truncated."""
    return F.when(a == 0, 0).otherwise(F.floor(c * 255 / F.greatest(a, F.lit(1)))).cast("int")


def rgb565(r: Column, g: Column, b: Column) -> Column:
    return (r.bitwiseAND(0xF8) * 256 + shr(g, 2) * 32 + shr(b, 3)).cast("int")


def rgba4444(r: Column, g: Column, b: Column, a: Column) -> Column:
    return (r.bitwiseAND(0xF0) * 256 + shr(g, 4) * 256 + b.bitwiseAND(0xF0) + shr(a, 4)).cast("int")


def psnr(sse: Column, n: Column) -> Column:
    return F.when(sse == 0, 99.0).otherwise(10.0 * F.log10(255.0 * 255.0 * n / sse))


def hadamard(t: list[Column]) -> list[Column]:
    """Sums and differences of 16 values by rows, then columns (the 4x4 Walsh-Hadamard transform, unscaled)."""
    def four(a, b, c, d):
        s, t_, u, v = a + d, b + c, b - c, a - d
        return s + t_, v + u, s - t_, v - u

    rows = [four(*t[4 * i : 4 * i + 4]) for i in range(4)]
    cols = [four(*(rows[i][k] for i in range(4))) for k in range(4)]
    return [cols[k][i] for i in range(4) for k in range(4)]


#: Weights of the texture distortion, by row (fixed values).
TEXTURE = (38, 32, 20, 9, 32, 28, 17, 7, 20, 17, 10, 4, 9, 7, 4, 2)


def _texture(v: list[Column]) -> Column:
    def four(a, b, c, d):
        p, q, r, s = a + c, b + d, b - d, a - c
        return p + q, s + r, s - r, p - q

    rows = [four(*v[4 * k : 4 * k + 4]) for k in range(4)]
    cols = [four(*(rows[r][k] for r in range(4))) for k in range(4)]
    return sum((TEXTURE[4 * r + k] * F.abs(cols[k][r]) for r in range(4) for k in range(4)), F.lit(0))


def texture_distortion(a: list[Column], b: list[Column]) -> Column:
    """Difference of two 4 x 4 blocks in the weighted Hadamard domain."""
    return shr(F.abs(_texture(b) - _texture(a)), 5)


def forward_dct(d: list[Column]) -> list[Column]:
    """The lossy codec's 4 x 4 transform of 16 differences, in integers."""
    mid: list[Column] = []
    for k in range(4):
        p, q, r, s = d[4 * k] + d[4 * k + 3], d[4 * k + 1] + d[4 * k + 2], d[4 * k + 1] - d[4 * k + 2], d[4 * k] - d[4 * k + 3]
        mid += [(p + q) * 8, shr(r * 2217 + s * 5352 + 1812, 9), (p - q) * 8, shr(s * 2217 - r * 5352 + 937, 9)]
    out: list[Column] = [None] * 16
    for k in range(4):
        p, q, r, s = mid[k] + mid[12 + k], mid[4 + k] + mid[8 + k], mid[4 + k] - mid[8 + k], mid[k] - mid[12 + k]
        out[k], out[8 + k] = shr(p + q + 7, 4), shr(p - q + 7, 4)
        out[4 + k] = shr(r * 2217 + s * 5352 + 12000, 16) + F.when(s != 0, 1).otherwise(0)
        out[12 + k] = shr(s * 2217 - r * 5352 + 51000, 16)
    return out


def inverse_dct(c: list[Column]) -> list[Column]:
    """Differences back from 16 coefficients: columns first, then rows with rounding by 8."""
    one, two = (lambda v: shr(v * 20091, 16) + v), (lambda v: shr(v * 35468, 16))

    def four(a, b, c_, d):
        p, q, r, s = a + c_, a - c_, two(b) - one(d), one(b) + two(d)
        return p + s, q + r, q - r, p - s

    cols = [four(*(c[k + 4 * r] for r in range(4))) for k in range(4)]
    rows = [four(cols[0][r] + 4, cols[1][r], cols[2][r], cols[3][r]) for r in range(4)]
    return [shr(rows[r][k], 3) for r in range(4) for k in range(4)]


def quantised(c: Column, step: int) -> Column:
    """To the nearest multiple's number, away from zero at ties."""
    return (F.signum(c) * F.floor((F.abs(c) + step // 2) / step)).cast("int")


def _power(v: Column, e: float) -> Column:
    return F.pow(F.greatest(v, F.lit(0.0)), F.lit(e))


# Constants of the transfer functions, from the public video standards.
_BT709 = (0.018053968510807, 4.5, 1.09929682680944, 0.45)  # end of the linear part, its slope, scale and exponent of the rest
_SMPTE240 = (0.022821585529445, 4.0, 1.111572195921731, 0.45)
_SRGB = (0.0030412825601275209, 12.92, 1.0550107189475866, 1 / 2.4)
_HLG = (0.17883277, 0.28466892, 0.55991073)
_PQ = (107 / 128, 2413 / 128, 2392 / 128, 653 / 4096, 2523 / 32)
_SMPTE428, _BT1361 = 0.91655527974030934, 0.27482420670236


def _bent_to_linear(v: Column, curve: tuple[float, float, float, float]) -> Column:
    end, slope, scale, e = curve
    return F.when(v < slope * end, v / slope).otherwise(_power((v + (scale - 1)) / scale, 1 / e))


def _bent_from_linear(v: Column, curve: tuple[float, float, float, float]) -> Column:
    end, slope, scale, e = curve
    return F.when(v < end, v * slope).otherwise(scale * _power(v, e) - (scale - 1))


def _unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


TRANSFERS = ("bt709", "bt601", "bt2020_10", "bt2020_12", "bt470m", "bt470bg", "smpte240", "linear", "log100", "log100sqrt", "iec61966", "bt1361", "srgb", "pq", "smpte428", "hlg")
_SAME_AS = {"bt601": "bt709", "bt2020_10": "bt709", "bt2020_12": "bt709"}


def to_linear(v: Column, transfer: str) -> Column:
    """Light from a signal, by the transfer functions of the public video standards."""
    a, b, c = _HLG
    c1, c2, c3, m1, m2 = _PQ
    power = _power(v, 1 / m2)
    curve = {
        "bt709": lambda: F.least(_bent_to_linear(F.greatest(v, F.lit(0.0)), _BT709), F.lit(1.0)),
        "bt470m": lambda: _power(_unit(v), 2.2), "bt470bg": lambda: _power(_unit(v), 2.8),
        "smpte240": lambda: F.least(_bent_to_linear(F.greatest(v, F.lit(0.0)), _SMPTE240), F.lit(1.0)), "linear": lambda: v,
        "log100": lambda: F.when(v <= 0, 0.005).otherwise(F.pow(F.lit(10.0), 2 * (F.least(v, F.lit(1.0)) - 1))),
        "log100sqrt": lambda: F.when(v <= 0, 0.00316227766 / 2).otherwise(F.pow(F.lit(10.0), 2.5 * (F.least(v, F.lit(1.0)) - 1))),
        "iec61966": lambda: F.signum(v) * _bent_to_linear(F.abs(v), _BT709),
        "bt1361": lambda: F.when(v < -0.25, -0.25).when(v < 0, _power((v - (1 - _BT1361 * 4) / -4) / -_BT1361, 1 / 0.45) / -4).otherwise(F.least(_bent_to_linear(v, _BT709), F.lit(1.0))),
        "srgb": lambda: _bent_to_linear(F.greatest(v, F.lit(0.0)), _SRGB),
        "pq": lambda: F.when(v > 0, _power(F.greatest(power - c1, F.lit(0.0)) / (c2 - c3 * power), 1 / m1)).otherwise(0.0),
        "smpte428": lambda: _power(v, 2.6) / _SMPTE428,
        "hlg": lambda: F.when(v < 0, 0.0).otherwise(_power(F.when(v <= 0.5, v * v / 3).otherwise((F.exp((v - c) / a) + b) / 12), 1.2)),
    }
    return curve[_SAME_AS.get(transfer, transfer)]()


def from_linear(v: Column, transfer: str) -> Column:
    """The signal back from light."""
    a, b, c = _HLG
    c1, c2, c3, m1, m2 = _PQ
    power, scene = _power(v, m1), _power(v, 1 / 1.2)
    curve = {
        "bt709": lambda: F.least(_bent_from_linear(F.greatest(v, F.lit(0.0)), _BT709), F.lit(1.0)),
        "bt470m": lambda: _power(_unit(v), 1 / 2.2), "bt470bg": lambda: _power(_unit(v), 1 / 2.8),
        "smpte240": lambda: F.least(_bent_from_linear(F.greatest(v, F.lit(0.0)), _SMPTE240), F.lit(1.0)), "linear": lambda: v,
        "log100": lambda: F.when(v < 0.01, 0.0).otherwise(1 + F.log10(F.least(v, F.lit(1.0))) / 2),
        "log100sqrt": lambda: F.when(v < 0.00316227766, 0.0).otherwise(1 + F.log10(F.least(v, F.lit(1.0))) / 2.5),
        "iec61966": lambda: F.signum(v) * _bent_from_linear(F.abs(v), _BT709),
        "bt1361": lambda: F.when(v < -0.25, -0.25).when(v < 0, -_BT1361 * _power(-4 * v, 0.45) + (1 - _BT1361 * 4) / -4).otherwise(F.least(_bent_from_linear(v, _BT709), F.lit(1.0))),
        "srgb": lambda: _bent_from_linear(F.greatest(v, F.lit(0.0)), _SRGB),
        "pq": lambda: F.when(v > 0, _power((c1 + c2 * power) / (1 + c3 * power), m2)).otherwise(0.0),
        "smpte428": lambda: _power(_SMPTE428 * v, 1 / 2.6),
        "hlg": lambda: F.when(scene <= 1 / 12, F.sqrt(3 * scene)).otherwise(a * F.log(12 * scene - b) + c),
    }
    return curve[_SAME_AS.get(transfer, transfer)]()


def colour_matrix(kr: Column, kb: Column, depth: int = 8, limited: bool = True) -> list[Column]:
    """Twelve entries (Y, U, V; each with R, G, B and an offset) in 16-bit fixed point, from a colour space's luma weights."""
    kg = 1.0 - kr - kb
    top, shift = float((1 << depth) - 1), depth - 8
    y, uv = ((219 << shift) / top, (224 << shift) / top) if limited else (1.0, 1.0)
    su, sv, middle = 0.5 / (1.0 - kb) * uv, 0.5 / (1.0 - kr) * uv, F.lit(float(128 << shift))
    rows = (kr * y, kg * y, kb * y, F.lit(float(16 << shift if limited else 0)), -kr * su, -kg * su, (1.0 - kb) * su, middle, (1.0 - kr) * sv, -kg * sv, -kb * sv, middle)
    return [F.floor(v * 65536 + 0.5).cast("long") for v in rows]


# The seeds of the dither generator.
DITHER_SEEDS = (
    0x0DE15230, 0x03B31886, 0x775FACCB, 0x1C88626A, 0x68385C55, 0x14B3B828, 0x4A85FEF8, 0x49DDB84B, 0x64FCF397, 0x5C550289, 0x4A290000,
    0x0D7EC1DA, 0x5940B7AB, 0x5492577D, 0x4E19CA72, 0x38D38C69, 0x0C01EE65, 0x32A1755F, 0x5437F652, 0x5ABB2C32, 0x0FAA57B1, 0x73F533E7,
    0x685FEEDA, 0x7563CCE2, 0x6E990E83, 0x4730A7ED, 0x4FC0D9C6, 0x496B153C, 0x4F1403FA, 0x541AFB0C, 0x73990B32, 0x26D7CB1C, 0x6FCC3706,
    0x2CBB77D8, 0x75762F2A, 0x6425CCDD, 0x24B35461, 0x0A7D8715, 0x220414A8, 0x141EBF67, 0x56B41583, 0x73E502E3, 0x44CAB16F, 0x28264D42,
    0x73BAAEFB, 0x0A50EBED, 0x1D6AB6FB, 0x0D3AD40B, 0x35DB3B68, 0x2B081E83, 0x77CE6B95, 0x5181E5F0, 0x78853BBC, 0x009F9494, 0x27E5ED3C,
)


def dither(n: int, bits: int, strength: float) -> list[int]:
    """n numbers of so many bits around the middle, spread by a strength of 0..1: each is that of 55 places before less that of
    24 before, modulo 2^31, as a signed fraction."""
    amplitude = int(256 * min(max(strength, 0.0), 1.0))
    seen, out = list(DITHER_SEEDS), []
    for k in range(n):
        seen.append((seen[k] - seen[k + 31]) % (1 << 31))
        signed = seen[-1] if seen[-1] < 1 << 30 else seen[-1] - (1 << 31)
        out.append((signed >> (31 - bits)) * amplitude // 256 + (1 << (bits - 1)))
    return out


def dequantised(level: Column, step: int) -> Column:
    return (level * step).cast("int")


def premultiplied(c: Column, a: Column, inverse: bool = False) -> Column:
    """A channel times alpha (or, inverse, over it) in 24-bit fixed point, rounded to nearest; opaque pixels stay, transparent ones
    are 0."""
    scale = F.floor(F.lit(255 << 24) / a).cast("long") if inverse else a.cast("long") * ((1 << 24) // 255)
    return F.when(a == 255, c).when(a == 0, 0).otherwise(shr((c * scale + (1 << 23)).bitwiseAND(0xFFFFFFFF), 24)).cast("int")
