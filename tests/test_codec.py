"""Bitstreams: exact round trips on generated images, properties of the parts, and corrupt input."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelbrook.codec import alpha, bits, columns, lossless


def image(kind, w, h, seed=1):
    y, x = np.mgrid[:h, :w]
    rng = np.random.default_rng(seed)
    full = np.full((h, w), 255)
    if kind == "gradient":
        return lossless.words(full, x * 255 // max(w - 1, 1), y * 255 // max(h - 1, 1), (x + y) * 127 // max(w + h - 2, 1))
    if kind == "noisy":
        return lossless.words(full, (7 * x + 3 * y) & 255, (5 * x ^ 11 * y) & 255, (x ^ 4 * y) & 255)
    if kind == "random":
        return rng.integers(0, 2**32, (h, w), np.uint64).astype(np.uint32)
    if kind == "solid":
        return lossless.words(full, full * 0 + 9, full * 0 + 200, full * 0 + 31)
    return rng.integers(0, 2**32, int(kind), np.uint64).astype(np.uint32)[(y * w + x) % int(kind)]


@pytest.mark.parametrize("kind", ["gradient", "noisy", "random", "solid", "2", "3", "5", "17", "256", "257"])
@pytest.mark.parametrize("size", [(1, 1), (1, 17), (17, 1), (15, 16), (33, 17), (128, 64)])
@pytest.mark.parametrize("quality", [0, 20, 30, 75])
def test_lossless_round_trip(kind, size, quality):
    px = image(kind, *size)
    assert np.array_equal(lossless.decode(lossless.encode(px, quality)), px)


@pytest.mark.parametrize("quality", [100, 80, 40, 0])
@pytest.mark.parametrize("filtering", [0, 1, 2])
def test_alpha_round_trip(quality, filtering):
    plane = (image("noisy", 33, 18) >> np.uint32(16) & np.uint32(255)).astype(np.uint8)
    back = alpha.decode(alpha.encode(plane, quality, 1, filtering), 33, 18)
    assert np.array_equal(back, alpha.quantised(plane, alpha.levels(quality)))
    assert len(np.unique(back)) <= alpha.levels(quality)


@pytest.mark.parametrize("method", range(4))
@pytest.mark.parametrize("size", [(1, 1), (1, 9), (9, 1), (13, 31)])
def test_alpha_filters_invert(method, size):
    plane = np.random.default_rng(3).integers(0, 256, size).astype(np.uint8)
    res = ((plane.astype(int) - alpha.guess(plane, method)) & 255).astype(np.uint8)
    assert np.array_equal(alpha.unfiltered(res.copy(), method), plane)


@given(st.lists(st.integers(0, 500), min_size=1, max_size=60), st.sampled_from([7, 15]))
@settings(max_examples=60, deadline=None)
def test_code_lengths(counts, limit):
    lengths = bits.code_lengths(np.array(counts), limit)
    used = [n for n, c in zip(lengths, counts) if c]
    assert all(n == 0 for n, c in zip(lengths, counts) if not c)
    if len(used) > 1:
        assert max(used) <= limit and sum(2.0**-n for n in used) == 1


@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 32)), max_size=80))
@settings(max_examples=60, deadline=None)
def test_bits_round_trip(pairs):
    w = bits.Writer()
    for v, n in pairs:
        w.put(v & ((1 << n) - 1), n)
    r = bits.Reader(w.getvalue())
    for v, n in pairs:
        assert r.read(n) == v & ((1 << n) - 1)


def test_transforms_invert():
    px = image("random", 40, 24)
    assert np.array_equal(lossless.shifted_green(lossless.shifted_green(px, -1), 1), px)
    tile = image("random", 2, 1)
    assert np.array_equal(lossless.crossed(lossless.crossed(px, 5, tile, False), 5, tile, True), px)
    modes, res = lossless.predicted(px, 3)
    assert np.array_equal(lossless.unpredicted(res, 3, modes), px)


def test_corrupt_streams_give_errors():
    rng = np.random.default_rng(9)
    content, error = columns.encode_image(columns.rgba(image("noisy", 40, 30)), 40, 30)
    assert error is None
    for k in range(0, len(content), 7):
        columns.decode_image(content[:k])
    for _ in range(150):
        bad = bytearray(content)
        for at in rng.integers(20, len(bad), 3):
            bad[at] = rng.integers(0, 256)
        columns.decode_image(bytes(bad))
    assert columns.decode_image(None)[3] and columns.encode_image(None, 1, 1)[1] and columns.encode_image(b"", 0, 3)[1] == "bad dimensions"


def test_transparent_pixels_lose_their_colour():
    content, _ = columns.encode_image(bytes([9, 8, 7, 0, 1, 2, 3, 4]), 2, 1)
    assert columns.decode_image(content)[2] == bytes([0, 0, 0, 0, 1, 2, 3, 4])


def test_short_distances():
    near = lossless.near_distances()
    assert len(set(near)) == 120 and near[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)]
    assert lossless.plane_distance(100, 1) == 100 and lossless.plane_distance(100, 2) == 1 and lossless.plane_distance(100, 121) == 1
