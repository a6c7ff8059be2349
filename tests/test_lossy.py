"""The lossy bitstream with tables of our own: what is written can be read, and is near the original."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelbrook.codec import boolean, columns, lossy
from pixelbrook.codec.bits import Corrupt

RNG = np.random.default_rng(1)
TABLES = lossy.Tables(RNG.integers(1, 256, (4, 8, 3, 11)).tolist(), RNG.integers(200, 256, (4, 8, 3, 11)).tolist(), RNG.integers(1, 256, (10, 10, 9)).tolist())


def gradient(w, h):
    y, x = np.mgrid[:h, :w]
    return np.stack([x * 255 // w, y * 255 // h, (x + y) * 255 // (w + h), np.full((h, w), 255)], -1).astype(np.uint8)


def psnr(a, b):
    mse = ((a.astype(float) - b.astype(float)) ** 2).mean()
    return 99 if mse == 0 else 10 * np.log10(65025 / mse)


@given(st.lists(st.tuples(st.booleans(), st.integers(1, 255)), max_size=400))
@settings(max_examples=60, deadline=None)
def test_boolean_code(pairs):
    w = boolean.BoolWriter()
    for bit, chance in pairs:
        w.bit(int(bit), chance)
    r = boolean.BoolReader(w.getvalue())
    assert [r.bit(chance) for _, chance in pairs] == [int(bit) for bit, _ in pairs]


@pytest.mark.parametrize("size", [(16, 16), (33, 20), (64, 48), (5, 3), (1, 1)])
@pytest.mark.parametrize("q,least", [(0, 40), (30, 32), (127, 20)])
@pytest.mark.parametrize("filtered", [(0, 0, False), (20, 3, False), (12, 0, True)])
def test_planes(size, q, least, filtered):
    planes = lossy.to_planes(gradient(*size)[..., :3])
    level, sharpness, simple = filtered
    w, h, *back = lossy.decode(lossy.encode(*planes, q, TABLES, level, sharpness, simple), TABLES)
    assert (w, h) == size and all(a.shape == b.shape for a, b in zip(planes, back))
    assert psnr(planes[0], back[0]) >= (least if not level else least - 12)


def test_transforms():
    for _ in range(50):
        d = RNG.integers(-255, 256, (4, 4))
        assert np.abs(lossy.inverse_dct(lossy.forward_dct(d).ravel().tolist()) - d).max() <= 1
        z = RNG.integers(-500, 500, 16)
        assert np.abs(np.array(lossy.inverse_wht(lossy.forward_wht(z).tolist())) - z).max() <= 2


def test_block_modes():
    top, left = np.arange(10, 90, 10).astype(np.uint8), np.array([15, 25, 35, 45], np.uint8)
    block = lambda m: lossy.predicted_block(top, left, 5, m)
    assert (block(lossy.B_DC) == (100 + 120 + 4) >> 3).all() and block(lossy.B_TM)[1, 2] == 25 + 30 - 5
    assert block(lossy.B_VE)[:, 0].tolist() == [(5 + 20 + 20 + 2) >> 2] * 4 and block(lossy.B_HE)[3].tolist() == [(35 + 90 + 45 + 2) >> 2] * 4
    flat = lossy.predicted_block(np.full(8, 77, np.uint8), np.full(4, 77, np.uint8), 77, lossy.B_DC)
    for m in range(10):
        assert (lossy.predicted_block(np.full(8, 77, np.uint8), np.full(4, 77, np.uint8), 77, m) == flat).all()
    down_left = block(lossy.B_LD)
    assert all(down_left[r, c] == down_left[r + 1, c - 1] for r in range(3) for c in range(1, 4))
    down_right = block(lossy.B_RD)
    assert all(down_right[r, c] == down_right[r + 1, c + 1] for r in range(3) for c in range(3))


def test_corrupt_and_random_streams():
    planes = lossy.to_planes(gradient(40, 24)[..., :3])
    good = lossy.encode(*planes, 30, TABLES, 20)
    for k in range(60):
        bad = bytearray(good)
        for at in RNG.integers(10, len(bad), 3):
            bad[at] = RNG.integers(0, 256)
        try:
            lossy.decode(bytes(bad[: len(bad) - k]), TABLES)
        except Corrupt:
            pass
    # any bits are some frame: all modes of blocks are met
    head = (1 << 4 | 400 << 5).to_bytes(3, "little") + b"\x9d\x01\x2a" + (48).to_bytes(2, "little") * 2
    for _ in range(10):
        try:
            w, h, y, _, _ = lossy.decode(head + RNG.integers(0, 256, 3000).astype(np.uint8).tobytes(), TABLES)
            assert y.shape == (h, w)
        except Corrupt:
            pass


def test_tables(spark, tmp_path):
    import json
    from dataclasses import asdict

    (tmp_path / "t.json").write_text(json.dumps(asdict(TABLES)))
    tables = lossy.Tables.read(str(tmp_path / "t.json"))
    clear = gradient(24, 18)
    clear[2:5, 3:9, 3] = 40
    df = spark.createDataFrame([(1, gradient(24, 18).tobytes(), 24, 18), (2, clear.tobytes(), 24, 18), (3, None, 1, 1)], "k int, data binary, width int, height int")
    files = columns.encoded(df, "k", 90.0, tables).persist()
    back = {r.k: r for r in columns.decoded(files, "k", tables).collect()}
    for k, px in ((1, gradient(24, 18)), (2, clear)):
        got = np.frombuffer(back[k].data, np.uint8).reshape(18, 24, 4)
        assert (got[..., 3] == px[..., 3]).all() and psnr(got[..., :3], px[..., :3]) > 25
    assert back[3].error and {r.error for r in columns.decoded(files.where("k = 1"), "k").collect()} == {"lossy images need probability tables"}
