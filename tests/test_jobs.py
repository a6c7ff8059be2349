"""The jobs, and PNG in and out."""

import zlib

import numpy as np
import pytest

from pixelbrook.__main__ import main
from pixelbrook.sources import png


def encoded(width, height, colour, filters, data, extra=b""):
    """A PNG with a chosen filter for each row, written from the definition."""
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    rows = np.frombuffer(data, np.uint8).reshape(height, width * n).astype(int)
    out = bytearray()
    for y, kind in enumerate(filters):
        up = rows[y - 1] if y else np.zeros(width * n, int)
        left, corner = np.concatenate((np.zeros(n, int), rows[y][:-n])), np.concatenate((np.zeros(n, int), up[:-n]))
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        guess = [0 * up, left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))][kind]
        out += bytes([kind]) + ((rows[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, v: len(v).to_bytes(4, "big") + k + v + zlib.crc32(k + v).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, colour, 0, 0, 0])
    return png.SIGNATURE + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(bytes(out))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,n", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters(colour, n):
    data = np.random.default_rng(colour).integers(0, 256, (6, 5, n)).astype(np.uint8)
    width, height, out = png.read(encoded(5, 6, colour, [0, 1, 2, 3, 4, 4], data.tobytes()))
    px = np.frombuffer(out, np.uint8).reshape(height, width, 4)
    assert (px[..., 0] == data[..., 0]).all() and (px[..., 3] == (data[..., n - 1] if n in (2, 4) else 255)).all()


def test_png_round_trip_and_errors():
    data = np.random.default_rng(1).integers(0, 256, 7 * 4 * 3).astype(np.uint8).tobytes()
    assert png.read(png.write(7, 3, data)) == (7, 3, data)
    for bad in (b"", b"junk", png.SIGNATURE, png.write(7, 3, data)[:60]):
        with pytest.raises(png.BadPng):
            png.read(bad)


def test_jobs(spark, tmp_path, capsys):
    a, b, c = (tmp_path / n for n in "abc")
    a.mkdir()
    opaque = np.random.default_rng(2).integers(0, 256, (8, 8, 4)).astype(np.uint8)
    opaque[..., 3] = 255
    (a / "x.png").write_bytes(png.write(8, 8, opaque.tobytes()))
    (a / "bad.png").write_bytes(b"junk")
    assert main(["enc", str(a), str(b)], spark) == 1 and "not a PNG" in capsys.readouterr().err
    assert main(["info", str(b)], spark) == 0 and "lossless, 8 x 8" in capsys.readouterr().out
    assert main(["dec", str(b), str(c)], spark) == 0
    assert png.read((c / "x.png").read_bytes()) == (8, 8, opaque.tobytes())
