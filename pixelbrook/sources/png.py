"""PNG in and out with the standard library: 8-bit grey, grey + alpha, RGB, RGBA and palette images without interlacing."""

from __future__ import annotations

import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


class BadPng(ValueError):
    pass


def _undone(raw: bytes, height: int, row: int, step: int) -> np.ndarray:
    """Rows without their filters."""
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.int64)
    for y in range(height):
        kind, line = raw[y * (row + 1)], np.frombuffer(raw, np.uint8, row, y * (row + 1) + 1).astype(np.int64)
        if kind == 1:
            line = line.reshape(-1, step).cumsum(0).ravel() & 255
        elif kind == 2:
            line = line + above & 255
        elif kind in (3, 4):
            for x in range(row):
                left, up, corner = (int(line[x - step]) if x >= step else 0), int(above[x]), (int(above[x - step]) if x >= step else 0)
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    far = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
                    guess = (left, up, corner)[far.index(min(far))]
                line[x] = int(line[x]) + guess & 255
        elif kind:
            raise BadPng("unknown filter")
        out[y], above = line, line
    return out


def read(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA bytes)."""
    if data[:8] != SIGNATURE:
        raise BadPng("not a PNG file")
    at, body, colours, opacity, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        payload = data[at + 8 : at + 8 + size]
        if len(payload) < size:
            raise BadPng("truncated")
        if kind == b"IHDR":
            head = (int.from_bytes(payload[:4], "big"), int.from_bytes(payload[4:8], "big"), *payload[8:13])
        elif kind == b"PLTE":
            colours = np.frombuffer(payload, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            opacity = payload
        elif kind == b"IDAT":
            body.append(payload)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise BadPng("no header")
    width, height, depth, colour, _, _, interlaced = head
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or n is None or not width or not height:
        raise BadPng("unsupported kind of PNG")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise BadPng(str(e)) from e
    if len(raw) < height * (width * n + 1):
        raise BadPng("truncated")
    px = _undone(raw, height, width * n, n).reshape(height, width, n)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        if colours is None or px.max() >= len(colours):
            raise BadPng("bad palette")
        alpha = np.full(len(colours), 255, np.uint8)
        alpha[: len(opacity)] = np.frombuffer(opacity[: len(colours)], np.uint8)
        out[..., :3], out[..., 3] = colours[px[..., 0]], alpha[px[..., 0]]
    else:
        out[..., :3] = px[..., :3] if n >= 3 else px[..., :1]
        if n in (2, 4):
            out[..., 3] = px[..., n - 1]
    return width, height, out.tobytes()


def write(width: int, height: int, rgba: bytes) -> bytes:
    rows = np.zeros((height, 1 + 4 * width), np.uint8)
    rows[:, 1:] = np.frombuffer(rgba, np.uint8).reshape(height, 4 * width)

    def chunk(kind: bytes, payload: bytes) -> bytes:
        return len(payload).to_bytes(4, "big") + kind + payload + zlib.crc32(kind + payload).to_bytes(4, "big")

    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 6, 0, 0, 0])
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
