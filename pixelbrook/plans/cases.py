"""Hand-built files, one for each edge of the two ways to walk a file."""

from __future__ import annotations


def le(n: int, size: int) -> bytes:
    return n.to_bytes(size, "little")


def chunk(kind: str, payload: bytes, pad: bool = True) -> bytes:
    return kind.encode() + le(len(payload), 4) + payload + b"\0" * (len(payload) & 1 if pad else 0)


def riff(*chunks: bytes) -> bytes:
    body = b"".join(chunks)
    return b"RIFF" + le(len(body) + 4, 4) + b"WEBP" + body


def lossless(w: int, h: int, alpha: int = 0, version: int = 0) -> bytes:
    return b"\x2f" + le(w - 1 | h - 1 << 14 | alpha << 28 | version << 29, 4)


def lossy(w: int, h: int, tag: int = 0x10) -> bytes:
    return le(tag, 3) + b"\x9d\x01\x2a" + le(w, 2) + le(h, 2)


def header(flags: int, w: int = 10, h: int = 20, more: bytes = b"") -> bytes:
    return chunk("VP8X", le(flags, 4) + le(w - 1, 3) + le(h - 1, 3) + more)


def frame(w: int, h: int, *chunks: bytes) -> bytes:
    return chunk("ANMF", le(1, 3) + le(2, 3) + le(w - 1, 3) + le(h - 1, 3) + le(40, 3) + b"\3" + b"".join(chunks))


ANIM = chunk("ANIM", le(0xFF112233, 4) + le(3, 2))
_IMAGE = chunk("VP8L", lossless(3, 5))

CASES = {
    "lossy": riff(chunk("VP8 ", lossy(16, 8))),
    "lossy_no_key_frame": riff(chunk("VP8 ", lossy(16, 8, 0x11))),
    "lossy_no_width": riff(chunk("VP8 ", lossy(0, 8))),
    "lossless_alpha": riff(chunk("VP8L", lossless(3, 5, 1))),
    "lossless_version": riff(chunk("VP8L", lossless(3, 5, 0, 1))),
    "lossless_short": riff(chunk("VP8L", lossless(3, 5)[:3])),
    "lossless_no_pad": riff(chunk("VP8L", lossless(3, 5), pad=False)),
    "chunk_cut": riff(chunk("VP8L", lossless(3, 5)))[:-4],
    "chunk_unknown": riff(chunk("ABCD", b"12345678"), _IMAGE),
    "still_alpha": riff(header(16), chunk("ALPH", b"\0123"), chunk("VP8 ", lossy(16, 8))),
    "still_alpha_lossless": riff(header(16), chunk("ALPH", b"\0123"), _IMAGE),
    "still_alpha_only": riff(header(16), chunk("ALPH", b"\0123")),
    "still_alpha_apart": riff(header(16), chunk("ALPH", b"\0123"), chunk("ABCD", b""), chunk("VP8 ", lossy(16, 8))),
    "still_nothing": riff(header(0)),
    "still_bad_image": riff(header(0), chunk("VP8L", b"12345")),
    "header_flags": riff(header(128), _IMAGE),
    "header_reserved": riff(header(1 << 8), _IMAGE),
    "header_long": riff(header(0, more=b"12"), _IMAGE),
    "header_twice": riff(header(0), header(0), _IMAGE),
    "canvas_area": riff(header(0, 1 << 15, 1 << 15), _IMAGE),
    "frames": riff(header(2), ANIM, frame(3, 5, _IMAGE), frame(3, 5, chunk("VP8L", lossless(3, 5, 1)))),
    "frames_short_anim": riff(header(2), chunk("ANIM", b"1234"), frame(3, 5, _IMAGE)),
    "frames_no_anim": riff(header(2), frame(3, 5, _IMAGE)),
    "frames_no_flag": riff(header(0), ANIM, frame(3, 5, _IMAGE), _IMAGE),
    "frames_image_outside": riff(header(2), ANIM, frame(3, 5, _IMAGE), _IMAGE),
    "frame_short": riff(header(2), ANIM, chunk("ANMF", b"1234"), frame(3, 5, _IMAGE)),
    "frame_empty": riff(header(2), ANIM, frame(3, 5), frame(3, 5, _IMAGE)),
    "frame_alpha_only": riff(header(2), ANIM, frame(3, 5, chunk("ALPH", b"\0")), frame(3, 5, _IMAGE)),
    "frame_bad_image": riff(header(2), ANIM, frame(3, 5, chunk("VP8L", b"12345")), frame(3, 5, _IMAGE)),
    "frame_two_images": riff(header(2), ANIM, frame(3, 5, chunk("VP8L", lossless(3, 5, 1)), _IMAGE)),
    "frame_other_size": riff(header(2), ANIM, frame(4, 4, _IMAGE)),
    "frame_area": riff(header(2), ANIM, frame(1 << 15, 1 << 15, _IMAGE)),
    "frame_cut_chunk": riff(header(2), ANIM, frame(3, 5, chunk("VP8L", lossless(3, 5))[:-3]), frame(3, 5, _IMAGE)),
}
