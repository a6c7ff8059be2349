"""Walking a file's chunks and frames, strictly or leniently. Bad input gives an error beside what was read, never an
exception."""

from __future__ import annotations

from dataclasses import dataclass, field

MAX_INPUT, MAX_CHUNK, MAX_FRAMES = 256 << 20, (1 << 32) - 10, 10_000
#: Pixels of a canvas or frame are fewer; most bytes of metadata or an unknown chunk; most chunks kept besides images.
MAX_AREA, MAX_METADATA, MAX_KEPT = 1 << 30, 100 << 20, 1000
ANIMATION, XMP, EXIF, ALPHA, ICC = 2, 4, 8, 16, 32


def le(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "little")


@dataclass
class Frame:
    x: int = 0
    y: int = 0
    w: int = 0
    h: int = 0
    duration_ms: int = 0
    dispose: int = 0
    no_blend: int = 0
    has_alpha: bool = False
    lossless: bool = False
    data: bytes = b""
    alpha_data: bytes | None = None


@dataclass
class File:
    chunks: list[tuple[int, str, int, int, bytes]] = field(default_factory=list)  # idx, fourcc, offset, size, payload
    frames: list[Frame] = field(default_factory=list)
    width: int = 0
    height: int = 0
    has_alpha: bool = False
    animated: bool = False
    format: str = "unknown"
    loop: int = 0
    background: int = 0
    metadata: dict[str, bytes] = field(default_factory=dict)
    error: str | None = None


class Bad(ValueError):
    pass


def lossy_size(p: bytes, strict: bool = True) -> tuple[int, int]:
    if len(p) < 10:
        raise Bad("truncated")
    if strict and p[0] & 1:
        raise Bad("not a key frame")
    if p[3:6] != b"\x9d\x01\x2a":
        raise Bad("bad signature")
    return le(p, 6, 2) & 0x3FFF, le(p, 8, 2) & 0x3FFF


def lossless_size(p: bytes, strict: bool = True) -> tuple[int, int, bool]:
    if len(p) < 5:
        raise Bad("truncated")
    word = le(p, 1, 4)
    if p[0] != 0x2F:
        raise Bad("bad signature")
    if strict and word >> 29:
        raise Bad("bad version")
    return (word & 0x3FFF) + 1, (word >> 14 & 0x3FFF) + 1, bool(word >> 28 & 1)


def alpha_bit(p: bytes) -> bool:
    """Whether a bitstream is a lossless one with alpha."""
    return len(p) >= 5 and p[0] == 0x2F and bool(le(p, 1, 4) >> 28 & 1)


def walk(data: bytes, begin: int, end: int, strict: bool):
    """(fourcc, offset, payload) of each chunk; one that is cut short (its pad byte too, strictly) is an error, or ends a
    lenient walk."""
    at = begin
    while at + 8 <= end:
        size = le(data, at + 4, 4)
        if size > MAX_CHUNK or at + 8 + size + (size & 1 if strict else 0) > end:
            if strict:
                raise Bad("truncated chunk")
            return
        yield data[at : at + 4].decode("latin-1"), at, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def _sized(frame: Frame, kind: str, payload: bytes, strict: bool) -> None:
    """Take an image and the size that its header tells."""
    frame.data, frame.lossless = payload, kind == "VP8L"
    if kind == "VP8L":
        frame.w, frame.h, frame.has_alpha = lossless_size(payload, strict)
    else:
        frame.w, frame.h = lossy_size(payload, strict)
        frame.has_alpha = frame.alpha_data is not None
    if strict and not (frame.w and frame.h):
        raise Bad("zero size")


def _frame(payload: bytes, strict: bool) -> Frame:
    """An animation frame. Strictly, its image follows its alpha at once; leniently, the last of each counts, unread. Either way
    a frame may have no image."""
    if len(payload) < 16:
        raise Bad("truncated frame")
    bits = payload[15]
    frame = Frame(2 * le(payload, 0, 3), 2 * le(payload, 3, 3), le(payload, 6, 3) + 1, le(payload, 9, 3) + 1, le(payload, 12, 3), bits & 1, bits >> 1 & 1)
    if frame.w * frame.h >= MAX_AREA:
        raise Bad("frame too large")
    for kind, _, p in walk(payload, 16, len(payload), strict):
        if kind == "ALPH":
            frame.alpha_data, frame.has_alpha = p, True
            continue
        if kind in ("VP8 ", "VP8L"):
            frame.data, frame.lossless = p, kind == "VP8L"
            if strict and frame.lossless:
                if frame.alpha_data is not None:
                    raise Bad("alpha beside a lossless image")
                frame.has_alpha = lossless_size(p)[2]
        if strict:
            break
    if strict and frame.alpha_data is not None and not frame.data:
        raise Bad("alpha without image")
    if not strict:
        frame.has_alpha = bool(frame.alpha_data) or alpha_bit(frame.data)
    return frame


def parse(data: bytes | None, mode: str = "strict", max_frames: int | None = None) -> File:
    """``max_frames``: stop after so many, as a first-frame query wants."""
    out, strict = File(), mode == "strict"
    try:
        _parse(data or b"", out, strict, max_frames)
    except Bad as e:
        out.error = str(e)
    return out


def _parse(data: bytes, out: File, strict: bool, most: int | None) -> None:
    if len(data) > MAX_INPUT:
        raise Bad("file too large")
    if len(data) < 12:
        raise Bad("truncated")
    size = le(data, 4, 4)
    if data[:4] != b"RIFF" or strict and size < 8:
        raise Bad("not a RIFF file")
    if strict and size > MAX_CHUNK:
        raise Bad("file too large")
    if data[8:12] != b"WEBP":
        raise Bad("unknown form type")
    end = min(len(data), 8 + size)
    if end < 20:
        raise Bad("truncated" if strict else "no image")
    first = data[12:16].decode("latin-1")
    out.format = {"VP8 ": "lossy", "VP8L": "lossless", "VP8X": "extended"}.get(first, "unknown")
    if out.format == "unknown":
        raise Bad("unknown chunk")
    chunks = _kept(walk(data, 12, end, strict), out)
    kind, payload = next(chunks, (None, b""))
    if kind is None:
        raise Bad("truncated chunk")
    if kind != "VP8X":
        frame = Frame()
        _sized(frame, kind, payload, strict)
        out.frames.append(frame)
        out.width, out.height, out.has_alpha = frame.w, frame.h, frame.has_alpha
        return
    if len(payload) < 10 or strict and len(payload) != 10:
        raise Bad("bad extended header")
    flags = payload[0]
    if strict and flags & ~(ANIMATION | XMP | EXIF | ALPHA | ICC):
        raise Bad("unknown flags")
    out.width, out.height = le(payload, 4, 3) + 1, le(payload, 7, 3) + 1
    if strict and out.width * out.height >= MAX_AREA:
        raise Bad("canvas too large")
    out.animated, out.has_alpha = bool(flags & ANIMATION), bool(flags & ALPHA)
    if strict:
        out.loop, out.background = 1, 0xFFFFFFFF
        _strict(chunks, out, flags, most)
    else:
        _lenient(chunks, out, most)


def _kept(chunks, out: File):
    for idx, (kind, at, p) in enumerate(chunks):
        out.chunks.append((idx, kind, at, len(p), p))
        yield kind, p


def _strict(chunks, out: File, flags: int, most: int | None) -> None:
    seen_anim, kept = False, 0
    for kind, p in chunks:
        if kind == "VP8X":
            raise Bad("second extended header")
        if kind == "ANIM":
            _animation(p, out)
            seen_anim = True
        elif kind == "ANMF":
            if not seen_anim:
                raise Bad("frame before animation chunk")
            if not _framed(p, out, True, most):
                return
        elif kind in ("ALPH", "VP8 ", "VP8L"):
            if seen_anim or out.animated:
                raise Bad("image chunk in an animation")
            _only_image(kind, p, chunks, out)
            return  # what follows a still image isn't looked at
        else:
            bit = {"ICCP": ICC, "EXIF": EXIF, "XMP ": XMP}.get(kind)
            if bit is None and kept >= MAX_KEPT:
                raise Bad("too many chunks")
            if bit is None or flags & bit:
                if len(p) > MAX_METADATA:
                    raise Bad("chunk too large")
                kept += 1
                if bit:
                    out.metadata.setdefault(kind, p)


def _only_image(kind: str | None, p: bytes, chunks, out: File) -> None:
    """Of an extended still file: alpha, and the image right behind it."""
    frame = Frame()
    while kind == "ALPH":
        frame.alpha_data, out.has_alpha = p, True
        kind, p = next(chunks, (None, b""))
    if kind not in ("VP8 ", "VP8L"):
        raise Bad("alpha without image")
    if kind == "VP8L" and frame.alpha_data is not None:
        raise Bad("alpha beside a lossless image")
    _sized(frame, kind, p, True)
    out.frames.append(frame)
    out.width, out.height, out.has_alpha = frame.w, frame.h, out.has_alpha or frame.has_alpha


def _lenient(chunks, out: File, most: int | None) -> None:
    still: Frame | None = None  # that of a still file, which takes the first image from its first alpha or image chunk on
    for kind, p in chunks:
        if kind in ("ICCP", "EXIF", "XMP "):
            if len(p) > MAX_METADATA:
                raise Bad("chunk too large")
            out.metadata[kind] = p  # the last one counts
        elif kind == "ANIM":
            _animation(p, out)
        elif kind == "ANMF":
            if not _framed(p, out, False, most):
                return
        elif kind in ("ALPH", "VP8 ", "VP8L") and not out.animated and not out.frames:
            still = still or Frame(w=out.width, h=out.height)
            if kind == "ALPH":
                still.alpha_data = p
            else:
                still.data, still.lossless = p, kind == "VP8L"
                still.has_alpha = bool(still.alpha_data) or alpha_bit(p)
                out.frames.append(still)
    if not out.frames:
        raise Bad("no image")


def _animation(p: bytes, out: File) -> None:
    if len(p) < 6:
        raise Bad("bad animation chunk")
    out.background, out.loop = le(p, 0, 4), le(p, 4, 2)


def _framed(p: bytes, out: File, strict: bool, most: int | None) -> bool:
    """Add a frame; False if there are as many as wanted."""
    if most is not None and len(out.frames) >= most:
        return False
    if len(out.frames) >= MAX_FRAMES:
        raise Bad("too many frames")
    out.frames.append(_frame(p, strict))
    return True


def metadata(f: File, fourcc: str) -> bytes | None:
    """The payload of a chunk: of metadata as the walk keeps it, of others the first."""
    if fourcc in ("ICCP", "EXIF", "XMP "):
        return f.metadata.get(fourcc)
    return next((p for _, kind, _, _, p in f.chunks if kind == fourcc), None)
