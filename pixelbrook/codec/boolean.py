"""The arithmetic code of the lossy bitstream: one bit at a time with a chance of 1..255 in 256 of being 0."""

from __future__ import annotations

from .bits import Corrupt


class BoolReader:
    """Past the end the data goes on with zeros; ``check`` tells whether that happened to more than the last byte."""

    def __init__(self, data: bytes):
        self.data = data
        self.at = 2
        self.value = int.from_bytes(data[:2].ljust(2, b"\0"), "big")
        self.range, self.count = 255, 0

    def bit(self, chance: int) -> int:
        split = 1 + ((self.range - 1) * chance >> 8)
        if self.value >= split << 8:
            self.value -= split << 8
            self.range -= split
            out = 1
        else:
            self.range = split
            out = 0
        if self.range < 128:
            n = 8 - self.range.bit_length()
            self.range <<= n
            if self.count + n >= 8:
                k = 8 - self.count
                following = self.data[self.at] if self.at < len(self.data) else 0
                self.at += 1
                self.value = ((self.value << k) | following) << (n - k)
                self.count += n - 8
            else:
                self.value <<= n
                self.count += n
        return out

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit(128)
        return v

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return -v if self.bit(128) else v

    def optional(self, n: int, default: int = 0) -> int:
        """A flag, then n bits and a sign if it is set."""
        return self.signed(n) if self.bit(128) else default

    def check(self) -> None:
        if self.at > len(self.data) + 4:
            raise Corrupt("truncated")


class BoolWriter:
    def __init__(self):
        self.out = bytearray()
        self.range, self.bottom, self.left = 255, 0, 24

    def bit(self, value: int, chance: int) -> None:
        split = 1 + ((self.range - 1) * chance >> 8)
        if value:
            self.bottom += split
            self.range -= split
        else:
            self.range = split
        while self.range < 128:
            self.range <<= 1
            if self.bottom >> 31 & 1:
                self._carry()
            self.bottom = self.bottom << 1 & 0xFFFFFFFF
            self.left -= 1
            if not self.left:
                self.out.append(self.bottom >> 24)
                self.bottom &= 0xFFFFFF
                self.left = 8

    def _carry(self) -> None:
        k = len(self.out) - 1
        while k >= 0 and self.out[k] == 255:
            self.out[k] = 0
            k -= 1
        if k >= 0:
            self.out[k] += 1

    def bits(self, value: int, n: int) -> None:
        for k in reversed(range(n)):
            self.bit(value >> k & 1, 128)

    def getvalue(self) -> bytes:
        for _ in range(32):
            self.bit(0, 128)
        return bytes(self.out)
