"""Prefix codes read by table: several bits of the stream at a time."""

from __future__ import annotations


class Bits:
    """A stream of bits, most significant first."""

    def __init__(self, src: bytes) -> None:
        self.src, self.at = src, 0
        self.bits, self.held = 0, 0  # the low `held` bits of `bits` are still to be read
        self.left = 8 * len(src)  # bits of the stream not yet read; below 0 it was too short

    def fill(self) -> None:
        """Hold 48 bits or more, zeros past the stream's end."""
        more = self.src[self.at : self.at + 8]
        self.at += 8
        self.bits = (self.bits & ((1 << self.held) - 1)) << 64 | int.from_bytes(more.ljust(8, b"\0"), "big")
        self.held += 64

    def take(self, n: int) -> int:
        """The next n bits, at most 48."""
        if self.held < n:
            self.fill()
        self.held -= n
        self.left -= n
        if self.left < 0:
            raise ValueError("the bit stream ends early")
        return self.bits >> self.held & ((1 << n) - 1)


class Decoder:
    """Codes (symbol -> (code, bits), no code starting with another) as a table over `width` bits;
    what is longer is looked up bit by bit."""

    def __init__(self, codes: dict[int, tuple[int, int]], width: int = 11) -> None:
        self.longest = max((n for _, n in codes.values()), default=0)
        self.width = max(1, min(width, self.longest))
        self.table: list[tuple[int, int] | None] = [None] * (1 << self.width)
        self.long: dict[tuple[int, int], int] = {}
        for symbol, (code, n) in codes.items():
            if n <= self.width:
                room = 1 << (self.width - n)
                self.table[code * room : (code + 1) * room] = [(symbol, n)] * room
            else:
                self.long[n, code] = symbol

    def next(self, src: Bits) -> int:
        if src.held < self.width:
            src.fill()
        found = self.table[src.bits >> (src.held - self.width) & ((1 << self.width) - 1)]
        if found:
            symbol, n = found
            src.held -= n
            src.left -= n
            if src.left < 0:
                raise ValueError("the bit stream ends early")
            return symbol
        code = src.take(self.width)
        for n in range(self.width + 1, self.longest + 1):
            code = code << 1 | src.take(1)
            if (n, code) in self.long:
                return self.long[n, code]
        raise ValueError("no such code")
