"""Longest earlier match in a sliding window, found by searching what was put backwards."""

from __future__ import annotations


class Window:
    """The last `size` bytes put. Matches never run past what has been put."""

    def __init__(self, bits: int = 12) -> None:
        self.size, self.count = 1 << bits, 0
        self.held, self.first = bytearray(), 0  # the bytes from place `first` on

    def put(self, data: bytes) -> None:
        self.held += data
        self.count += len(data)
        if len(self.held) > 16 * self.size:
            cut = len(self.held) - self.size
            del self.held[:cut]
            self.first += cut

    def longest(self, data: bytes, offset: int = 0, most: int | None = None, near: int = 0, improvements: int = 1 << 12) -> tuple[int, int]:
        """(position, length) of the longest match of data[offset:], the newest of equals;
        (-1, 0) if none. near: how close to the end a match may not start. The search ends
        after so many improvements."""
        room = min(len(data) - offset, len(data) - offset if most is None else most)
        held, end, low = self.held, len(self.held), max(0, self.count - (self.size - near)) - self.first
        best, length, last = -1, 0, end - near  # matches start before last
        while length < room and improvements > 0:
            # the newest place that is better by one byte at least, then all that it has
            p = held.rfind(data[offset : offset + length + 1], max(0, low), min(end, last + length))
            if p < 0:
                break
            length += 1
            limit = min(room, end - p)
            while length < limit and held[p + length] == data[offset + length]:
                length += 1
            best, last, improvements = p, p, improvements - 1
        return (best + self.first if best >= 0 else -1), length
