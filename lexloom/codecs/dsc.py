"""The DSC codec: Huffman codes over 512 symbols; those from 256 on are copies of earlier bytes.

A blob is a header (magic, key, unpacked size, number of symbols, 0), 512 code lengths hidden
by the keystream, and the bit stream, most significant bit first. Codes are canonical: leaves
fill each level of the tree from the left, by length, then symbol.
"""

from __future__ import annotations

import heapq
import struct

from lexloom.codecs.keystream import masked
from lexloom.codecs.lz import Window
from lexloom.codecs.prefix import Bits, Decoder

#: Fixed values of the format.
MAGIC = b"DSC FORMAT 1.00\0"
KEY, LARGEST = 0x505D3, 0x3000000
SYMBOLS, OFFSET_BITS, SHORTEST, NEAREST = 512, 12, 2, 2
LONGEST, IMPROVEMENTS = 0xFF + SHORTEST, 30
_HEADER = struct.Struct("<16siiii")


def is_compressed(data: bytes) -> bool:
    return data[:16] == MAGIC


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code length of every symbol that occurs."""
    heap = [(n, -1, (s,)) for s, n in counts.items() if n]
    heap = [(n, s[0], s) for n, _, s in heap]
    heapq.heapify(heap)
    length = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], -1, a[2] + b[2]))
    return length


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits): leaves come before branches on each level."""
    out, code, bits = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - bits
        bits = n
        out[s] = (code, n)
        code += 1
    return out


def _symbols(data: bytes, level: int) -> list[tuple[int, int]]:
    """(symbol, offset) of the text: bytes, or copies if level is above 0."""
    if level <= 0:
        return [(b, 0) for b in data]
    window, out, n = Window(OFFSET_BITS), [], 0
    while n < len(data):
        place, length = window.longest(data, n, LONGEST, NEAREST + 1, IMPROVEMENTS)
        if length >= SHORTEST:
            out.append((0x100 | (length - SHORTEST), n - place - NEAREST))
        else:
            out.append((data[n], 0))
            length = 1
        window.put(data[n : n + length])
        n += length
    return out


def compress(data: bytes, level: int = 0, seed: int = 0) -> bytes:
    """level 0: Huffman only; 1 to 9, all alike: copies too."""
    if len(data) > LARGEST:
        raise ValueError(f"{len(data)} bytes are more than {LARGEST}")
    symbols = _symbols(data, level)
    counts: dict[int, int] = {}
    for s, _ in symbols:
        counts[s] = counts.get(s, 0) + 1
    if len(counts) == 1:  # a tree needs two leaves
        counts[1 if 0 in counts else 0] = 1
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    key = KEY + seed
    table = masked(bytes(lengths.get(s, 0) for s in range(SYMBOLS)), key, 1)
    bits, n, out = 0, 0, bytearray()
    for s, offset in symbols:
        code, size = codes[s]
        bits, n = bits << size | code, n + size
        if s & 0x100:
            bits, n = bits << OFFSET_BITS | offset, n + OFFSET_BITS
        if n >= 64:
            whole, n = n >> 3, n & 7
            out += (bits >> n).to_bytes(whole, "big")
            bits &= (1 << n) - 1
    tail = -n & 7
    out += (bits << tail).to_bytes((n + tail) >> 3, "big")
    return _HEADER.pack(MAGIC, key, len(data), len(symbols), 0) + table + bytes(out)


def decompress(data: bytes) -> bytes:
    if len(data) < _HEADER.size + SYMBOLS or not is_compressed(data):
        raise ValueError("not a DSC blob")
    _, key, size, _, _ = _HEADER.unpack_from(data)
    if not 0 <= size <= LARGEST:
        raise ValueError(f"unpacked size {size} is out of bounds")
    lengths = masked(data[_HEADER.size : _HEADER.size + SYMBOLS], key, -1)
    codes = Decoder(canonical(dict(enumerate(lengths))))
    src, out = Bits(data[_HEADER.size + SYMBOLS :]), bytearray()
    while len(out) < size:
        s = codes.next(src)
        if s < 0x100:
            out.append(s)
            continue
        start = len(out) - src.take(OFFSET_BITS) - NEAREST
        if start < 0:
            raise ValueError("a copy starts before the text")
        length, piece = (s & 0xFF) + SHORTEST, out[start : start + (s & 0xFF) + SHORTEST]
        while len(piece) < length:  # a copy may run into itself
            piece += piece
        out += piece[:length]
    return bytes(out[:size])


def decompress_if_required(data: bytes) -> bytes:
    return decompress(data) if is_compressed(data) else data


def compress_checked(data: bytes, level: int = 0, seed: int = 0) -> bytes:
    """compress, verified by decompressing; a negative level leaves the data as it is."""
    if level < 0:
        return data
    out = compress(data, level, seed)
    if decompress(out) != data:
        raise ValueError("compression does not round trip")
    return out
