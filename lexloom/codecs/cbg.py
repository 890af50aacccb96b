"""The CompressedBG image codec: keyed weights, Huffman, zero runs, and a delta filter."""

from __future__ import annotations

import heapq
import struct

import numpy as np

from lexloom.codecs.keystream import masked
from lexloom.codecs.prefix import Bits, Decoder

#: Fixed values of the format.
MAGIC = b"CompressedBG___\0"
_HEADER = struct.Struct("<16sHHi8xiiiBBh")
SMALLEST = _HEADER.size


def is_image(data: bytes) -> bool:
    return len(data) >= _HEADER.size and data[:16] == MAGIC


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        b = data[at]
        value, shift, at = value | (b & 0x7F) << shift, shift + 7, at + 1
        if b < 0x80:
            return value, at


def tree(weights: list[int]) -> tuple[dict[int, tuple[int, int]], int]:
    """Branches (id -> children) and root of the Huffman tree: the two lightest nodes merge,
    of equal ones the first made; leaves are 0 to 255. Root -1 without weights."""
    heap = [(w, n) for n, w in enumerate(weights) if w]
    if not heap:
        return {}, -1
    heapq.heapify(heap)
    branches, made = {}, len(weights)
    while True:
        w, a = heapq.heappop(heap)
        b = -1  # a single leaf is the first child of a root
        if heap:
            more, b = heapq.heappop(heap)
            w += more
        branches[made] = (a, b)
        if not heap:
            return branches, made
        heapq.heappush(heap, (w, made))
        made += 1


def _codes(branches: dict[int, tuple[int, int]], root: int) -> dict[int, tuple[int, int]]:
    """byte -> (code, bits)"""
    out, walk = {}, [(root, 0, 0)] if root >= 0 else []
    while walk:
        node, code, n = walk.pop()
        if node > 0xFF:
            walk += [(child, code << 1 | i, n + 1) for i, child in enumerate(branches[node]) if child >= 0]
        else:
            out[node] = (code, n)
    return out


def _unhuffman(src: bytes, size: int, branches: dict[int, tuple[int, int]], root: int) -> bytes:
    codes, bits = Decoder(_codes(branches, root)), Bits(src)
    return bytes(codes.next(bits) for _ in range(size))


def _expand_zeros(src: bytes) -> bytes:
    out, at, zeros = [], 0, False
    while at < len(src):
        n, at = _read_varint(src, at)
        out.append(bytes(n) if zeros else src[at : at + n])
        at += 0 if zeros else n
        zeros = not zeros
    return b"".join(out)


def _zeros(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        copy = at
        while copy < len(data) and data[copy]:
            copy += 1
        end = copy
        while end < len(data) and not data[end]:
            end += 1
        out += [_varint(copy - at), data[at:copy], _varint(end - copy)]
        at = end
    return b"".join(out)


def load(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """(width, height, bits per pixel, height x width x channels array in file order: BGR(A))."""
    if not is_image(data):
        raise ValueError("not a CompressedBG image")
    _, w, h, bpp, unpacked, key, keyed, total, parity, _ = _HEADER.unpack_from(data)
    if bpp not in (24, 32):
        raise ValueError(f"{bpp} bits per pixel")
    table = masked(data[_HEADER.size : _HEADER.size + keyed], key, -1)
    if (sum(table) & 0xFF, int(np.bitwise_xor.reduce(np.frombuffer(table, np.uint8), initial=0))) != (total, parity):
        raise ValueError("the weights do not have their checksums")
    weights, at = [], 0
    for _ in range(256):
        n, at = _read_varint(table, at)
        weights.append(n)
    branches, root = tree(weights)
    packed = _unhuffman(data[_HEADER.size + keyed :], unpacked if root >= 0 else 0, branches, root)
    deltas = np.frombuffer(_expand_zeros(packed)[: w * h * bpp // 8], np.uint8).reshape(h, w, bpp // 8).astype(np.int64)
    return w, h, bpp, _unfilter(deltas).astype(np.uint8)


def _unfilter(deltas: np.ndarray) -> np.ndarray:
    """Pixels are deltas to the mean of the left and the upper one (to the one there is, at an
    edge). Both are on the diagonal before, so diagonals are made one by one."""
    h, w, channels = deltas.shape
    if not w or not h:
        return deltas
    out, before = np.zeros_like(deltas), np.zeros((h + 1, channels), np.int64)  # before: by row, after one empty row
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up = before[y + 1], before[y]
        guess = np.where((y == 0)[:, None], left, np.where((x == 0)[:, None], up, (left + up) // 2))
        out[y, x] = guess + deltas[y, x] & 0xFF
        before[y + 1] = out[y, x]
    return out


def save(pixels: np.ndarray, key: int = 0x1234) -> bytes:
    """Encode a height x width x (3 or 4) array: load's inverse."""
    h, w, channels = pixels.shape
    p = pixels.astype(np.int64)
    deltas = p.copy()
    if w and h:
        deltas[0, 1:] = p[0, 1:] - p[0, :-1]
        deltas[1:, 0] = p[1:, 0] - p[:-1, 0]
        deltas[1:, 1:] = p[1:, 1:] - (p[1:, :-1] + p[:-1, 1:]) // 2
    packed = _zeros((deltas & 0xFF).astype(np.uint8).tobytes())
    weights = np.bincount(np.frombuffer(packed, np.uint8), minlength=256).tolist()
    branches, root = tree(weights)
    codes = {b: f"{code:0{n}b}" for b, (code, n) in _codes(branches, root).items()}
    bits = "".join(codes[b] for b in packed)
    stream = np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes() if bits else b""
    table = b"".join(map(_varint, weights))
    parity = int(np.bitwise_xor.reduce(np.frombuffer(table, np.uint8), initial=0))
    return _HEADER.pack(MAGIC, w, h, channels * 8, len(packed), key, len(table), sum(table) & 0xFF, parity, 0) + masked(table, key, 1) + stream
