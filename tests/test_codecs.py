from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest

from lexloom.codecs import cbg, dsc, images, lz, prefix
from lexloom.codecs.keystream import keystream, masked


@pytest.mark.parametrize("level", [0, 1, 9])
@pytest.mark.parametrize("data", [bytes([1, 2, 3, 4, 5, 6] + [1] * 11), b"\1" * 3, b"\1" * 4, b"\1" * 5, b"\1" * 15, b"\1", b"", b"\0", b"\0" * 700, bytes(range(256)) * 3, b"abcabcabcd" * 900])
def test_dsc_round_trip(data, level):
    assert dsc.decompress(dsc.compress_checked(data, level)) == data


def test_dsc_random_and_levels():
    rnd = random.Random(1)
    for n in (10, 500, 5000):
        data = bytes(rnd.choice(b"abcdef  ") for _ in range(n))
        assert dsc.decompress(dsc.compress(data, 9, seed=77)) == data
        assert dsc.compress(data, 1) == dsc.compress(data, 9)
    assert len(dsc.compress(b"hello world " * 500, 9)) < len(dsc.compress(b"hello world " * 500, 0))


def test_dsc_rejects():
    good = dsc.compress(b"some text")
    assert dsc.decompress_if_required(b"plain") == b"plain" and dsc.compress_checked(b"x", -1) == b"x"
    for bad in (b"plain", good[:-1], good[:20] + struct.pack("<i", dsc.LARGEST + 1) + good[24:]):
        with pytest.raises(ValueError):
            dsc.decompress(bad)


def test_dsc_codes_fill_levels_from_the_left():
    assert dsc.canonical({5: 1, 2: 2, 9: 2}) == {5: (0, 1), 2: (2, 2), 9: (3, 2)}


def test_lz():
    w = lz.Window()
    w.put(bytes([4, 4, 4, 4, 4, 1, 2, 3, 4, 5, 6, 7, 1, 1, 1, 2, 3, 4]))
    seek = bytes([1, 2, 3, 4, 5, 6, 7])
    assert (w.longest(seek), w.longest(seek, 1), w.longest(seek, 1, 4), w.longest(bytes([8] * 4))) == ((5, 7), (6, 6), (6, 4), (-1, 0))
    w.put(bytes(0x4000) + bytes([1, 2, 3]))
    assert (w.longest(seek), w.longest(bytes([8] * 4))) == ((18 + 0x4000, 3), (-1, 0))


def test_lz_matches_do_not_run_past_the_end():
    base = bytes([1, 2, 3, 4, 5, 6] + [1] * 11)
    w = lz.Window()
    w.put(base[:6])
    assert w.longest(base, 6) == (0, 1)
    w = lz.Window()
    base = bytes([1, 0, 2, 2, 2, 0, 0, 0, 0])
    w.put(base[:2])
    assert w.longest(base, 5) == (1, 1)


def _search(data: bytes, seek: bytes, near: int, most: int, improvements: int) -> tuple[int, int]:
    """Plain search, newest place first."""
    best, length, n = -1, 0, len(data)
    for p in range(n - near - 1, max(0, n - (4096 - near)) - 1, -1):
        if improvements <= 0:
            break
        m = 0
        while m < min(len(seek), most, n - p) and data[p + m] == seek[m]:
            m += 1
        if m > length:
            best, length, improvements = p, m, improvements - 1
    return best, length


@pytest.mark.parametrize(("near", "most", "improvements"), [(0, 99, 4096), (3, 7, 30), (3, 257, 2)])
def test_lz_against_a_plain_search(near, most, improvements):
    rnd = random.Random(near + most)
    w, put = lz.Window(), b""
    for _ in range(150):
        part = bytes(rnd.choice(b"aab") for _ in range(rnd.randint(1, 900)))
        w.put(part)
        put += part
        seek = bytes(rnd.choice(b"aab") for _ in range(rnd.randint(1, 12))) if rnd.random() < 0.5 else put[-rnd.randint(1, 4000) :][:12]
        assert w.longest(seek, 0, most, near, improvements) == _search(put, seek, near, most, improvements)


def test_prefix_codes_longer_than_the_table():
    codes = {n: ((1 << (n + 1)) - 2, n + 1) for n in range(30)} | {30: ((1 << 30) - 1, 30)}
    rnd = random.Random(1)
    said = [rnd.randrange(31) for _ in range(500)]
    bits = "".join(f"{codes[x][0]:0{codes[x][1]}b}" for x in said)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    decoder, src = prefix.Decoder(codes), prefix.Bits(data)
    assert [decoder.next(src) for _ in said] == said
    with pytest.raises(ValueError, match="early"):
        for _ in range(20):
            decoder.next(src)
    with pytest.raises(ValueError, match="no such code"):
        prefix.Decoder({1: (0, 1), 2: (2, 2)}).next(prefix.Bits(b"\xff"))


def test_keystream():
    values = keystream(0)
    # state 0 -> 0, then state 1 -> 346, by the recurrence
    assert [next(values), next(values)] == [0, 346]
    assert masked(masked(b"some bytes", 99, 1), 99, -1) == b"some bytes"


@pytest.mark.parametrize("shape", [(1, 1, 3), (5, 7, 4), (16, 9, 3), (1, 20, 4), (20, 1, 3)])
def test_cbg_round_trip(shape):
    px = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    w, h, bpp, back = cbg.load(cbg.save(px))
    assert (h, w, bpp // 8) == shape and (back == px).all()
    flat = np.zeros(shape, np.uint8)
    assert (cbg.load(cbg.save(flat))[3] == flat).all()


def test_cbg_rejects_damage():
    data = bytearray(cbg.save(np.full((4, 4, 3), 9, np.uint8)))
    data[0x30] ^= 1
    with pytest.raises(ValueError, match="checksums"):
        cbg.load(bytes(data))


def test_cbg_tree_takes_the_first_of_equals():
    branches, root = cbg.tree([1, 1, 1, 1] + [0] * 252)
    assert branches == {256: (0, 1), 257: (2, 3), 258: (256, 257)} and root == 258
    assert cbg.tree([0] * 256) == ({}, -1) and cbg.tree([0, 5] + [0] * 254) == ({256: (1, -1)}, 256)


def test_images():
    px = np.random.default_rng(1).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    raw = images.save_raw(px)
    assert images.kind(raw) == "RAWIMG" and images.kind(dsc.compress(raw)) == "DSC" and images.kind(b"x") == "RAW"
    for blob in (raw, dsc.compress(raw), dsc.compress(dsc.compress(raw, 9))):
        w, h, bpp, back = images.load(blob)
        assert (w, h, bpp) == (5, 3, 32) and (back[:, :, :3] == px).all() and (back[:, :, 3] == 255).all()
    assert not images.is_raw(struct.pack("<hhiii", 8096, 1, 32, 0, 0)) and not images.is_raw(struct.pack("<hhiii", 1, 1, 32, 1, 0))
    with pytest.raises(ValueError):
        images.load(b"nothing")


def test_overlay_and_export():
    base = np.full((4, 4, 4), 100, np.uint8)
    patch = np.zeros((2, 9, 4), np.uint8)
    patch[0] = (1, 2, 3, 255)
    out = images.overlay(base, patch)
    assert (out[0] == (1, 2, 3, 255)).all() and (out[1:] == 100).all()
    png = images.to_png(base)
    at = png.index(b"IDAT")
    size = struct.unpack(">I", png[at - 4 : at])[0]
    assert zlib.decompress(png[at + 4 : at + 4 + size]) == (b"\0" + bytes([100] * 16)) * 4
    assert len(images.to_tga(base)) == 18 + 64


def _png(w, h, depth, form, rows, extra=b""):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    packed = zlib.compress(b"".join(rows))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, form, 0, 0, 0))
    return images.PNG + head + extra + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(2)
    px = rng.integers(0, 256, (9, 6, 4)).astype(np.uint8)
    assert images.kind(images.to_png(px)) == "PNG" and (images.load(images.to_png(px))[3] == px).all()
    rgba = px[:, :, [2, 1, 0, 3]].reshape(9, 24).astype(np.int64)
    rows = []
    for y in range(9):
        left = np.concatenate([np.zeros(4, np.int64), rgba[y, :-4]])
        up = rgba[y - 1] if y else np.zeros(24, np.int64)
        corner = np.concatenate([np.zeros(4, np.int64), up[:-4]])
        d = np.stack([np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)])
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        guess = [np.zeros(24, np.int64), left, up, (left + up) // 2, paeth][y % 5]
        rows.append(bytes([y % 5]) + ((rgba[y] - guess) & 0xFF).astype(np.uint8).tobytes())
    assert (images.from_png(_png(6, 9, 8, 6, rows)) == px).all()


def test_png_kinds():
    gray = images.from_png(_png(3, 1, 8, 0, [b"\0\x01\x02\x03"]))
    assert gray.tolist() == [[[1, 1, 1, 255], [2, 2, 2, 255], [3, 3, 3, 255]]]
    bits = images.from_png(_png(3, 1, 1, 0, [b"\0\xa0"]))
    assert bits[0, :, 0].tolist() == [255, 0, 255]
    deep = images.from_png(_png(1, 1, 16, 2, [b"\0\x01\xff\x02\xff\x03\xff"]))
    assert deep.tolist() == [[[3, 2, 1, 255]]]
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"
    table = images.from_png(_png(3, 1, 4, 3, [b"\0\x01\x00"], chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + chunk(b"tRNS", b"\x07")))
    assert table.tolist() == [[[3, 2, 1, 7], [6, 5, 4, 255], [3, 2, 1, 7]]]
    with pytest.raises(ValueError):
        images.from_png(b"plain")


@pytest.mark.parametrize(("channels", "mode"), [(3, 3), (4, 3), (1, 1), (2, 1)])
def test_psd(channels, mode):
    planes = np.random.default_rng(3).integers(0, 3, (channels, 4, 5)).astype(np.uint8)
    head = images.PSD + bytes(6) + struct.pack(">HIIHH", channels, 4, 5, 8, mode) + struct.pack(">I", 0) + struct.pack(">I", 3) + b"abc" + struct.pack(">I", 0)
    lines = []
    for row in planes.reshape(-1, 5):
        run = bytes([257 - 5, row[0]]) if (row == row[0]).all() else bytes([1, *row[:2]]) + bytes([128, 2, *row[2:]])
        lines.append(run)
    sizes = struct.pack(f">{len(lines)}H", *map(len, lines))
    for data in (head + b"\0\0" + planes.tobytes(), head + b"\0\1" + sizes + b"".join(lines)):
        w, h, bpp, px = images.load(data)
        color = planes[[2, 1, 0]] if mode == 3 else planes[[0, 0, 0]]
        alpha = planes[-1] if channels in (2, 4) else np.full((4, 5), 255)
        assert (w, h, bpp) == (5, 4, 32) and (px[:, :, :3] == color.transpose(1, 2, 0)).all() and (px[:, :, 3] == alpha).all()
