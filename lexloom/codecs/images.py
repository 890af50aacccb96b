"""Raw images, dispatch by content, overlay, PNG and PSD import, PNG and TGA export."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from lexloom.codecs import cbg, dsc

#: Largest side of a raw image, exclusive: a fixed value of the format.
SIDE = 8096
_HEADER = struct.Struct("<hhiii")
#: First bytes of imported formats: fixed values.
PNG, PSD = b"\x89PNG\r\n\x1a\n", b"8BPS\0\x01"


def is_raw(data: bytes) -> bool:
    """Whether the header is plausible: whole bytes per pixel, small sides, zero padding."""
    if len(data) < _HEADER.size:
        return False
    w, h, bpp, a, b = _HEADER.unpack_from(data)
    return bpp % 8 == 0 and 0 < bpp <= 32 and 0 < w < SIDE and 0 < h < SIDE and not a and not b


def load_raw(data: bytes) -> tuple[int, int, int, np.ndarray]:
    w, h, bpp, _, _ = _HEADER.unpack_from(data)
    if bpp not in (24, 32):
        raise ValueError(f"{bpp} bits per pixel")
    n = w * h * bpp // 8
    return w, h, bpp, np.frombuffer(data, np.uint8, n, _HEADER.size).reshape(h, w, bpp // 8)


def with_alpha(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] == 4:
        return pixels
    return np.concatenate([pixels, np.full((*pixels.shape[:2], 1), 255, np.uint8)], axis=2)


def save_raw(pixels: np.ndarray) -> bytes:
    """Always 32 bits per pixel, BGRA."""
    h, w = pixels.shape[:2]
    return _HEADER.pack(w, h, 32, 0, 0) + with_alpha(pixels).tobytes()


def kind(data: bytes) -> str:
    """DSC, CBG, PNG, PSD, RAWIMG or RAW, by content, in this order."""
    if dsc.is_compressed(data):
        return "DSC"
    if cbg.is_image(data):
        return "CBG"
    return "PNG" if data.startswith(PNG) else "PSD" if data.startswith(PSD) else "RAWIMG" if is_raw(data) else "RAW"


def load(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """Any image, unwrapped as often as it is wrapped."""
    what = kind(data)
    if what == "DSC":
        return load(dsc.decompress(data))
    if what == "RAW":
        raise ValueError("not an image")
    if what in ("PNG", "PSD"):
        pixels = from_png(data) if what == "PNG" else from_psd(data)
        return pixels.shape[1], pixels.shape[0], 32, pixels
    return cbg.load(data) if what == "CBG" else load_raw(data)


def _bgra(planes: np.ndarray) -> np.ndarray:
    """Height x width x (gray, gray and alpha, RGB or RGBA) as BGRA."""
    n = planes.shape[2]
    color = planes[:, :, [2, 1, 0]] if n >= 3 else planes[:, :, [0, 0, 0]]
    return with_alpha(np.concatenate([color, planes[:, :, n - 1 :]], axis=2) if n in (2, 4) else color)


#: Samples of a pixel by colour type of a PNG: fixed values.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def from_png(data: bytes) -> np.ndarray:
    """BGRA pixels of a PNG that is not interlaced. Of 16 bits a sample the upper 8 count."""
    if not data.startswith(PNG):
        raise ValueError("not a PNG image")
    at, parts = len(PNG), {b"IDAT": b""}
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        name = data[at + 4 : at + 8]
        parts[name] = (parts[name] if name == b"IDAT" else b"") + data[at + 8 : at + 8 + size]
        at += 12 + size
    w, h, depth, form, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if interlaced or form not in _SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise ValueError(f"PNG of colour type {form}, depth {depth}, interlace {interlaced}")
    samples = _SAMPLES[form]
    row, step = (w * samples * depth + 7) // 8, max(1, samples * depth // 8)
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8, h * (row + 1)).reshape(h, row + 1)
    raw = _unfiltered(rows, step)
    if depth == 16:
        values = raw.reshape(h, w * samples, 2)[:, :, 0]
    elif depth == 8:
        values = raw
    else:
        bits = np.unpackbits(raw, axis=1).reshape(h, -1, depth)
        values = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, : w * samples]
        values = values if form == 3 else values * (255 // ((1 << depth) - 1))
    values = np.ascontiguousarray(values, np.uint8).reshape(h, w, samples)
    if form != 3:
        return _bgra(values)
    palette = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
    alpha = np.full(len(palette), 255, np.uint8)
    alpha[: len(parts.get(b"tRNS", b""))] = np.frombuffer(parts.get(b"tRNS", b""), np.uint8)
    return _bgra(np.concatenate([palette, alpha[:, None]], axis=1)[values[:, :, 0]])


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """PNG rows without their filters; step: bytes from a sample to that of the pixel before."""
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    up = out[0] if len(out) else out
    for y, row in enumerate(rows):
        how, line = int(row[0]), row[1:]
        if how == 0:
            out[y] = line
        elif how == 1:
            for i in range(step):
                out[y, i::step] = np.cumsum(line[i::step], dtype=np.uint8)
        elif how == 2:
            out[y] = line + (up if y else 0)
        elif how in (3, 4):
            above, made = (up if y else np.zeros_like(line)).tolist(), [0] * step
            for i, v in enumerate(line.tolist()):
                a, b, c = made[i], above[i], above[i - step] if i >= step else 0
                if how == 3:
                    guess = (a + b) >> 1
                else:
                    to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
                made.append((v + guess) & 0xFF)
            out[y] = made[step:]
        else:
            raise ValueError(f"PNG filter {how}")
        up = out[y]
    return out


def from_psd(data: bytes) -> np.ndarray:
    """BGRA pixels of a PSD's merged image: 8 bits, gray or RGB, plain or run lengths."""
    if not data.startswith(PSD):
        raise ValueError("not a PSD image")
    channels, h, w, depth, mode = struct.unpack_from(">HIIHH", data, 12)
    if depth != 8 or mode not in (1, 3):
        raise ValueError(f"PSD of depth {depth}, mode {mode}")
    at = 26
    for _ in range(3):  # colour table, resources, layers
        at += 4 + struct.unpack_from(">I", data, at)[0]
    (packed,) = struct.unpack_from(">H", data, at)
    at += 2
    if packed == 0:
        planes = np.frombuffer(data, np.uint8, channels * h * w, at)
    elif packed == 1:
        sizes = struct.unpack_from(f">{channels * h}H", data, at)
        at += 2 * len(sizes)
        lines = []
        for size in sizes:
            lines.append(_unpack_runs(data[at : at + size], w))
            at += size
        planes = np.frombuffer(b"".join(lines), np.uint8)
    else:
        raise ValueError(f"PSD compression {packed}")
    colors = 3 if mode == 3 else 1
    return _bgra(planes.reshape(channels, h, w)[: colors + (channels > colors)].transpose(1, 2, 0))


def _unpack_runs(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        n, at = data[at], at + 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:size])


def overlay(image: np.ndarray, patch: np.ndarray, x: int = 0, y: int = 0) -> np.ndarray:
    """Draw a BGRA patch over a BGRA image by its alpha."""
    out, patch = with_alpha(image).copy(), with_alpha(patch)
    h, w = min(patch.shape[0], out.shape[0] - y), min(patch.shape[1], out.shape[1] - x)
    if h <= 0 or w <= 0:
        return out
    part, base = patch[:h, :w].astype(np.int64), out[y : y + h, x : x + w].astype(np.int64)
    a = part[:, :, 3:]
    color = (part[:, :, :3] * a + base[:, :, :3] * (255 - a)) // 255
    alpha = np.minimum(255, a + base[:, :, 3:] * (255 - a) // 255)
    out[y : y + h, x : x + w] = np.concatenate([color, alpha], axis=2).astype(np.uint8)
    return out


def to_png(pixels: np.ndarray) -> bytes:
    """PNG of BGR(A) pixels, with alpha."""
    rgba = with_alpha(pixels)[:, :, [2, 1, 0, 3]]
    h, w = rgba.shape[:2]
    rows = b"".join(b"\0" + rgba[y].tobytes() for y in range(h))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def to_tga(pixels: np.ndarray) -> bytes:
    """Uncompressed true-colour TGA of BGR(A) pixels, top row first."""
    h, w, channels = pixels.shape
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, w, h, channels * 8, 0x20 | (8 if channels == 4 else 0)) + pixels.tobytes()
