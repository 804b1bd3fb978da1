"""PNG kernels in numpy, without Spark: zlib streams, row filters, Adam7, samples.

Rows of many images of one shape are worked on together. Reversing filters goes along diagonals: on a diagonal no byte
depends on another, so one pass serves all rows of all images at once, whichever filters they use.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .errors import PngError

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: (x start, y start, x step, y step) of each pass.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
MAX_PIXELS, MAX_INFLATED = 1 << 28, 1 << 31


# zlib


def inflate(data: bytes, most: int = MAX_INFLATED) -> bytes:
    """The content of a zlib stream; header, body and checksum are looked at in this order."""
    if len(data) < 2:
        raise PngError("ZlibTooSmall")
    cmf, flg = data[0], data[1]
    if (cmf << 8 | flg) % 31:
        raise PngError("ZlibHeader")
    if cmf & 15 != 8 or cmf >> 4 > 7:
        raise PngError("CompressionMethod", str(cmf & 15))
    if flg & 32:
        raise PngError("PresetDict")
    if len(data) < 6:
        raise PngError("ZlibTooSmall", str(len(data)))
    body = zlib.decompressobj(-15)
    try:
        out = body.decompress(data[2:-4], most)
        if not body.eof and body.unconsumed_tail:
            raise PngError("TooLarge", f"more than {most} bytes")
        out += body.flush()
    except zlib.error as e:
        raise PngError("Inflate", str(e)) from None
    if not body.eof:
        raise PngError("Inflate", "the stream does not end")
    if struct.unpack(">I", data[-4:])[0] != zlib.adler32(out):
        raise PngError("AdlerChecksum")
    return out


def deflate(data: bytes, level: int = 6) -> bytes:
    """A zlib stream with the header 78 01; levels 0 to 10, of which 10 is 9."""
    if not 0 <= level <= 10:
        raise ValueError("compression level is 0 to 10")
    c = zlib.compressobj(min(level, 9), zlib.DEFLATED, -15)
    return b"\x78\x01" + c.compress(data) + c.flush() + struct.pack(">I", zlib.adler32(data))


# Sizes


def bits_per_pixel(color_type: int, depth: int) -> int:
    return CHANNELS[color_type] * depth


def row_bytes(width: int, bpp: int) -> int:
    return (width * bpp + 7) // 8


def pass_size(p: int, width: int, height: int) -> tuple[int, int]:
    """Width and height of an Adam7 pass; both are 0 if one is."""
    x, y, dx, dy = ADAM7[p]
    w, h = max(0, -(-(width - x) // dx)), max(0, -(-(height - y) // dy))
    return (w, h) if w and h else (0, 0)


def filtered_size(width: int, height: int, bpp: int, interlace: bool) -> int:
    shapes = [pass_size(p, width, height) for p in range(7)] if interlace else [(width, height)]
    return sum(h * (1 + row_bytes(w, bpp)) for w, h in shapes)


# Filters


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """(n, height, 1 + bytes) filtered rows of n images -> (n, height, bytes). step: bytes of a pixel, at least 1."""
    kinds = rows[:, :, 0]
    if kinds.size and kinds.max() > 4:
        raise PngError("IllegalFilterType", str(int(kinds.max())))
    n, height, length = rows.shape[0], rows.shape[1], rows.shape[2] - 1
    body = rows[:, :, 1:]
    if not body.size or not kinds.any():
        return body.copy()
    wide = -(-length // step)
    raw = np.zeros((n, height, wide * step), np.uint8)
    raw[:, :, :length] = body
    raw = raw.reshape(n, height, wide, step)
    if wide == 1:
        _by_pixels(raw, kinds)
    elif (kinds > 2).any():
        _by_diagonals(raw, kinds)
    else:
        _by_rows(raw, kinds)
    return raw.reshape(n, height, -1)[:, :, :length]


def _by_rows(raw: np.ndarray, kinds: np.ndarray) -> None:
    """Reverses filters 0 to 2 in place, row by row."""
    above = np.zeros(raw.shape[:1] + raw.shape[2:], np.uint8)
    for y in range(raw.shape[1]):
        row, k = raw[:, y], kinds[:, y]
        if (k == 1).any():
            row[k == 1] = np.cumsum(row[k == 1], axis=1, dtype=np.uint8)
        if (k == 2).any():
            row[k == 2] += above[k == 2]
        above = row


def _by_pixels(raw: np.ndarray, kinds: np.ndarray) -> None:
    """Reverses all filters of images of one pixel a row in place: what is to the left is 0, so only 2 to 4 look up."""
    for image, kind in zip(raw, kinds.tolist()):
        for k in range(raw.shape[3]):
            value, out = 0, []
            for x, f in zip(image[:, 0, k].tolist(), kind):
                value = (x + (0 if f < 2 else value >> 1 if f == 3 else value)) & 255
                out.append(value)
            image[:, 0, k] = out


def _by_diagonals(raw: np.ndarray, kinds: np.ndarray) -> None:
    """Reverses all filters in place. The pixels (y, d - y) of a diagonal lie wide - 1 apart; besides them only the two
    diagonals before are held."""
    n, height, wide, step = raw.shape
    flat = raw.reshape(n, height * wide, step)  # a view: whole rows follow one another
    has = [bool((kinds == k).any()) for k in range(5)]
    mask = [(kinds == k)[:, :, None] for k in range(5)]
    one, two, now = (np.zeros((n, height + 1, step), np.int16) for _ in range(3))  # with a row above all
    for d in range(wide + height - 1):
        lo, hi = max(0, d - wide + 1), min(height, d + 1)
        left, up, corner = one[:, lo + 1 : hi + 1], one[:, lo:hi], two[:, lo:hi]
        here = flat[:, d + lo * (wide - 1) : d + (hi - 1) * (wide - 1) + 1 : wide - 1]
        total = now[:, lo + 1 : hi + 1]
        total[...] = here
        if has[1]:
            np.add(total, left, out=total, where=mask[1][:, lo:hi])
        if has[2]:
            np.add(total, up, out=total, where=mask[2][:, lo:hi])
        if has[3]:
            np.add(total, (left + up) >> 1, out=total, where=mask[3][:, lo:hi])
        if has[4]:
            down, side = up - corner, left - corner
            pa, pb, pc = np.abs(down), np.abs(side), np.abs(down + side)
            best = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
            np.add(total, best, out=total, where=mask[4][:, lo:hi])
        total &= 255
        here[...] = total
        # A row at its first pixel has nothing to its left: rows not begun are 0.
        now[:, hi + 1 : hi + 2] = 0
        one, two, now = now, one, two


def paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of left, up and corner the nearest to left + up - corner; of equals the first."""
    a, b, c = left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - c - c)
    return np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))


def filters(rows: np.ndarray, step: int) -> np.ndarray:
    """(n, height, bytes) -> (5, n, height, bytes): all rows by each filter."""
    left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, :, step:] = rows[:, :, :-step] if rows.shape[2] > step else 0
    up[:, 1:] = rows[:, :-1]
    corner[:, 1:] = left[:, :-1]
    mean = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    return np.stack([rows, rows - left, rows - up, rows - mean, rows - paeth(left, up, corner)])


STRATEGIES = ("zero", "minsum", "entropy", "bruteforce", "auto")


def strategy_for(strategy: str | None, color_type: int, depth: int) -> str:
    """What is asked for, or by itself zero for palettes and depths below 8, else minsum."""
    if strategy in (None, "auto"):
        return "zero" if color_type == 3 or depth < 8 else "minsum"
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    return strategy


def choose(tried: np.ndarray, strategy: str, strict: bool = False) -> np.ndarray:
    """(5, n, height, bytes) -> filter type of each row; the lowest of equals."""
    if strategy == "zero" or (strategy == "bruteforce" and strict):
        return np.zeros(tried.shape[1:3], np.uint8)
    if strategy == "minsum":
        cost = np.minimum(tried, 255 - tried).sum(3, dtype=np.int64)
        cost[0] = tried[0].sum(2, dtype=np.int64)
    elif strategy == "entropy":
        cost = np.empty(tried.shape[:3])
        size = tried.shape[3] + 1
        for k in range(5):
            flat = np.concatenate([np.full((*tried.shape[1:3], 1), k, np.uint8), tried[k]], 2).reshape(-1, size)
            counts = np.zeros((len(flat), 256), np.int64)
            np.add.at(counts, (np.repeat(np.arange(len(flat)), size), flat.reshape(-1)), 1)
            p = counts / size
            cost[k] = np.round(np.where(p > 0, -p * np.log2(np.where(p > 0, p, 1)), 0).sum(1), 5).reshape(tried.shape[1:3])
    else:
        cost = np.array([[[len(zlib.compress(bytes([k]) + r.tobytes(), 6)) for r in image] for image in tried[k]] for k in range(5)])
    return cost.argmin(0).astype(np.uint8)


def filter_rows(rows: np.ndarray, step: int, strategy: str, strict: bool = False) -> np.ndarray:
    """(n, height, bytes) -> (n, height, 1 + bytes) with each row's filter type before it."""
    n, height, length = rows.shape
    out = np.zeros((n, height, length + 1), np.uint8)
    if strategy == "zero" or not rows.size:
        out[:, :, 1:] = rows
        return out
    tried = filters(rows, step)
    kind = choose(tried, strategy, strict)
    out[:, :, 0] = kind
    out[:, :, 1:] = np.take_along_axis(tried, kind[None, :, :, None].astype(np.int64), 0)[0]
    return out


# Samples and bits


def unpack(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(n, height, bytes) -> (n, height, width, channels) samples, of 16 bits as numbers."""
    n, height, _ = rows.shape
    if depth == 16:
        return np.ascontiguousarray(rows).view(">u2").reshape(n, height, width, channels).astype(np.uint16)
    if depth == 8:
        return rows.reshape(n, height, width, channels)
    shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
    x = (rows[:, :, :, None] >> shifts) & np.uint8((1 << depth) - 1)
    return x.reshape(n, height, -1)[:, :, :width, None]


def pack(samples: np.ndarray, depth: int) -> np.ndarray:
    """The inverse of unpack(); rows are filled up with 0 bits."""
    n, height, width, channels = samples.shape
    if depth == 16:
        return np.ascontiguousarray(samples.astype(">u2")).view(np.uint8).reshape(n, height, width * channels * 2)
    if depth == 8:
        return samples.astype(np.uint8).reshape(n, height, width * channels)
    per = 8 // depth
    x = np.zeros((n, height, -(-width // per) * per), np.uint8)
    x[:, :, :width] = samples[..., 0]
    x = x.reshape(n, height, -1, per) << np.arange(8 - depth, -1, -depth, dtype=np.uint8)
    return np.bitwise_or.reduce(x, 3)


# Images


def from_filtered(data: np.ndarray, width: int, height: int, color_type: int, depth: int, interlace: bool) -> np.ndarray:
    """(n, filtered bytes) of n images of one shape -> (n, height, width, channels) samples."""
    channels, bpp = CHANNELS[color_type], bits_per_pixel(color_type, depth)
    step, n = max(1, bpp // 8), len(data)
    if not interlace:
        rows = data.reshape(n, height, 1 + row_bytes(width, bpp))
        return unpack(unfilter(rows, step), width, channels, depth)
    out = np.zeros((n, height, width, channels), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for p, (x, y, dx, dy) in enumerate(ADAM7):
        w, h = pass_size(p, width, height)
        if not w:
            continue
        size = h * (1 + row_bytes(w, bpp))
        rows = data[:, at : at + size].reshape(n, h, -1)
        out[:, y::dy, x::dx] = unpack(unfilter(rows, step), w, channels, depth)
        at += size
    return out


def to_filtered(samples: np.ndarray, color_type: int, depth: int, interlace: bool, strategy: str | None, strict: bool = False) -> np.ndarray:
    """The inverse of from_filtered()."""
    step, strategy = max(1, bits_per_pixel(color_type, depth) // 8), strategy_for(strategy, color_type, depth)
    if not interlace:
        return filter_rows(pack(samples, depth), step, strategy, strict).reshape(len(samples), -1)
    parts = [samples[:, y::dy, x::dx] for x, y, dx, dy in ADAM7]
    parts = [filter_rows(pack(s, depth), step, strategy, strict).reshape(len(samples), -1) for s in parts if s.size]
    return np.concatenate(parts, 1)


def chunk(name: bytes, data: bytes) -> bytes:
    if len(data) > 1 << 31:
        raise PngError("ChunkLength", name.decode("latin-1"))
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def encode_images(
    samples: np.ndarray, color_type: int, depth: int, interlace: bool = False, strategy: str | None = None, level: int = 6,
    palette: bytes | None = None, alphas: bytes | None = None, strict: bool = False,
) -> list[bytes]:
    """PNG files of (n, height, width, channels) samples: signature, IHDR, PLTE and tRNS if any, one IDAT, IEND."""
    n, height, width, channels = samples.shape
    if color_type not in CHANNELS or depth not in DEPTHS[color_type] or channels != CHANNELS[color_type]:
        raise PngError("ColorMode", f"{color_type}, {depth}, {channels} channels")
    if not width or not height:
        raise PngError("ImageDimensions", f"{width} x {height}")
    if color_type == 3 and (not palette or len(palette) % 3 or len(palette) > 768):
        raise PngError("BadPalette", str(len(palette or b"") // 3))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color_type, 0, 0, int(interlace)))
    if color_type == 3:
        head += chunk(b"PLTE", palette)
        if alphas:
            head += chunk(b"tRNS", alphas)
    rows, end = to_filtered(samples, color_type, depth, interlace, strategy, strict), chunk(b"IEND", b"")
    return [SIGNATURE + head + chunk(b"IDAT", deflate(r.tobytes(), level)) + end for r in rows]
