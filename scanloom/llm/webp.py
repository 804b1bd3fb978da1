"""Lossless WebP (VP8L): a decoder for all of its prefix codes, back-references, colour cache and transforms, and an
encoder. Pixels are unsigned 32-bit ARGB in numpy arrays of (height, width)."""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache
from itertools import groupby

import numpy as np

MAX_SIDE = 16384
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    "0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 "
    "3,3 -3,3 2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 "
    "1,6 -1,6 6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 "
    "2,7 -2,7 7,2 -7,2 3,7 -3,7 7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 "
    "-6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"
)
NEAR = [tuple(map(int, x.split(","))) for x in NEAR.split()]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class WebpError(ValueError):
    """The bytes are no lossless WebP that can be decoded."""


# Decoding


class Bits:
    """Reads bits, the lowest first."""

    def __init__(self, data: bytes):
        self.data, self.pos, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        p = self.pos
        self.pos = p + n
        if self.pos > self.end:
            raise WebpError("the data ends too early")
        return (int.from_bytes(self.data[p >> 3 : (p >> 3) + 5], "little") >> (p & 7)) & ((1 << n) - 1)


class Code:
    """A prefix code. table[next `width` bits] is symbol << 4 | length; only is the symbol of a code of one."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only, self.width, self.largest = None, 0, int(used[-1]) if len(used) else 0
        if len(used) <= 1:
            self.only = self.largest
            return
        table, self.width = _table(lengths, used)
        self.table = table
        self.fast = None

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        p = bits.pos
        if self.fast is None:
            self.fast = self.table.tolist()
        x = self.fast[(int.from_bytes(bits.data[p >> 3 : (p >> 3) + 4], "little") >> (p & 7)) & ((1 << self.width) - 1)]
        bits.pos = p + (x & 15)
        if bits.pos > bits.end:
            raise WebpError("the data ends too early")
        return x >> 4


@lru_cache(16)
def _reversed(width: int) -> np.ndarray:
    """Each number of `width` bits with its bits in the other order."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


def _codes(lengths: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Canonical codes of the used symbols, first bit lowest."""
    own = lengths[used]
    order = np.argsort(own, kind="stable")
    share = 1 << (15 - own[order])
    end = np.cumsum(share)
    if end[-1] != 1 << 15:
        raise WebpError("a prefix code is not complete")
    out = np.empty(len(used), np.int64)
    out[order] = _reversed(15)[end - share]
    return out


def _table(lengths: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, int]:
    own = lengths[used]
    width = int(own.max())
    order = np.argsort(own, kind="stable")
    share = 1 << (width - own[order])
    if share.sum() != 1 << width:
        raise WebpError("a prefix code is not complete")
    return np.repeat((used[order] << 4 | own[order]).astype(np.int32), share)[_reversed(width)], width


@lru_cache(256)
def _single(symbol: int) -> Code:
    """The code of one symbol."""
    lengths = np.zeros(256, np.int64)
    lengths[symbol] = 1
    return Code(lengths)


@lru_cache(64)
def _inner_table(lengths: tuple[int, ...]) -> tuple[list[int], int]:
    """Table and mask of a code of code lengths; of one symbol an entry without bits."""
    code = Code(np.array(lengths, np.int64))
    return ([code.only << 4], 0) if code.only is not None else (code.table.tolist(), (1 << code.width) - 1)


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbol = bits.read(8 if wide else 1)
        if not two:
            return _single(symbol)
        lengths = np.zeros(max(size, 256), np.int64)
        lengths[symbol] = 1
        lengths[bits.read(8)] = 1
        return Code(lengths)
    n, first = 4 + bits.read(4), [0] * 19
    each = bits.read(30) | bits.read(3 * n - 30) << 30 if n > 10 else bits.read(3 * n)
    for i, k in enumerate(ORDER[:n]):
        first[k] = each >> 3 * i & 7
    table, mask = _inner_table(tuple(first))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, at, last, data, pos = [0] * size, 0, 8, bits.data, bits.pos
    while at < size and left > 0:
        left -= 1
        window = int.from_bytes(data[pos >> 3 : (pos >> 3) + 4], "little") >> (pos & 7)
        x = table[window & mask]
        s, own = x >> 4, x & 15
        if s < 16:
            pos += own
            lengths[at] = s
            at += 1
            last = s or last
            continue
        more, least = ((2, 3), (3, 3), (7, 11))[s - 16]
        n = least + (window >> own & (1 << more) - 1)
        pos += own + more
        if at + n > size:
            raise WebpError("code lengths run over")
        if s == 16:
            lengths[at : at + n] = [last] * n
        at += n
    bits.pos = pos
    if pos > bits.end:
        raise WebpError("the data ends too early")
    return Code(np.array(lengths, np.int64))


def _value(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The pixels of an entropy-coded image, in a row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("the colour cache is too large")
    groups, meta, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        meta = ((_read_image(bits, across, -(-height >> shift), False) >> 8) & 0xFFFF).tolist()
        groups = max(meta) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else None
    sizes = (280 + (len(cache) if cache else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    green, red, blue, alpha, far = codes[0]
    if groups == 1 and cache is None and green.largest < 256 and None not in (red.only, blue.only, alpha.only):
        rest = np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
        return (_literals(bits, green, total).astype(np.uint32) << 8) | rest
    if groups == 1 and cache is None and green.only is None and None not in (red.only, blue.only, alpha.only):
        rest = np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
        return (_with_copies(bits, green, far, total, width).astype(np.uint32) << 8) | rest
    out, at = [0] * total, 0
    while at < total:
        if meta is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, far = codes[meta[(y >> shift) * across + (x >> shift)]]
        s = green.read(bits)
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            v = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            out[at] = v
            at += 1
            if cache:
                cache[((0x1E35A7BD * v) & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        elif s < 280:
            n, d = _value(s - 256, bits), _value(far.read(bits), bits)
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(dx + dy * width, 1)
            if d > at or at + n > total:
                raise WebpError("a back-reference leads out of the image")
            for k in range(at, at + n):
                v = out[k] = out[k - d]
                if cache:
                    cache[((0x1E35A7BD * v) & 0xFFFFFFFF) >> (32 - cache_bits)] = v
            at += n
        else:
            if not cache or s - 280 >= len(cache):
                raise WebpError("there is no such colour in the cache")
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _literals(bits: Bits, code: Code, total: int) -> np.ndarray:
    """Symbols of one code without anything between: what each bit would begin is looked up for all bits at once, then
    followed from the first."""
    if code.only is not None:
        return np.full(total, code.only, np.int32)
    first = bits.pos >> 3
    # No more bytes than the symbols can need.
    data = np.frombuffer(bits.data, np.uint8)[first : first + total * code.width // 8 + 4]
    wide = np.zeros(len(data) + 2, np.uint32)
    wide[: len(data)] = data
    three = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    window = (three[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << code.width) - 1)
    entry = code.table[window.reshape(-1)]
    # How far one, two and four symbols lead from each bit; only each fourth symbol is then followed in turn.
    here = np.arange(len(entry))
    one = np.zeros(len(entry) + 64, np.uint8)
    one[: len(entry)] = entry & 15
    two = one.copy()
    two[: len(entry)] += one[here + one[: len(entry)]]
    four = (two[: len(entry)] + two[here + two[: len(entry)]]).tobytes()
    pos, at = bits.pos & 7, []
    put = at.append
    try:
        for _ in range(-(-total // 4)):
            put(pos)
            pos += four[pos]
    except IndexError:
        raise WebpError("the data ends too early") from None
    at = np.array(at, np.int64)
    at = np.stack([at, at + two[at]], 1).reshape(-1)
    at = np.stack([at, at + one[at]], 1).reshape(-1)[:total]
    pos = int(at[-1]) + int(one[at[-1]])
    bits.pos = (first << 3) + pos
    if bits.pos > bits.end:
        raise WebpError("the data ends too early")
    return entry[at] >> 4


@lru_cache(64)
def _near(width: int) -> np.ndarray:
    """Distances of the codes 1 to 120, at their numbers."""
    return np.array([0, *(max(x + y * width, 1) for x, y in NEAR)], np.int64)


def _values(prefix: np.ndarray, read, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths or distances, their extra bits' number) of prefixes whose extra bits begin at some bits."""
    n = np.maximum(prefix - 2, 0) >> 1
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << n) + read(at, (1 << n) - 1) + 1), n


def _with_copies(bits: Bits, code: Code, far: Code, total: int, width: int) -> np.ndarray:
    """Symbols of one code with back-references between: as in _literals(), the length of what each bit would begin is
    found for all bits at once; then it is followed from the first, and the copies are made in turn."""
    first = bits.pos >> 3
    data = np.frombuffer(bits.data, np.uint8)[first : first + 8 * total + 16]
    wide = np.zeros(len(data) + 24, np.int64)
    wide[: len(data)] = data
    wide = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    window = (wide[: len(data), None] >> np.arange(8)) & ((1 << code.width) - 1)
    entry = code.table.take(window.reshape(-1))
    read = lambda at, mask: (wide.take(at >> 3) >> (at & 7)) & mask

    def reference(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits, length, distance) of the back-references that begin at some bits."""
        x = entry.take(at).astype(np.int64)
        own = at + (x & 15)
        n, more = _values((x >> 4) - 256, read, own)
        own = own + more
        if far.only is None:
            y = far.table[read(own, (1 << far.width) - 1)].astype(np.int64)
            own, y = own + (y & 15), y >> 4
        else:
            y = np.full(len(at), far.only, np.int64)
        d, more = _values(y, read, own)
        return own + more - at, n, np.where(d > 120, d - 120, _near(width)[np.minimum(d, 120)])

    one = np.zeros(len(entry) + 256, np.uint8)
    np.bitwise_and(entry, 15, out=one[: len(entry)], casting="unsafe")
    copies = (entry >= 256 << 4).nonzero()[0]
    one[copies], sizes, far_off = reference(copies)
    here = np.arange(len(entry))
    two = one.copy()
    two[: len(entry)] += one.take(here + one[: len(entry)])
    four = (two[: len(entry)] + two.take(here + two[: len(entry)])).tobytes()
    pos, at = bits.pos & 7, []
    put = at.append
    try:
        for _ in range(-(-total // 4)):
            step = four[pos]
            put(pos)
            pos += step
    except IndexError:  # the end of the data; whether that is too early is seen below
        pass
    at = np.array(at, np.int64)
    at = np.stack([at, at + two[at]], 1).reshape(-1)
    at = np.stack([at, at + one[at]], 1).reshape(-1)
    at = at[at < len(entry)]
    symbol = entry[at] >> 4
    is_copy = symbol >= 256
    size, own = np.ones(len(at), np.int64), np.searchsorted(copies, at[is_copy])
    size[is_copy], d = sizes[own], far_off[own]
    end = np.cumsum(size)
    last = int(np.searchsorted(end, total))
    if last == len(at):
        raise WebpError("the data ends too early")
    if end[last] != total:
        raise WebpError("a back-reference leads out of the image")
    bits.pos = (first << 3) + int(at[last]) + int(one[at[last]])
    if bits.pos > bits.end:
        raise WebpError("the data ends too early")
    symbol, is_copy, size, end = (c[: last + 1] for c in (symbol, is_copy, size, end))
    flat = np.zeros(total, np.uint8)
    flat[end[~is_copy] - 1] = symbol[~is_copy]
    out = bytearray(flat.tobytes())
    for e, n, d in zip(end[is_copy].tolist(), size[is_copy].tolist(), d.tolist()):
        at = e - n
        if d > at:
            raise WebpError("a back-reference leads out of the image")
        out[at:e] = out[at - d : at - d + n] if d >= n else (out[at - d : at] * (n // d + 1))[:n]
    return np.frombuffer(out, np.uint8)


def _average(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b)]


def _predict(mode: int, left, up, right, corner):
    """right is above right, corner above left; channels as lists."""
    if mode == 5:
        return _average(_average(left, right), up)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, up)
    if mode == 10:
        return _average(_average(left, corner), _average(up, right))
    if mode == 11:
        to_left = sum(abs(u - c) for u, c in zip(up, corner))
        to_up = sum(abs(x - c) for x, c in zip(left, corner))
        return left if to_left < to_up else up
    if mode == 12:
        return [min(max(x + u - c, 0), 255) for x, u, c in zip(left, up, corner)]
    mid = _average(left, up)  # mode 13; the half is rounded towards 0
    return [min(max(m + int((m - c) / 2), 0), 255) for m, c in zip(mid, corner)]


def _unpredict(pixels: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Inverts the predictor transform. Predictors that don't need the pixel before go by whole stretches of a row."""
    height, width = pixels.shape
    x = pixels.view(np.uint8).reshape(height, width, 4).copy()
    black = np.array([0, 0, 0, 255], np.uint8)
    x[0, 0] += black
    if width > 1:
        x[0] = np.cumsum(x[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        row, above = x[y], x[y - 1]
        row[0] += above[0]
        for k, mode in enumerate(modes[y >> shift].tolist()):
            a, b = max(k << shift, 1), min((k + 1) << shift, width)
            if a >= b:
                continue
            if b < width:
                right = above[a + 1 : b + 1]
            else:  # right of the last pixel lies the first of this row
                right = np.concatenate([above[a + 1 : b], row[:1]])
            up, corner = above[a:b], above[a - 1 : b - 1]
            if mode == 0 or mode > 13:
                row[a:b] += black
            elif mode == 1:
                row[a:b] = np.cumsum(np.concatenate([row[a - 1 : a], row[a:b]]), axis=0, dtype=np.uint8)[1:]
            elif mode in (2, 3, 4):
                row[a:b] += {2: up, 3: right, 4: corner}[mode]
            elif mode in (8, 9):
                other = corner if mode == 8 else right
                row[a:b] += ((up.astype(np.uint16) + other) >> 1).astype(np.uint8)
            else:
                left, ups, rights, corners = row[a - 1].tolist(), up.tolist(), right.tolist(), corner.tolist()
                own = row[a:b].tolist()
                for i in range(b - a):
                    p = _predict(mode, left, ups[i], rights[i], corners[i])
                    left = own[i] = [(v + q) & 255 for v, q in zip(own[i], p)]
                row[a:b] = own
    return x.reshape(height, width * 4).view(np.uint32)


def _spread(elements: np.ndarray, shift: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(elements, 1 << shift, 0)[:height], 1 << shift, 1)[:, :width]


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.uint8).view(np.int8).astype(np.int32) * c.astype(np.uint8).view(np.int8)) >> 5


def _cross(pixels: np.ndarray, elements: np.ndarray, shift: int, sign: int) -> np.ndarray:
    """Adds (1) or takes away (-1) what red and blue owe to the other channels."""
    e = _spread(elements, shift, *pixels.shape)
    green, red, blue = (pixels >> 8) & 255, (pixels >> 16) & 255, pixels & 255
    new_red = (red.astype(np.int32) + sign * _delta(e & 255, green)) & 255
    true_red = new_red if sign > 0 else red
    new_blue = (blue.astype(np.int32) + sign * (_delta((e >> 8) & 255, green) + _delta((e >> 16) & 255, true_red))) & 255
    return (pixels & np.uint32(0xFF00FF00)) | (new_red.astype(np.uint32) << 16) | new_blue.astype(np.uint32)


def decode(data: bytes) -> np.ndarray:
    """One file's pixels. Raises WebpError."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebpError("no WebP file")
    at = 12
    while True:
        if at + 8 > len(data):
            raise WebpError("no lossless image")
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"VP8L":
            break
        at += 8 + size + (size & 1)
    body = data[at + 8 : at + 8 + size]
    if len(body) < size or size < 5 or body[0] != 0x2F:
        raise WebpError("no lossless image")
    bits = Bits(body)
    bits.read(8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebpError("unknown version")
    todo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (x[0] for x in todo):
            raise WebpError("a transform is there twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            w, h = -(-across >> shift), -(-height >> shift)
            todo.append((kind, shift, _read_image(bits, w, h, False).reshape(h, w), across))
        elif kind == SUBTRACT_GREEN:
            todo.append((kind, 0, None, across))
        else:
            n = bits.read(8) + 1
            steps = _read_image(bits, n, 1, False).view(np.uint8).reshape(n, 4)
            colours = np.cumsum(steps, axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, shift, colours, across))
            across = -(-across >> shift)
    x = _read_image(bits, across, height, True).reshape(height, across)
    for kind, shift, what, across in reversed(todo):
        if kind == PREDICTOR:
            x = _unpredict(np.ascontiguousarray(x), (what >> 8) & 15, shift)
        elif kind == CROSS_COLOUR:
            x = _cross(x, what, shift, 1)
        elif kind == SUBTRACT_GREEN:
            green = (x >> 8) & 255
            x = (x & np.uint32(0xFF00FF00)) | ((((x >> 16) + green) & 255) << 16) | ((x + green) & 255)
        else:
            each = 8 >> shift
            index = (x >> 8) & 255
            if shift:
                index = (index[:, :, None] >> np.arange(0, 8, each, dtype=np.uint32)) & np.uint32((1 << each) - 1)
                index = index.reshape(height, -1)[:, :across]
            colours = np.zeros(256, np.uint32)
            colours[: len(what)] = what
            x = colours[index]
    return x


# Encoding


class Writer:
    def __init__(self):
        self.parts, self.value, self.n = [], 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n > 4096:
            self.flush()

    def flush(self) -> None:
        whole = self.n >> 3
        self.parts.append((self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
        self.value >>= 8 * whole
        self.n &= 7

    def extend(self, bits: np.ndarray) -> None:
        """Many bits, as 0 and 1."""
        head = [(self.value >> k) & 1 for k in range(self.n)]
        if self.n > 7:
            self.flush()
            head = [(self.value >> k) & 1 for k in range(self.n)]
        bits = np.concatenate([np.array(head, np.uint8), bits])
        whole = len(bits) & ~7
        self.parts.append(np.packbits(bits[:whole], bitorder="little").tobytes())
        rest = bits[whole:].tolist()
        self.value, self.n = sum(b << k for k, b in enumerate(rest)), len(rest)

    def extend_codes(self, values: np.ndarray, n: np.ndarray) -> None:
        """Many values, each of so many bits, 33 at most. They are added up by words of 32 bits, which doubles hold."""
        self.flush()
        values, n = np.append(self.value, values).astype(np.uint64), np.append(self.n, n)
        end = np.cumsum(n)
        at, total = end - n, int(end[-1])
        values <<= (at & 31).astype(np.uint64)
        word, size = at >> 5, (total >> 5) + 2
        low = np.bincount(word, values & np.uint64(0xFFFFFFFF), size)
        high = np.bincount(word + 1, values >> np.uint64(32), size)
        data = (low + high).astype("<u4").tobytes()
        whole, self.n = total >> 3, total & 7
        self.parts.append(data[:whole])
        self.value = data[whole] & ((1 << self.n) - 1)

    def bytes(self) -> bytes:
        self.put(0, -self.n % 8)
        self.flush()
        return b"".join(self.parts)


def code_lengths(count: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a Huffman code, none above `most`."""
    lengths = np.zeros(len(count), np.int64)
    used = np.flatnonzero(count).tolist()
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    weights = count[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up, n = [0] * (2 * len(used)), len(used)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            up[a[1]] = up[b[1]] = n
            heapq.heapreplace(heap, (a[0] + b[0], n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[: len(used)]) <= most:
            lengths[used] = depth[: len(used)]
            return lengths
        weights = [(w + 1) >> 1 for w in weights]


# The code of code lengths is always this one: 4 bits, or 5 for the lengths 12 to 15; 16 is not used.
_INNER = np.array([4] * 12 + [5] * 4 + [0, 4, 4], np.int64)
_INNER_CODE = dict(zip(np.flatnonzero(_INNER).tolist(), _codes(_INNER, np.flatnonzero(_INNER)).tolist()))
_INNER_BITS = _INNER.tolist()
# What comes before the lengths: no simple code, 19 lengths of 3 bits each, and lengths of all symbols.
_INNER_HEAD = (15 << 1 | sum(_INNER_BITS[k] << 5 + 3 * i for i, k in enumerate(ORDER)), 63)


def _write_code(w: Writer, count: np.ndarray) -> np.ndarray:
    """Writes a prefix code for symbols that occur so often; its lengths, all 0 if no symbol needs a bit."""
    used = np.flatnonzero(count)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        s = int(used[0]) if len(used) else 0
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(s, 8)
        return np.zeros(len(count), np.int64)
    lengths = code_lengths(count)
    w.put(*_INNER_HEAD)
    total = n = 0  # bits, and how many
    for v, group in groupby(lengths.tolist()):
        m = len(list(group))
        while m:
            if v or m < 3:
                symbol, k, more, extra = v, 1, 0, 0
            elif m < 11:
                symbol, k, more, extra = 17, m, 3, m - 3
            else:
                k = min(m, 138)
                symbol, more, extra = 18, 7, k - 11
            own = _INNER_BITS[symbol]
            total |= (_INNER_CODE[symbol] | extra << own) << n
            n += own + more
            m -= k
    w.put(total, n)
    return lengths if len(used) > 1 else lengths * 0


def _code_bits(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol its code as bits, and which of them count."""
    used = np.flatnonzero(lengths)
    width = int(lengths.max()) if len(used) else 0
    bits = np.zeros((len(lengths), width), np.uint8)
    if len(used):
        bits[used] = (_codes(lengths, used)[:, None] >> np.arange(width)) & 1
    return bits, np.arange(width)[None, :] < lengths[:, None]


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' number, extra bits) of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    second = (value >> (high - 1)) & 1
    return 2 * high + second, high - 1, value & ((1 << (high - 1)) - 1)


def _write_image(w: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: bool = False) -> None:
    """Writes pixels (in a row). With a colour cache or copies, pixel by pixel."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    if not cache_bits and not copies:
        channels = [((pixels >> np.uint32(s)) & np.uint32(255)).astype(np.uint8) for s in (8, 16, 0, 24)]
        counts = [np.bincount(c, minlength=n) for c, n in zip(channels, (280, 256, 256, 256))]
        lengths = [_write_code(w, c) for c in counts]
        _write_code(w, np.zeros(40, np.int64))
        some = [(c, *_code_bits(n)) for c, n in zip(channels, lengths) if n.any()]
        if some:
            bits = np.concatenate([b[c] for c, b, _ in some], axis=1)
            mask = np.concatenate([m[c] for c, _, m in some], axis=1)
            w.extend(bits[mask])
        return
    values, tokens, at = pixels.tolist(), [], 0
    cache, seen = [0] * (1 << cache_bits) if cache_bits else None, {}
    slot = lambda v: ((0x1E35A7BD * v) & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(values):
        best = 0
        if copies and at + 3 <= len(values):
            here = tuple(values[at : at + 3])
            for start in seen.get(here, ())[-8:]:
                n = 3
                while at + n < len(values) and n < 4096 and values[start + n] == values[at + n]:
                    n += 1
                if n > best:
                    best, d = n, at - start
        n = best or 1
        if best:
            tokens.append(("copy", n, d))
        elif cache and cache[slot(values[at])] == values[at]:
            tokens.append(("cache", slot(values[at])))
        else:
            tokens.append(("pixel", values[at]))
        for k in range(at, at + n):
            if cache:
                cache[slot(values[k])] = values[k]
            if copies and k + 3 <= len(values):
                seen.setdefault(tuple(values[k : k + 3]), []).append(k)
        at += n
    near = {}
    for i, (x, y) in enumerate(NEAR):
        near.setdefault(max(x + y * width, 1), i + 1)
    flat = []  # (code, symbol, extra bits' number, extra bits)
    for t in tokens:
        if t[0] == "pixel":
            flat += [(i, (t[1] >> s) & 255, 0, 0) for i, s in enumerate((8, 16, 0, 24))]
        elif t[0] == "cache":
            flat.append((0, 280 + t[1], 0, 0))
        else:
            p, n, e = _prefix(t[1])
            q, m, f = _prefix(near.get(t[2], t[2] + 120))
            flat += [(0, 256 + p, n, e), (4, q, m, f)]
    sizes = (280 + (len(cache) if cache else 0), 256, 256, 256, 40)
    counts = [np.zeros(n, np.int64) for n in sizes]
    for c, s, _, _ in flat:
        counts[c][s] += 1
    codes = []
    for c in counts:
        n = _write_code(w, c)
        used = np.flatnonzero(n)
        codes.append(({s: v for s, v in zip(used.tolist(), _codes(n, used).tolist())} if len(used) else {}, n))
    for c, s, n, e in flat:
        if codes[c][0]:
            w.put(codes[c][0][s], int(codes[c][1][s]))
        w.put(e, n)


def _sub(a: np.ndarray, b) -> np.ndarray:
    return ((a.view(np.uint8) - np.asarray(b).view(np.uint8)) & 255).view(np.uint32)


def _forward_predict(x: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width = x.shape
    c = x.copy().view(np.uint8).reshape(height, width, 4)
    out = c.copy()
    flat = c.reshape(-1, 4).tolist()
    for y in range(height):
        for i in range(width):
            at = y * width + i
            left, up = (flat[at - 1] if at else None), (flat[at - width] if y else None)
            if not at:
                p = [0, 0, 0, 255]
            elif not y:
                p = left
            elif not i:
                p = up
            else:
                mode, right, corner = int(modes[y >> shift, i >> shift]), flat[at - width + 1], flat[at - width - 1]
                if mode in (0, 1, 2, 3, 4):
                    p = ([0, 0, 0, 255], left, up, right, corner)[mode]
                elif mode in (8, 9):
                    p = _average(up, corner if mode == 8 else right)
                else:
                    p = _predict(mode, left, up, right, corner)
            out[y, i] = [(v - q) & 255 for v, q in zip(flat[at], p)]
    return out.reshape(height, width * 4).view(np.uint32)


def encode(
    pixels: np.ndarray, subtract_green: bool = True, predictor: np.ndarray | None = None, cross: np.ndarray | None = None,
    shift: int = 2, palette: bool = False, cache_bits: int = 0, copies: bool = False,
) -> bytes:
    """A lossless WebP file of (height, width) ARGB pixels. predictor (modes) and cross (elements) are per block of
    2**shift pixels; palette needs 256 colours at most."""
    height, width = pixels.shape
    if not (0 < height <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise WebpError("no such size")
    x = np.ascontiguousarray(pixels, np.uint32)
    w = Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(int((x >> 24).min() < 255), 1), w.put(0, 3)
    if palette:
        colours, index = np.unique(x, return_inverse=True)
        n = len(colours)
        if n > 256:
            raise WebpError("too many colours for a palette")
        w.put(1, 1), w.put(PALETTE, 2), w.put(n - 1, 8)
        steps = colours.copy()
        steps[1:] = _sub(colours[1:], colours[:-1])
        _write_image(w, steps, n, False)
        bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        index, each = index.reshape(height, width).astype(np.uint32), 8 >> bits
        index = np.pad(index, ((0, 0), (0, -width % (1 << bits)))).reshape(height, -1, 1 << bits)
        x = np.uint32(0xFF000000) | ((index << np.arange(0, 8, each, dtype=np.uint32)).sum(2).astype(np.uint32) << 8)
        subtract_green = False
    if predictor is not None:
        w.put(1, 1), w.put(PREDICTOR, 2), w.put(shift - 2, 3)
        _write_image(w, (np.uint32(0xFF000000) | (predictor.astype(np.uint32) << 8)).reshape(-1), predictor.shape[1], False)
        x = _forward_predict(x, predictor, shift)
    if cross is not None:
        w.put(1, 1), w.put(CROSS_COLOUR, 2), w.put(shift - 2, 3)
        _write_image(w, cross.astype(np.uint32).reshape(-1), cross.shape[1], False)
        x = _cross(x, cross, shift, -1)
    if subtract_green:
        w.put(1, 1), w.put(SUBTRACT_GREEN, 2)
        green = (x >> 8) & 255
        x = (x & np.uint32(0xFF00FF00)) | ((((x >> 16) - green) & 255) << 16) | ((x - green) & 255)
    w.put(0, 1)
    _write_image(w, x.reshape(-1), x.shape[1], True, cache_bits, copies)
    return _file(w.bytes())


def _file(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


MATCH, LONGEST = 6, 4096  # bytes that are looked for, and pixels of one copy


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix() of many values."""
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    small = v < 4
    n = np.where(small, 0, high - 1)
    return np.where(small, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1)), n, np.where(small, 0, v & ((1 << n) - 1))


def _bits_each(count: np.ndarray) -> np.ndarray:
    """The bits that a symbol takes which occurs so often."""
    return np.log2(max(int(count.sum()), 1)) - np.log2(np.maximum(count, 1))


def find_copies(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of copies of what was before, in order and without overlap, each of which takes fewer
    bits than its samples do. A place is compared with the last one that has the same MATCH bytes."""
    none = np.zeros(0, np.int64)
    n = len(flat) - MATCH + 1
    if n < 2:
        return none, none, none
    x = flat.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(MATCH):
        key |= x[k : k + n] << np.uint64(8 * k)
    mixed = np.sort(((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64))
    at = (mixed & np.uint64((1 << 24) - 1)).astype(np.int64)
    same = (mixed[1:] >> np.uint64(24)) == (mixed[:-1] >> np.uint64(24))
    at, before = at[1:][same], at[:-1][same]
    same = key[at] == key[before]
    far = np.zeros(n, np.int64)
    far[at[same]] = (at - before)[same]
    # Places one after the other with one distance are one copy; what the copy before has reached is left to that.
    start = np.flatnonzero((far > 0) & np.concatenate([[True], far[1:] != far[:-1]]))
    if not len(start):
        return none, none, none
    change = np.append(np.flatnonzero(far[1:] != far[:-1]) + 1, n)
    end = change[np.searchsorted(change, start, "right")] + MATCH - 1
    d = far[start]
    start = np.maximum(start, np.concatenate([[0], end[:-1]]))
    cost = np.concatenate([[0.0], np.cumsum(_bits_each(np.bincount(flat, minlength=256))[flat])])
    size = end - start
    worth = size > 2
    start, size, d, end = start[worth], size[worth], d[worth], end[worth]
    worth = cost[end] - cost[start] > 12 + _prefixes(size)[1] + _prefixes(d + 120)[1]
    start, size, d = start[worth], size[worth], d[worth]
    if len(size) and size.max() > LONGEST:
        parts = -(-size // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size, d = np.repeat(start, parts) + nth * LONGEST, np.minimum(np.repeat(size, parts) - nth * LONGEST, LONGEST), np.repeat(d, parts)
    return start, size, d


@lru_cache(64)
def _codes_of_near(width: int) -> np.ndarray:
    """The code of each distance that has one of 1 to 120, else 0."""
    near = _near(width)
    out = np.zeros(int(near.max()) + 1, np.int64)
    out[near[:0:-1]] = np.arange(len(near) - 1, 0, -1)
    return out


def _write_green(w: Writer, flat: np.ndarray, width: int, alpha: int) -> None:
    """Writes an image of which only green (flat) changes, with back-references where they take fewer bits."""
    start, size, d = find_copies(flat)
    single = np.ones(len(flat), bool)
    if len(start):
        edge = np.zeros(len(flat) + 1, np.int8)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + size, -1)
        single = np.cumsum(edge[:-1], dtype=np.int8) == 0
    near = _codes_of_near(width)
    code = np.where(d < len(near), near[np.minimum(d, len(near) - 1)], 0)
    (p, q), (pn, qn), (pe, qe) = (np.split(x, 2) for x in _prefixes(np.concatenate([size, np.where(code > 0, code, d + 120)])))
    w.put(0, 2)  # no cache, one group of codes
    lengths = _write_code(w, np.bincount(flat[single], minlength=280) + np.bincount(256 + p, minlength=280))
    for s in (0, 0, alpha):  # red, blue, alpha
        w.put(0b101 | s << 3, 11)
    far = _write_code(w, np.bincount(q, minlength=40))
    # At each pixel: a symbol; of a copy with its length's extra bits, and a distance with its own.
    value, n = np.zeros((len(flat), 2), np.int64), np.zeros((len(flat), 2), np.int64)
    codes, far_codes = _code_table(lengths), _code_table(far)
    value[:, 0], n[:, 0] = codes.take(flat), np.where(single, lengths.take(flat), 0)
    if len(start):
        p, pn = p + 256, pn + lengths[256 + p]
        value[start, 0], n[start, 0] = codes[p] | pe << lengths[p], pn
        value[start, 1], n[start, 1] = far_codes[q] | qe << far[q], qn + far[q]
    n = n.reshape(-1)
    some = n.nonzero()[0]
    w.extend_codes(value.reshape(-1).take(some), n.take(some))


def _code_table(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code; 0 of those that have none."""
    out, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    if len(used):
        out[used] = _codes(lengths, used)
    return out


def _grey_file(samples: np.ndarray, predictor: int = 0, palette: bool = False) -> bytes:
    """A file of grey pixels; with one predictor (left or up) for all of them, or a palette of 16 values at most."""
    height, width = samples.shape
    w = Writer()
    w.put(0x2F | (width - 1) << 8 | (height - 1) << 22, 40)
    alpha = 255
    if palette:
        values, index = np.unique(samples, return_inverse=True)
        w.put(1, 1), w.put(PALETTE, 2), w.put(len(values) - 1, 8)
        colours = np.uint32(0xFF000000) | values.astype(np.uint32) * np.uint32(0x10101)
        steps = colours.copy()
        steps[1:] = _sub(colours[1:], colours[:-1])
        _write_image(w, steps, len(values), False)
        bits = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        index = index.reshape(height, width).astype(np.uint8)
        index = np.pad(index, ((0, 0), (0, -width % (1 << bits)))).reshape(height, -1, 1 << bits)
        samples = np.bitwise_or.reduce(index << np.arange(0, 8, 8 >> bits, dtype=np.uint8), axis=2)
    elif predictor:
        w.put(1, 1), w.put(PREDICTOR, 2), w.put(7, 3)  # blocks of 512 pixels
        blocks = -(-width >> 9) * -(-height >> 9)
        _write_image(w, np.full(blocks, 0xFF000000 | predictor << 8, np.uint32), -(-width >> 9), False)
        samples, alpha = _residual(samples, predictor), 0
    if not palette:
        w.put(1, 1), w.put(SUBTRACT_GREEN, 2)
    w.put(0, 1)
    _write_green(w, samples.reshape(-1), samples.shape[1], alpha)
    return _file(w.bytes())


def _residual(samples: np.ndarray, predictor: int) -> np.ndarray:
    """What a predictor (1: left, 2: up) leaves of grey pixels; the first row has left, the first column up."""
    out = samples.copy()
    if predictor == 1:
        out[:, 1:] -= samples[:, :-1]
        out[1:, 0] -= samples[:-1, 0]
    else:
        out[1:] -= samples[:-1]
        out[0, 1:] -= samples[0, :-1]
    return out


def encode_grey(samples: np.ndarray) -> bytes:
    """A lossless WebP file of (height, width) 8-bit samples as grey pixels, without making the pixels: the smallest of
    plain ones, those with a palette if there are 16 values at most, and those with the predictors that leave fewer bits.

    Green is all that is left of grey pixels, so cross-colour has nothing to take away, and a colour in the cache would be
    a second symbol for the same value in the same code: neither makes a file smaller, and none has them."""
    count = np.bincount(samples.reshape(-1), minlength=256)
    kinds: list[dict] = [{}]
    if np.count_nonzero(count) <= 16:
        kinds.append({"palette": True})
    least = float(_bits_each(count) @ count)
    for k in (1, 2):
        left = np.bincount(_residual(samples, k).reshape(-1), minlength=256)
        if float(_bits_each(left) @ left) < 0.9 * least:
            kinds.append({"predictor": k})
    return min((_grey_file(samples, **k) for k in kinds), key=len)
