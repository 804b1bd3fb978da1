"""Framing and the order of chunks, without Spark: bytes to chunks, chunks to frames."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

from . import kernels
from .errors import PngError

MAX_LENGTH = 1 << 31
KNOWN = ("IHDR", "PLTE", "IDAT", "IEND", "bKGD", "tRNS", "pHYs", "tIME", "tEXt", "zTXt", "iTXt")


def split(content: bytes, signature: bool = True):
    """(index, offset, name, length, data, stored CRC, own CRC, error or None) of each chunk; the last has the error that
    ended the walk, if one did. Chunks after the end chunk are walked too."""
    at = 0
    if signature:
        if len(content) < 8:
            yield 0, 0, None, None, None, None, None, PngError("Io", "signature")
            return
        if content[:8] != kernels.SIGNATURE:
            yield 0, 0, None, None, None, None, None, PngError("InvalidSignature")
            return
        at = 8
    index = 0
    while at < len(content):
        if at + 8 > len(content):
            yield index, at, None, None, None, None, None, PngError("Io", "chunk header")
            return
        length, raw = struct.unpack(">I4s", content[at : at + 8])
        name = raw.decode("latin-1")
        if length > MAX_LENGTH:
            yield index, at, name, length, None, None, None, PngError("ChunkLength", name)
            return
        data, tail = content[at + 8 : at + 8 + length], content[at + 8 + length : at + 12 + length]
        if len(tail) < 4:
            yield index, at, name, length, None, None, None, PngError("Io", name)
            return
        yield index, at, name, length, data, struct.unpack(">I", tail)[0], zlib.crc32(raw + data), None
        at += 12 + length
        index += 1


def lossy(data: bytes, strict: bool) -> str:
    """UTF-8 with replacements; strict drops all bytes of a broken sequence, also the one that broke it, and a tail that
    doesn't end."""
    if not strict:
        return data.decode("utf-8", "replace")
    out, held = [], b""
    for b in data:
        held += bytes([b])
        try:
            out.append(held.decode())
            held = b""
        except UnicodeDecodeError as e:
            if e.reason != "unexpected end of data" or len(held) >= 4:
                out.append("�")
                held = b""
    return "".join(out)


def keyed(name: str, data: bytes, strict: bool, least_after: int) -> tuple[str, bytes]:
    """(keyword, what follows its NUL)."""
    end = data.find(0)
    if end < 0:
        raise PngError("TextLength", name)
    if not 1 <= end <= 79:
        raise PngError("KeySize", str(end))
    if len(data) - end - 1 < least_after:
        raise PngError("TextLength", name)
    return lossy(data[:end], strict), data[end + 1 :]


def parse(name: str, data: bytes, has_palette: bool = False, strict: bool = False, most: int = kernels.MAX_INFLATED) -> dict:
    """The fields of a chunk of a known kind. Raises PngError."""
    n = len(data)
    fixed = {"IHDR": 13, "pHYs": 9, "tIME": 7, "IEND": 0}
    if name in fixed and n != fixed[name]:
        raise PngError("ChunkLength", name)
    if name == "IHDR":
        width, height, depth, color, compression, filter_, interlace = struct.unpack(">IIBBBBB", data)
        if not width or not height:
            raise PngError("ImageDimensions", f"{width} x {height}")
        if not 1 <= depth <= 16:
            raise PngError("BitDepth", str(depth))
        if color not in kernels.CHANNELS:
            raise PngError("ColorType", str(color))
        if depth not in kernels.DEPTHS[color]:
            raise PngError("ColorMode", f"{color}, {depth}")
        for value, most_, code in ((compression, 0, "CompressionMethod"), (filter_, 0, "FilterMethod"), (interlace, 1, "InterlaceMethod")):
            if value > most_:
                raise PngError(code, str(value))
        return {"width": width, "height": height, "bit_depth": depth, "color_type": color, "interlace": bool(interlace)}
    if name == "PLTE":
        if n % 3:
            raise PngError("Crc32", name)  # the bytes left over are taken for the checksum
        return {"palette": data}
    if name == "bKGD":
        if n not in (1, 2, 6):
            raise PngError("ChunkLength", name)
        return {"background": struct.unpack({1: ">B", 2: ">H", 6: ">HHH"}[n], data)}
    if name == "tRNS":
        if has_palette:
            return {"alphas": data}
        if n not in (2, 6):
            raise PngError("ChunkLength", name)
        return {"key": struct.unpack(">H" if n == 2 else ">HHH", data)}
    if name == "pHYs":
        x, y, unit = struct.unpack(">IIB", data)
        if unit > 1:
            raise PngError("PhysUnits", str(unit))
        return {"ppu_x": x, "ppu_y": y, "is_meter": bool(unit)}
    if name == "tIME":
        return dict(zip(("year", "month", "day", "hour", "minute", "second"), struct.unpack(">HBBBBB", data)))
    if name == "tEXt":
        key, rest = keyed(name, data, strict, 0)
        return {"key": key, "val": lossy(rest, strict)}
    if name == "zTXt":
        end = data.find(0)
        if end < 0 or len(data) < end + 2:
            raise PngError("TextLength", name)
        if data[end + 1]:
            raise PngError("CompressionMethod", str(data[end + 1]))
        val = kernels.inflate(data[end + 2 :], most)
        key, _ = keyed(name, data, strict, 1)
        return {"key": key, "val": val.decode("utf-8", "replace")}
    if name == "iTXt":
        key, rest = keyed(name, data, strict, 2)
        if rest[1]:
            raise PngError("CompressionMethod", str(rest[1]))
        parts = rest[2:].split(b"\0", 2)
        if len(parts) < 3:
            raise PngError("TextLength", name)
        val = kernels.inflate(parts[2], most) if rest[0] else parts[2]
        return {
            "key": key, "langtag": lossy(parts[0], strict), "transkey": lossy(parts[1], strict),
            "val": val.decode("utf-8", "replace"), "compressed": bool(rest[0]),
        }
    return {}


@dataclass
class Frame:
    """A run of image data with what is known of its image. samples is (height, width, channels)."""

    index: int = 0
    header: dict = field(default_factory=dict)
    data: bytes = b""
    palette: bytes | None = None
    alphas: bytes | None = None
    key: tuple | None = None
    background: tuple | None = None
    physical: dict | None = None
    time: dict | None = None
    text: dict = field(default_factory=dict)
    samples: np.ndarray | None = None
    error: PngError | None = None
    warning: str | None = None


def frames(content: bytes, strict: bool = False, max_pixels: int = kernels.MAX_PIXELS, max_inflated: int = kernels.MAX_INFLATED) -> list[Frame]:
    """The frames of a file, their data inflated but not yet unfiltered. An error ends them: what was complete before it
    stays, and one last frame has the error."""
    done: list[Frame] = []
    now, state = Frame(), "start"  # start, head (before image data), data, tail (after it), end
    run: list[bytes] = []
    seen = set()

    def close():
        nonlocal run
        raw = b"".join(run)
        h = now.header
        if h["width"] * h["height"] > max_pixels:
            raise PngError("TooLarge", f"{h['width']} x {h['height']}")
        f = Frame(len(done), h, kernels.inflate(raw, max_inflated), now.palette, now.alphas, now.key, now.background, now.physical, now.time, now.text)
        if h["color_type"] == 3 and f.palette is None:
            raise PngError("NoPalette")
        if strict and h["bit_depth"] < 8:
            raise PngError("ColorMode", f"{h['color_type']}, {h['bit_depth']}")
        done.append(f)
        run = []

    try:
        for _, _, name, _, data, stored, own, error in split(content):
            if state == "end":
                for f in done:
                    f.warning = "TrailingChunk"
                return done
            if error:
                raise error
            if state == "data" and name != "IDAT":
                close()
                state = "tail"
            if name in KNOWN and name != "IDAT":
                fields = parse(name, data, now.palette is not None, strict, max_inflated)
            else:
                fields = {}
            if stored != own:
                raise PngError("Crc32", name)
            if state == "start":
                if name != "IHDR":
                    raise PngError("ChunkOrder", name)
                now.header, state = fields, "head"
                continue
            if name == "IHDR":
                raise PngError("ChunkOrder", name)
            if name == "IDAT":
                run.append(data)
                state = "data"
            elif name == "IEND":
                if state == "head":
                    raise PngError("NoImageData")
                state = "end"
            elif name in ("PLTE", "bKGD", "tRNS", "pHYs", "tIME"):
                if name != "tIME" and state == "tail":
                    raise PngError("ChunkOrder", name)
                if name == "PLTE" and seen & {"bKGD", "tRNS"}:
                    raise PngError("ChunkOrder", name)
                if name in seen:
                    raise PngError("Multiple", name)
                seen.add(name)
                if name == "PLTE":
                    now.palette = fields["palette"]
                elif name == "bKGD":
                    now.background = fields["background"]
                elif name == "tRNS":
                    now.alphas, now.key = fields.get("alphas"), fields.get("key")
                elif name == "pHYs":
                    now.physical = fields
                else:
                    now.time = fields
                    for f in done:
                        f.time = f.time or fields
            elif name in ("tEXt", "zTXt", "iTXt"):
                now.text[fields["key"]] = fields["val"]
            elif state == "tail" and strict:
                raise PngError("UnknownChunkType", name)
        if state == "start":
            raise PngError("Empty")
        if state != "end":
            if state == "data" and not strict:
                close()
            raise PngError("NoImageData")
    except PngError as e:
        done.append(Frame(len(done), now.header, error=e))
    return done


def decode(contents: list[bytes | None], strict: bool = False, max_pixels: int = kernels.MAX_PIXELS, max_inflated: int = kernels.MAX_INFLATED) -> list[list[Frame]]:
    """frames() of each file, with samples. Frames of one shape are unfiltered together, up to 16 MB at a time."""
    all_ = [frames(c, strict, max_pixels, max_inflated) if c is not None else [] for c in contents]
    shapes: dict[tuple, list[Frame]] = defaultdict(list)
    for f in (f for fs in all_ for f in fs if not f.error):
        h = f.header
        shape = (h["width"], h["height"], h["color_type"], h["bit_depth"], h["interlace"])
        bpp = kernels.bits_per_pixel(shape[2], shape[3])
        need = kernels.filtered_size(shape[0], shape[1], bpp, shape[4])
        if len(f.data) < need:
            # Whole rows that are missing are rows of zeros; a row that ends early is an error.
            if shape[4] or len(f.data) % (1 + kernels.row_bytes(shape[0], bpp)):
                f.error = PngError("ShortData", f"{len(f.data)} of {need} bytes")
                continue
            f.data += bytes(need - len(f.data))
        shapes[shape].append(f)
    for (w, h, c, d, interlace), own in shapes.items():
        need = kernels.filtered_size(w, h, kernels.bits_per_pixel(c, d), interlace)
        each = max(1, (16 << 20) // max(need, 1))
        for k in range(0, len(own), each):
            part = own[k : k + each]
            data = np.stack([np.frombuffer(f.data, np.uint8, need) for f in part])
            try:
                for f, s in zip(part, kernels.from_filtered(data, w, h, c, d, interlace)):
                    f.samples = s
            except (PngError, MemoryError):  # one of them has a bad row, or all need too much at once
                for f, x in zip(part, data):
                    try:
                        f.samples = kernels.from_filtered(x[None], w, h, c, d, interlace)[0]
                    except PngError as e:
                        f.error = e
                    except MemoryError:
                        f.error = PngError("TooLarge", f"{w} x {h}")
            for f in part:
                f.data = b""
                if c == 3 and not f.error and f.samples.size and int(f.samples.max()) >= len(f.palette) // 3:
                    f.error = PngError("PaletteIndex", str(int(f.samples.max())))
    return all_
