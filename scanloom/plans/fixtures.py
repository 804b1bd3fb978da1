"""Small PNG files by hand: valid ones with everything in them, and one for each error."""

from __future__ import annotations

import struct
import zlib

from ..kernels import SIGNATURE, chunk, deflate

IHDR = struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)
ROWS = bytes([0, 1, 2, 0, 3, 4])
IDAT, IEND = chunk(b"IDAT", deflate(ROWS)), chunk(b"IEND", b"")


def ihdr(width=2, height=2, depth=8, color=0, compression=0, filter_=0, interlace=0) -> bytes:
    return chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, compression, filter_, interlace))


def png(*chunks: bytes, head: bytes | None = None) -> bytes:
    return SIGNATURE + (chunk(b"IHDR", IHDR) if head is None else head) + b"".join(chunks)


def _checked(cmf: int, flg: int = 0) -> bytes:
    """A zlib header whose check holds."""
    return bytes([cmf, flg + -(cmf * 256 + flg) % 31])


def errors() -> list[tuple[str, bytes, str]]:
    """(name, file, code)."""
    good = deflate(ROWS)
    raw = good[2:-4]
    idat = lambda d: png(chunk(b"IDAT", d), IEND)
    phys, time = chunk(b"pHYs", struct.pack(">IIB", 1, 1, 0)), chunk(b"tIME", struct.pack(">HBBBBB", 2020, 1, 2, 3, 4, 5))
    plte = chunk(b"PLTE", bytes(range(6)))
    flipped = bytearray(png(IDAT, IEND))
    flipped[-1] ^= 1
    no_level = struct.pack(">I", (1 << 31) + 1) + b"IDAT"
    return [
        ("first_byte", b"\x88" + png(IDAT, IEND)[1:], "InvalidSignature"), ("five_bytes", SIGNATURE[:5], "Io"), ("cut", png(IDAT)[:-3], "Io"),
        ("empty", SIGNATURE, "Empty"), ("bkgd_3", png(chunk(b"bKGD", b"abc"), IDAT, IEND), "ChunkLength"),
        ("trns_4", png(chunk(b"tRNS", b"abcd"), IDAT, IEND), "ChunkLength"), ("huge", png(no_level), "ChunkLength"), ("crc", bytes(flipped), "Crc32"),
        ("plte_4", png(chunk(b"PLTE", b"abcd"), IDAT, IEND), "Crc32"), ("width_0", png(IDAT, IEND, head=ihdr(width=0)), "ImageDimensions"),
        ("depth_0", png(IDAT, IEND, head=ihdr(depth=0)), "BitDepth"), ("depth_17", png(IDAT, IEND, head=ihdr(depth=17)), "BitDepth"),
        ("color_1", png(IDAT, IEND, head=ihdr(color=1)), "ColorType"), ("color_5", png(IDAT, IEND, head=ihdr(color=5)), "ColorType"),
        ("color_7", png(IDAT, IEND, head=ihdr(color=7)), "ColorType"), ("rgb_4", png(IDAT, IEND, head=ihdr(color=2, depth=4)), "ColorMode"),
        ("compression_1", png(IDAT, IEND, head=ihdr(compression=1)), "CompressionMethod"), ("zlib_cm_7", idat(_checked(0x77) + good[2:]), "CompressionMethod"),
        ("ztxt_method", png(chunk(b"zTXt", b"k\0\1" + good), IDAT, IEND), "CompressionMethod"),
        ("itxt_method", png(chunk(b"iTXt", b"k\0\1\1\0\0" + good), IDAT, IEND), "CompressionMethod"),
        ("filter_1", png(IDAT, IEND, head=ihdr(filter_=1)), "FilterMethod"), ("interlace_2", png(IDAT, IEND, head=ihdr(interlace=2)), "InterlaceMethod"),
        ("no_ihdr", png(IDAT, IEND, head=b""), "ChunkOrder"), ("plte_after_trns", png(chunk(b"tRNS", b"ab"), plte, IDAT, IEND), "ChunkOrder"),
        ("phys_after_idat", png(IDAT, phys, IEND), "ChunkOrder"), ("two_ihdr", png(chunk(b"IHDR", IHDR), IDAT, IEND), "ChunkOrder"),
        ("two_time", png(time, time, IDAT, IEND), "Multiple"), ("two_plte", png(plte, plte, IDAT, IEND), "Multiple"), ("no_idat", png(IEND), "NoImageData"),
        ("no_iend", png(IDAT), "NoImageData"), ("zlib_1", idat(b"x"), "ZlibTooSmall"), ("fcheck", idat(b"\x78\x02" + good[2:]), "ZlibHeader"),
        ("fdict", idat(_checked(0x78, 32) + good[2:]), "PresetDict"), ("deflate_body", idat(good[:2] + b"\xff" + raw[1:] + good[-4:]), "Inflate"),
        ("adler", idat(good[:-1] + bytes([good[-1] ^ 1])), "AdlerChecksum"), ("filter_type_5", idat(deflate(b"\5" + ROWS[1:])), "IllegalFilterType"),
        ("phys_unit_2", png(chunk(b"pHYs", struct.pack(">IIB", 1, 1, 2)), IDAT, IEND), "PhysUnits"), ("empty_key", png(chunk(b"tEXt", b"\0v"), IDAT, IEND), "KeySize"),
        ("key_80", png(chunk(b"tEXt", b"k" * 80 + b"\0v"), IDAT, IEND), "KeySize"), ("zlib_4", idat(good[:4]), "ZlibTooSmall"),
        ("no_nul", png(chunk(b"tEXt", b"key"), IDAT, IEND), "TextLength"), ("no_palette", png(IDAT, IEND, head=ihdr(color=3)), "NoPalette"),
        ("palette_index", png(plte, IDAT, IEND, head=ihdr(color=3)), "PaletteIndex"), ("partial_row", idat(deflate(ROWS[:4])), "ShortData"),
    ]


def strict_errors() -> list[tuple[str, bytes, str]]:
    """Files that only the strict behaviour refuses."""
    bits = chunk(b"IDAT", deflate(bytes([0, 0x80, 0, 0x40])))
    return [("grey_1", png(bits, IEND, head=ihdr(depth=1)), "ColorMode"), ("unknown_after_idat", png(IDAT, chunk(b"abCd", b""), IEND), "UnknownChunkType")]


def trailing() -> bytes:
    return png(IDAT, IEND) + b"\0"


def formula_raster() -> bytes:
    """639 x 479 RGB bytes by an integer formula."""
    import numpy as np

    i = np.arange(639 * 479 * 3, dtype=np.int64)
    return (((i ^ (13 + 17 * i) ^ (13 * i) ^ ((i // 113) * 11)) >> 5) & 255).astype(np.uint8).tobytes()


def check() -> tuple[int, int]:
    raster = formula_raster()
    return zlib.crc32(raster), zlib.adler32(raster)
