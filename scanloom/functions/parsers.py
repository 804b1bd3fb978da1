"""Fields of each kind of chunk as column expressions over (name, data), and the code of what is wrong with them.

Only compressed texts need Python: inflate_text() is an Arrow UDF, apart from the rest, so that a plan that doesn't ask
for them has none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PngError
from .binary import put, u8, u16, u32

NUL = "\0"


def _error(*cases: tuple[Column, str]) -> Column:
    out = F
    for test, code in cases:
        out = out.when(test, code)
    return out.otherwise(F.lit(None).cast("string"))


def ihdr(data: Column) -> Column:
    return F.struct(
        u32(data, 0).alias("width"), u32(data, 4).alias("height"), u8(data, 8).cast("tinyint").alias("bit_depth"),
        u8(data, 9).cast("tinyint").alias("color_type"), (u8(data, 12) == 1).alias("interlace"),
    )


def color_name(color_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in ((0, "Grey"), (2, "Rgb"), (3, "Palette"), (4, "GreyAlpha"), (6, "Rgba")) for x in (k, v)]), color_type.cast("int"))


def ihdr_error(data: Column) -> Column:
    depth, color = u8(data, 8), u8(data, 9)
    legal = color.isin(0, 3) & depth.isin(1, 2, 4, 8) | color.isin(0, 2, 4, 6) & depth.isin(8, 16)
    return _error(
        (F.octet_length(data) != 13, "ChunkLength"), ((u32(data, 0) == 0) | (u32(data, 4) == 0), "ImageDimensions"),
        (~depth.between(1, 16), "BitDepth"), (~color.isin(0, 2, 3, 4, 6), "ColorType"), (~legal, "ColorMode"),
        (u8(data, 10) != 0, "CompressionMethod"), (u8(data, 11) != 0, "FilterMethod"), (u8(data, 12) > 1, "InterlaceMethod"),
    )


def plte(data: Column) -> Column:
    n = F.floor(F.octet_length(data) / 3).cast("int")
    rgb = lambda i: F.struct(*[u8(data, i * 3 + k).cast("smallint").alias(c) for k, c in enumerate("rgb")])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), rgb)).otherwise(F.array().cast("array<struct<r:smallint,g:smallint,b:smallint>>"))


def bkgd(data: Column) -> Column:
    n = F.octet_length(data)
    return F.struct(
        F.when(n == 1, u8(data, 0)).cast("smallint").alias("index"), F.when(n == 2, u16(data, 0)).cast("int").alias("gray"),
        F.when(n == 6, F.array(*[u16(data, k).cast("int") for k in (0, 2, 4)])).alias("rgb"),
    )


def trns(data: Column, has_palette: Column) -> Column:
    n = F.octet_length(data)
    alphas = F.transform(F.sequence(F.lit(0), n - 1), lambda i: u8(data, i).cast("smallint"))
    return F.struct(
        F.when(has_palette & (n > 0), alphas).alias("alphas"), F.when(~has_palette & (n == 6), F.array(*[u16(data, k).cast("int") for k in (0, 2, 4)])).alias("rgb_key"),
        F.when(~has_palette & (n == 2), u16(data, 0)).cast("int").alias("gray_key"),
    )


def phys(data: Column) -> Column:
    return F.struct(u32(data, 0).alias("ppu_x"), u32(data, 4).alias("ppu_y"), (u8(data, 8) == 1).alias("is_meter"))


def time(data: Column) -> Column:
    """As written, and as a timestamp: null for what is no date."""
    parts = [u16(data, 0), *(u8(data, k) for k in range(2, 7))]
    names = ("year", "month", "day", "hour", "minute", "second")
    return F.struct(*[p.cast("int").alias(n) for p, n in zip(parts, names)], F.try_make_timestamp(*[p.cast("int") for p in parts]).alias("ts"))


def _utf8(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def _sub(data: Column, start: Column, n: Column | None = None) -> Column:
    return F.substring(data, start + 1, n if n is not None else F.octet_length(data))


def text(name: Column, data: Column) -> Column:
    """key, val, langtag, transkey, compressed, body: body has the bytes to inflate where compressed is true."""
    end = F.call_function("locate", F.lit(NUL), F.decode(data, "ISO-8859-1"), F.lit(1)) - 1
    key = _utf8(_sub(data, F.lit(0), end))
    latin = F.decode(data, "ISO-8859-1")
    lang_end = F.call_function("locate", F.lit(NUL), latin, end + 4) - 1
    trans_end = F.call_function("locate", F.lit(NUL), latin, lang_end + 2) - 1
    packed = F.when(name == "zTXt", True).when(name == "iTXt", u8(data, end + 1) != 0).otherwise(False)
    body = F.when(name == "tEXt", _sub(data, end + 1)).when(name == "zTXt", _sub(data, end + 2)).otherwise(_sub(data, trans_end + 1))
    is_text, intl = name.isin("tEXt", "zTXt", "iTXt"), name == "iTXt"
    out = F.struct(
        key.alias("key"), F.when(~packed, _utf8(body)).alias("val"), F.when(intl, _utf8(_sub(data, end + 3, lang_end - end - 3))).alias("langtag"),
        F.when(intl, _utf8(_sub(data, lang_end + 1, trans_end - lang_end - 1))).alias("transkey"), packed.alias("compressed"), F.when(packed, body).alias("body"),
    )
    return F.when(is_text & (end > 0), out)


def text_error(name: Column, data: Column) -> Column:
    """What is wrong before anything is inflated, in the order of the decoder; a zTXt's key is looked at after that
    (late_text_error)."""
    latin, n = F.decode(data, "ISO-8859-1"), F.octet_length(data)
    nul = lambda start: F.call_function("locate", F.lit(NUL), latin, start) - 1
    end = nul(F.lit(1))
    lang_end = nul(end + 4)
    no_nuls = (lang_end < 0) | (nul(lang_end + 2) < 0)
    packed, intl = name == "zTXt", name == "iTXt"
    return _error(
        (end < 0, "TextLength"), (packed & (n < end + 2), "TextLength"), (packed & (u8(data, end + 1) != 0), "CompressionMethod"),
        (~packed & ~end.between(1, 79), "KeySize"), (intl & (n < end + 3), "TextLength"), (intl & (u8(data, end + 2) != 0), "CompressionMethod"),
        (intl & no_nuls, "TextLength"),
    )


def late_text_error(name: Column, data: Column) -> Column:
    """What is wrong with a zTXt whose text could be inflated."""
    end = F.call_function("locate", F.lit(NUL), F.decode(data, "ISO-8859-1"), F.lit(1)) - 1
    return F.when((name == "zTXt") & (end >= 0) & ~end.between(1, 79), "KeySize")


@F.arrow_udf(T.StructType([T.StructField("val", T.StringType()), T.StructField("error", T.StringType())]))
def inflate_text(body: pa.Array) -> pa.Array:
    """The text of zlib streams, or the code of what is wrong; null for null."""
    from ..kernels import inflate

    parts, val, error, size = [], [], [], 0

    def close():
        absent = pa.array([v is None and e is None for v, e in zip(val, error)], pa.bool_())
        parts.append(pa.StructArray.from_arrays([pa.array(val, pa.string()), pa.array(error, pa.string())], ["val", "error"], mask=absent))
        val.clear(), error.clear()

    for x in body:  # of many texts those of 4 MB at a time are Python's
        x, v, e = x.as_py(), None, None
        try:
            v = None if x is None else inflate(x).decode("utf-8", "replace")
        except PngError as wrong:
            e = wrong.code
        val.append(v), error.append(e)
        size += len(v or "")
        if size > 4 << 20:
            close()
            size = 0
    close()
    return pa.concat_arrays(parts)


@F.arrow_udf(T.BinaryType())
def deflate_bytes(data: pa.Array) -> pa.Array:
    """zlib streams of bytes."""
    from ..kernels import deflate

    return pa.array([None if x is None else deflate(x) for x in data.to_pylist()], pa.binary())


def error(name: Column, data: Column, has_palette: Column) -> Column:
    """The code of what is wrong with a chunk's fields; null if nothing is, or the kind is not known."""
    n = F.octet_length(data)
    return (
        F.when(name == "IHDR", ihdr_error(data))
        .when(name == "PLTE", _error((n % 3 != 0, "Crc32")))
        .when(name == "IEND", _error((n != 0, "ChunkLength")))
        .when(name == "bKGD", _error((~n.isin(1, 2, 6), "ChunkLength")))
        .when(name == "tRNS", _error((~has_palette & ~n.isin(2, 6), "ChunkLength")))
        .when(name == "pHYs", _error((n != 9, "ChunkLength"), (u8(data, 8) > 1, "PhysUnits")))
        .when(name == "tIME", _error((n != 7, "ChunkLength")))
        .when(name.isin("tEXt", "zTXt", "iTXt"), F.coalesce(text_error(name, data), late_text_error(name, data)))
    )


# Writers: the data of a chunk of each kind.


def write_ihdr(width: Column, height: Column, depth: Column, color: Column, interlace: Column) -> Column:
    return F.concat(put(width, 4), put(height, 4), put(depth, 1), put(color, 1), put(F.lit(0), 2), put(interlace.cast("int"), 1))


def write_bytes(values: Column, n: int = 1) -> Column:
    """Numbers of n bytes each: a palette's colours, alphas, keys, backgrounds."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2 * n, "0")), ""))


def write_phys(x: Column, y: Column, is_meter: Column) -> Column:
    return F.concat(put(x, 4), put(y, 4), put(is_meter.cast("int"), 1))


def write_time(year: Column, *rest: Column) -> Column:
    return F.concat(put(year, 2), *[put(x, 1) for x in rest])


def write_text(key: Column, val: Column) -> Column:
    """Null for a keyword that is not of 1 to 79 bytes."""
    return F.when(F.octet_length(key).between(1, 79), F.concat(F.encode(key, "UTF-8"), F.unhex(F.lit("00")), F.encode(val, "UTF-8")))


def write_ztxt(key: Column, val: Column) -> Column:
    return F.when(F.octet_length(key).between(1, 79), F.concat(F.encode(key, "UTF-8"), F.unhex(F.lit("0000")), deflate_bytes(F.encode(val, "UTF-8"))))


def write_itxt(key: Column, langtag: Column, transkey: Column, val: Column, compressed: bool = False) -> Column:
    nul, body = F.unhex(F.lit("00")), F.encode(val, "UTF-8")
    parts = [F.encode(key, "UTF-8"), F.unhex(F.lit("000100" if compressed else "000000")), F.encode(langtag, "UTF-8"), nul, F.encode(transkey, "UTF-8"), nul]
    return F.when(F.octet_length(key).between(1, 79), F.concat(*parts, deflate_bytes(body) if compressed else body))
