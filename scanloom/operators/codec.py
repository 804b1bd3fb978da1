"""Decoding and encoding of images, in Arrow batches of a few MB."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import kernels
from ..errors import PngError
from ..functions import binary, parsers

_RGB = T.StructType([T.StructField(c, T.ShortType()) for c in "rgb"])
_ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("detail", T.StringType())])
_TIME = ("year", "month", "day", "hour", "minute", "second")
IMAGE = T.StructType(
    [
        T.StructField("frame_idx", T.IntegerType()), T.StructField("delay", T.LongType()), T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()), T.StructField("bit_depth", T.ByteType()), T.StructField("color_type", T.ByteType()),
        T.StructField("interlace", T.BooleanType()), T.StructField("channels", T.ByteType()), T.StructField("samples", T.BinaryType()),
        T.StructField("palette", T.ArrayType(_RGB)), T.StructField("alphas", T.ArrayType(T.ShortType())), T.StructField("key", T.ArrayType(T.IntegerType())),
        T.StructField("background", T.ArrayType(T.IntegerType())),
        T.StructField("physical", T.StructType([T.StructField("ppu_x", T.LongType()), T.StructField("ppu_y", T.LongType()), T.StructField("is_meter", T.BooleanType())])),
        T.StructField("time", T.StructType([T.StructField(n, T.IntegerType()) for n in _TIME])),
        T.StructField("text", T.MapType(T.StringType(), T.StringType())), T.StructField("error", _ERROR), T.StructField("warning", T.StringType()),
    ]
)


def _row(f) -> dict:
    """A frame as a row. Samples are a byte each, of 16 bits two, the high one first."""
    h = f.header
    out = {
        "frame_idx": f.index, "delay": 0, "width": h.get("width"), "height": h.get("height"), "bit_depth": h.get("bit_depth"),
        "color_type": h.get("color_type"), "interlace": h.get("interlace"), "channels": kernels.CHANNELS.get(h.get("color_type")),
        "error": {"code": f.error.code, "detail": f.error.detail} if f.error else None, "warning": f.warning,
    }
    if f.samples is None or f.error:
        return out
    s = f.samples
    pal = np.frombuffer(f.palette, np.uint8).reshape(-1, 3).tolist() if f.palette is not None else None
    return out | {
        "samples": (s.astype(">u2") if s.dtype == np.uint16 else s).tobytes(), "palette": [dict(zip("rgb", c)) for c in pal] if pal is not None else None,
        "alphas": list(f.alphas) if f.alphas is not None else None, "key": list(f.key) if f.key else None,
        "background": list(f.background) if f.background else None, "physical": f.physical, "time": f.time, "text": list(f.text.items()),
    }


def decode_png(
    images: DataFrame, id_col: str = "image_id", content_col: str = "content", strict: bool = False,
    max_pixels: int = kernels.MAX_PIXELS, max_inflated: int = kernels.MAX_INFLATED, batch: int = 64,
) -> DataFrame:
    """One row per frame with id_col and the fields of IMAGE. What is wrong with a file is one row with its error, after
    the frames that were complete; no file ends the job. strict is the behaviour of a decoder that takes depths of 8 and
    16 only, refuses unknown chunks after image data and reads texts byte by byte. A null file has no rows.

    Files go to the kernels `batch` at a time: those of one shape are unfiltered together.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = images.select(F.col(id_col), F.col(content_col))
    schema = T.StructType([rows.schema[id_col], *IMAGE.fields])
    arrow = to_arrow_type(IMAGE)

    def run(batches):
        from ..frames import decode

        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                part = whole.slice(k, batch)
                found = decode(part.column(1).to_pylist(), strict, max_pixels, max_inflated)
                at = [i for i, fs in enumerate(found) for _ in fs]
                table = pa.array([_row(f) for fs in found for f in fs], arrow)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *table.flatten()], schema.names)

    return rows.mapInArrow(run, schema)


def headers(images: DataFrame, id_col: str = "image_id", content_col: str = "content") -> DataFrame:
    """id_col, width, height, bit_depth, color_type, interlace, error: from the first 29 bytes of each file, without Python."""
    c = F.col(content_col)
    data = F.substring(c, 17, 13)
    wrong = F.coalesce(
        binary.signature_error(c), F.when(F.octet_length(c) == 8, "Empty").when(F.octet_length(c) < 33, "Io"),
        F.when(F.hex(F.substring(c, 13, 4)) != "49484452", "ChunkOrder"), parsers.ihdr_error(data),
    )
    return images.select(id_col, F.when(wrong.isNull(), parsers.ihdr(data)).alias("h"), wrong.alias("error")).select(id_col, "h.*", "error")


def encode_png(
    images: DataFrame, id_col: str = "image_id", filter_strategy: str | None = None, compression_level: int = 6, interlace: bool = False,
    strict: bool = False, batch: int = 64,
) -> DataFrame:
    """(id_col, width, height, color_type, bit_depth, samples, and for palettes palette, alphas) -> id_col, content, error.

    palette is an array of (r, g, b), alphas an array; columns that are missing are taken as null. Each row is a file of
    its own. What can't be encoded has a null content and a code; a null part is ShortData.
    """
    if filter_strategy not in (None, *kernels.STRATEGIES):
        raise ValueError(f"filter_strategy is one of {', '.join(kernels.STRATEGIES)}")
    if not 0 <= compression_level <= 10:
        raise ValueError("compression_level is 0 to 10")
    cols = ["width", "height", "color_type", "bit_depth", "samples"]
    extra = [F.col(c) if c in images.columns else F.lit(None).alias(c) for c in ("palette", "alphas")]
    pal = F.when(extra[0].isNotNull(), parsers.write_bytes(F.flatten(F.transform(extra[0], lambda p: F.array(p["r"], p["g"], p["b"]))))) if "palette" in images.columns else F.lit(None).cast("binary")
    alphas = F.when(extra[1].isNotNull(), parsers.write_bytes(extra[1])) if "alphas" in images.columns else F.lit(None).cast("binary")
    rows = images.select(F.col(id_col), *[F.col(c).cast("long").alias(c) for c in cols[:4]], "samples", pal.alias("palette"), alphas.alias("alphas"))
    schema = T.StructType([rows.schema[id_col], T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                part = whole.slice(k, batch)
                items = list(zip(*(part.column(i).to_pylist() for i in range(1, 8))))
                content, error = [None] * len(items), [None] * len(items)
                alike = defaultdict(list)
                for i, (w, h, c, d, s, p, a) in enumerate(items):
                    size = None if None in (w, h, c, d, s) else w * h * kernels.CHANNELS.get(c, 0) * (2 if d == 16 else 1)
                    if size != (None if s is None else len(s)) or size is None:
                        error[i] = "ShortData" if c in kernels.CHANNELS or c is None else "ColorMode"
                    else:
                        alike[w, h, c, d, p, a].append(i)
                for (w, h, c, d, p, a), own in alike.items():
                    kind = ">u2" if d == 16 else np.uint8
                    try:
                        x = np.stack([np.frombuffer(items[i][4], kind) for i in own]).reshape(len(own), h, w, kernels.CHANNELS[c])
                        for i, png in zip(own, kernels.encode_images(x, c, d, interlace, filter_strategy, compression_level, p, a, strict)):
                            content[i] = png
                    except PngError as e:
                        for i in own:
                            error[i] = e.code
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary()), pa.array(error, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def sample(samples: Column, k: Column, depth: Column) -> Column:
    """The k-th sample (from 0) of packed samples."""
    return F.when(depth == 16, binary.u16(samples, k * 2)).otherwise(binary.u8(samples, k)).cast("int")
