"""Media columns: lossless WebP.

decode_column() turns a column of WebP files into pixel arrays, encode_column() writes pixels back; files that can't be
decoded get an error and no pixels. store_bytes() keeps any bytes as grey 8-bit pixels of WebP files, which is how the
query stores texts.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import webp
from .common import table

ROW = 192
ROWS = 4096  # of one file; longer payloads are several files, one after the other


def decode_column(df: DataFrame, media_col: str, to: str = "image") -> DataFrame:
    """df with `to` (replaced if it is there): width, height, pixels (RGBA bytes, row by row), error. Null media give a
    null; what is no lossless WebP gives an error and no pixels. Other columns and repeated rows stay as they are."""
    rows = df.drop(to) if to in df.columns else df
    at = rows.columns.index(media_col)
    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])
    parts = (("width", T.IntegerType()), ("height", T.IntegerType()), ("pixels", T.BinaryType()), ("error", T.StringType()))
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.StructType([T.StructField(*p) for p in parts]))])

    def one(data):
        if data is None:
            return None
        try:
            x = webp.decode(data)
        except (webp.WebpError, ValueError, IndexError, MemoryError) as e:
            return {"width": None, "height": None, "pixels": None, "error": str(e) or type(e).__name__}
        b = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]].tobytes()
        return {"width": x.shape[1], "height": x.shape[0], "pixels": b, "error": None}

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # pixels are larger than files
                part = batch.slice(k, 64)
                images = [one(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(images, kind)], [*part.schema.names, to])

    return rows.mapInArrow(run, schema)


def encode_column(df: DataFrame, width_col: str, height_col: str, pixels_col: str, to: str = "media") -> DataFrame:
    """df with `to`: the RGBA pixels as a WebP file; null where a part is null or the sizes don't fit the pixels."""
    rows = df.drop(to) if to in df.columns else df
    at = [rows.columns.index(c) for c in (width_col, height_col, pixels_col)]
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.BinaryType())])

    def one(w, h, p):
        if None in (w, h, p) or not (0 < w <= webp.MAX_SIDE and 0 < h <= webp.MAX_SIDE) or len(p) != 4 * w * h:
            return None
        bgra = np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]])
        return webp.encode(bgra.reshape(h, 4 * w).view(np.uint32))

    def run(batches):
        for batch in batches:
            out = [one(*x) for x in zip(*(batch.column(k).to_pylist() for k in at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, to])

    return rows.mapInArrow(run, schema)


def store_bytes(payload: bytes) -> bytes:
    """A positive multiple of ROW bytes as WebP files, ROW pixels wide."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return b"".join(webp.encode_grey(x[k : k + ROWS]) for k in range(0, len(x), ROWS))


def load_bytes(media: bytes) -> bytes:
    """What store_bytes() got, read from the files."""
    parts, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        parts.append((webp.decode(media[at : at + size]) & np.uint32(255)).astype(np.uint8).tobytes())
        at += size
    return b"".join(parts)


def features(samples: bytes) -> str:
    """Rows, sum and sum of squares, number of values, the commonest value and counts by eighths of the range."""
    x = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    v = np.arange(256)
    eighths = "/".join(map(str, x.reshape(8, 32).sum(1).tolist()))
    return f"{len(samples) // ROW}x{ROW}:{int(x @ v)}:{int(x @ (v * v))}:{int((x > 0).sum())}:{int(x.argmax())}:{eighths}"


FACTS = [
    T.StructField(name, kind())
    for name, kind in (
        ("n_bytes", T.LongType), ("payload_bytes", T.LongType), ("payload_sha256", T.StringType), ("tail_crc32", T.LongType),
        ("media_bytes", T.LongType), ("media_sha256", T.StringType), ("feature", T.StringType),
    )
]


def stored_facts(text: str | None) -> tuple:
    data = (text or "").encode()
    media = store_bytes(data + b" " * (-len(data) % ROW or (0 if data else ROW)))
    back = load_bytes(media)
    return (
        len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media),
        hashlib.sha256(media).hexdigest(), features(back),
    )


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col and what was read back of its text's stored form. A null text is empty, an empty one a
    row of spaces; repeated rows have equal values; other columns are ignored."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([rows.schema[id_col], *FACTS])

    def run(batches):
        for batch in batches:
            facts = list(zip(*map(stored_facts, batch.column(1).to_pylist()))) or [()] * len(FACTS)
            types = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in FACTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(facts, types))], schema.names)

    return rows.mapInArrow(run, schema)


def op10_media(spark, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
