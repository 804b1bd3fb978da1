"""PNG files as chunks, and chunks as PNG files."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import binary, parsers

PART_BYTES = 4 << 20  # of files whose chunks are made together
CHUNK = T.StructType(
    [
        T.StructField("chunk_idx", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("name", T.StringType()),
        T.StructField("length", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("crc_stored", T.LongType()),
        T.StructField("error", T.StructType([T.StructField("code", T.StringType()), T.StructField("detail", T.StringType())])),
    ]
)
_ARROW = pa.struct(
    [
        ("chunk_idx", pa.int32()), ("offset", pa.int64()), ("name", pa.string()), ("length", pa.int64()), ("data", pa.binary()),
        ("crc_stored", pa.int64()), ("error", pa.struct([("code", pa.string()), ("detail", pa.string())])),
    ]
)


def split_chunks(images: DataFrame, id_col: str = "image_id", content_col: str = "content", with_data: bool = True) -> DataFrame:
    """One row per chunk: id_col, chunk_idx, offset, name, length, data, crc_stored, error, crc_calc. No pixel is decoded.

    An error of the framing ends a file with one row that has it (Io, InvalidSignature, ChunkLength); a null file has no
    rows. Chunks after the end chunk are rows too. without data, rows are small and crc_calc is null.
    """
    rows = images.select(F.col(id_col), F.col(content_col))
    schema = T.StructType([rows.schema[id_col], *CHUNK.fields])

    def run(batches):
        from ..frames import split

        def parts(batch):
            """Runs of rows of PART_BYTES of files, or one larger file."""
            start, size = 0, 0
            for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                if k > start and size + (n or 0) > PART_BYTES:
                    yield batch.slice(start, k - start)
                    start, size = k, 0
                size += n or 0
            yield batch.slice(start)

        for part in (part for batch in batches for part in parts(batch)):
            ids, out = part.column(0), []
            at = []
            for k, content in enumerate(part.column(1).to_pylist()):
                for index, offset, name, length, data, stored, _, error in split(content) if content is not None else ():
                    at.append(k)
                    out.append({
                        "chunk_idx": index, "offset": offset, "name": name, "length": length, "data": data if with_data else None,
                        "crc_stored": stored, "error": {"code": error.code, "detail": error.detail} if error else None,
                    })
            table = pa.array(out, _ARROW)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *table.flatten()], schema.names)

    chunks = rows.mapInArrow(run, schema)
    return chunks.withColumn("crc_calc", F.when(F.col("data").isNotNull(), binary.crc32(F.col("name"), F.col("data"))))


def in_order(id_col: str = "image_id"):
    return Window.partitionBy(id_col).orderBy("chunk_idx")


def has_palette(id_col: str = "image_id") -> Column:
    """Whether a palette came before this chunk."""
    before = in_order(id_col).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.col("name") == "PLTE").over(before), F.lit(False))


def typed_chunks(chunks: DataFrame, id_col: str = "image_id") -> DataFrame:
    """chunks with a nullable struct per kind and parse_error: an error of the fields goes before one of the checksum."""
    name, data = F.col("name"), F.col("data")
    out = chunks.withColumn("has_palette", has_palette(id_col))
    only = lambda kind, x: F.when(name == kind, x)
    out = out.withColumn(
        "parse_error",
        F.coalesce(F.col("error.code"), parsers.error(name, data, F.col("has_palette")), F.when(F.col("crc_stored") != F.col("crc_calc"), "Crc32")),
    )
    return out.select(
        "*", only("IHDR", parsers.ihdr(data)).alias("header"), only("PLTE", parsers.plte(data)).alias("palette"), only("bKGD", parsers.bkgd(data)).alias("background"),
        only("tRNS", parsers.trns(data, F.col("has_palette"))).alias("transparency"), only("pHYs", parsers.phys(data)).alias("physical"),
        only("tIME", parsers.time(data)).alias("time"), parsers.text(name, data).alias("text"),
    )


def text_table(chunks: DataFrame, id_col: str = "image_id") -> DataFrame:
    """id_col, chunk_idx, kind, key, val, langtag, transkey, compressed, error: one row per text chunk."""
    t = chunks.filter(F.col("name").isin("tEXt", "zTXt", "iTXt")).withColumn("t", parsers.text(F.col("name"), F.col("data")))
    t = t.withColumn("wrong", parsers.text_error(F.col("name"), F.col("data"))).withColumn("inflated", parsers.inflate_text(F.col("t.body")))
    return t.select(
        id_col, "chunk_idx", F.col("name").alias("kind"), "t.key", F.coalesce("t.val", "inflated.val").alias("val"), "t.langtag", "t.transkey",
        "t.compressed", F.coalesce("wrong", "inflated.error", parsers.late_text_error(F.col("name"), F.col("data"))).alias("error"),
    )


def last_text(texts: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Of each key of an image the last value, whichever kind of chunk it is from."""
    return texts.filter("error IS NULL").groupBy(id_col, "key").agg(F.max_by("val", "chunk_idx").alias("val"))


def idat_runs(chunks: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Runs of consecutive image data: id_col, frame_idx, first_chunk, n_chunks, n_bytes. Each run is a frame."""
    order = in_order(id_col)
    d = chunks.select(id_col, "chunk_idx", "name", "length").filter("name = 'IDAT'").withColumn("island", F.col("chunk_idx") - F.row_number().over(order))
    runs = d.groupBy(id_col, "island").agg(F.min("chunk_idx").alias("first_chunk"), F.count(F.lit(1)).alias("n_chunks"), F.sum("length").alias("n_bytes"))
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("first_chunk")) - 1
    return runs.select(id_col, number.alias("frame_idx"), "first_chunk", "n_chunks", "n_bytes")


def duplicate_chunks(chunks: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Kinds that may be there once and are there more often."""
    once = ("IHDR", "PLTE", "bKGD", "tRNS", "pHYs", "tIME", "IEND")
    return chunks.filter(F.col("name").isin(*once)).groupBy(id_col, "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def order_violations(chunks: DataFrame, id_col: str = "image_id", strict: bool = False) -> DataFrame:
    """id_col, chunk_idx, name, code: the first chunk of each image that is where it must not be; images in order have no
    row. With strict, an unknown chunk after image data counts."""
    c = chunks.select(id_col, "chunk_idx", "name")
    order = in_order(id_col)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda *names: F.coalesce(F.max(F.col("name").isin(*names)).over(before), F.lit(False))
    same = Window.partitionBy(id_col, "name").orderBy("chunk_idx")
    c = c.withColumn("nth", F.row_number().over(same)).withColumn("first", F.row_number().over(order) == 1).withColumn("last", F.lead("name").over(order).isNull())
    c = c.withColumn("data", seen("IDAT")).withColumn("colours", seen("bKGD", "tRNS")).withColumn("ended", seen("IEND"))
    name = F.col("name")
    known = ("IHDR", "PLTE", "IDAT", "IEND", "bKGD", "tRNS", "pHYs", "tIME", "tEXt", "zTXt", "iTXt")
    code = (
        F.when(F.col("ended"), F.lit(None).cast("string"))  # what follows the end is a warning
        .when(F.col("first") & (name != "IHDR"), "ChunkOrder").when(~F.col("first") & (name == "IHDR"), "ChunkOrder")
        .when(name.isin("PLTE", "bKGD", "pHYs", "tRNS") & F.col("data"), "ChunkOrder").when((name == "PLTE") & F.col("colours"), "ChunkOrder")
        .when(name.isin("PLTE", "bKGD", "pHYs", "tIME", "tRNS") & (F.col("nth") > 1), "Multiple")
        .when((name == "IEND") & ~F.col("data"), "NoImageData").when(F.lit(strict) & F.col("data") & ~name.isin(*known), "UnknownChunkType")
        .when(F.col("last") & (name != "IEND"), "NoImageData")
    )
    bad = c.withColumn("code", code).filter("code IS NOT NULL")
    return bad.groupBy(id_col).agg(F.min(F.struct("chunk_idx", "name", "code")).alias("v")).select(id_col, "v.chunk_idx", "v.name", "v.code")


def assemble(chunks: DataFrame, id_col: str = "image_id", signature: bool = True) -> DataFrame:
    """(id_col, chunk_idx, name, data) -> id_col, content: the chunks in order as one file, of any order and number.
    Image data is taken as compressed already."""
    part = F.struct("chunk_idx", binary.chunk(F.col("name"), F.coalesce("data", F.unhex(F.lit("")))).alias("bytes"))
    g = chunks.groupBy(id_col).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    hexed = F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), "")
    return g.select(id_col, F.unhex(F.concat(F.lit(binary.SIGNATURE if signature else ""), hexed)).alias("content"))
