"""Rasters derived from the tables, and PNG files of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers
from ..operators.codec import encode_png
from ..shipping import ship


@dataclass(frozen=True)
class View:
    """How the 64 bytes of a row are an image."""

    color_type: int
    bit_depth: int
    width: int
    height: int
    n_bytes: int = 64


VIEWS = {
    "gray8": View(0, 8, 8, 8), "gray16": View(0, 16, 8, 4), "graya8": View(4, 8, 8, 4), "graya16": View(4, 16, 4, 4),
    "rgb8": View(2, 8, 4, 4, 48), "rgb16": View(2, 16, 4, 2, 48), "rgba8": View(6, 8, 4, 4), "rgba16": View(6, 16, 4, 2),
    "palette": View(3, 8, 8, 8), "gray4": View(0, 4, 16, 8),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_array(embedding: str = "embedding"):
    return F.transform(embedding, lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5))).cast("int"))


def bytes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, b array<int> of 64."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", byte_array().alias("b"))


def grey_rows(spark: SparkSession, sf_dir: str, wrapped: bool = True) -> DataFrame:
    """vec_id, y, x, v: 8 x 8 bytes; wrapped ones use all values, so differences pass 0 and 255."""
    r = bytes_of(spark, sf_dir).select("vec_id", F.posexplode("b").alias("i", "b"))
    y, x = F.floor(F.col("i") / 8).cast("int"), F.col("i") % 8
    v = F.col("b") * 37 + y * 11 + x * 7
    return r.select("vec_id", y.alias("y"), x.alias("x"), (v % 256 if wrapped else F.col("b")).alias("v"))


def palette_column():
    """256 colours by formula: i, 255 - i, i * 7 % 256."""
    i = F.sequence(F.lit(0), F.lit(255))
    return F.transform(i, lambda k: F.struct(k.cast("smallint").alias("r"), (255 - k).cast("smallint").alias("g"), (k * 7 % 256).cast("smallint").alias("b")))


def rasters(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """image_id, label, width, height, color_type, bit_depth, samples, palette, alphas."""
    v = VIEWS[view]
    r = bytes_of(spark, sf_dir)
    if v.bit_depth == 4:
        samples = F.flatten(F.transform("b", lambda b: F.array(F.shiftright(b, 4), b.bitwiseAND(15))))
    else:
        samples = F.slice("b", 1, v.n_bytes)
    pal = palette_column() if v.color_type == 3 else F.lit(None).cast("array<struct<r:smallint,g:smallint,b:smallint>>")
    alphas = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: (k * 2).cast("smallint")) if v.color_type == 3 else F.lit(None).cast("array<smallint>")
    return r.select(
        F.col("vec_id").alias("image_id"), "label", *[F.lit(x).cast("long").alias(n) for n, x in (("width", v.width), ("height", v.height))],
        F.lit(v.color_type).alias("color_type"), F.lit(v.bit_depth).alias("bit_depth"), parsers.write_bytes(samples).alias("samples"), pal.alias("palette"), alphas.alias("alphas"),
    )


def files(spark: SparkSession, sf_dir: str, view: str = "gray8", **options) -> DataFrame:
    """image_id, content, error."""
    return encode_png(rasters(spark, sf_dir, view), **options)
