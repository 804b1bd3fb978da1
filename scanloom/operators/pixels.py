"""Pixels as rows: explode and collect, palettes, colour conversion, Adam7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import pyarrow as pa

ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def explode_pixels(images: DataFrame, id_col: str = "image_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per pixel of each frame without error: id_col, keep, frame_idx, y, x, c0 to c3 (null where a channel is not
    there; grey and index in c0)."""
    import numpy as np

    cols = [id_col, *keep, "frame_idx", "width", "height", "bit_depth", "channels", "samples"]
    rows = images.filter("error IS NULL AND samples IS NOT NULL").select(*cols)
    n = 1 + len(keep)
    fields = [rows.schema[c] for c in (id_col, *keep, "frame_idx")] + [T.StructField(c, T.IntegerType()) for c in ("y", "x", "c0", "c1", "c2", "c3")]
    schema = T.StructType(fields)

    def run(batches):
        for batch in batches:
            widths, heights, depths, channels, samples = (batch.column(n + 1 + k) for k in range(5))
            for k in range(batch.num_rows):
                w, h, c = widths[k].as_py(), heights[k].as_py(), channels[k].as_py()
                x = np.frombuffer(samples[k].as_buffer(), ">u2" if depths[k].as_py() == 16 else np.uint8).reshape(-1, c).astype(np.int32)
                for lo in range(0, w * h, 1 << 16):
                    part = x[lo : lo + (1 << 16)]
                    m = len(part)
                    at = np.arange(lo, lo + m, dtype=np.int64)
                    same = [batch.column(i).take(pa.array(np.full(m, k))) for i in range(n + 1)]
                    own = [pa.array(np.ascontiguousarray(part[:, i])) if i < c else pa.nulls(m, pa.int32()) for i in range(4)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array((at // w).astype(np.int32)), pa.array((at % w).astype(np.int32)), *own], schema.names)

    return rows.mapInArrow(run, schema)


def collect_pixels(pixels: DataFrame, id_col: str = "image_id", channels: int = 1, depth: int = 8) -> DataFrame:
    """Pixels (y, x, c0...) -> one image per id: width, height, samples. One image's pixels meet in one row."""
    digits = 4 if depth == 16 else 2
    value = F.concat(*[F.lpad(F.hex(F.col(f"c{k}").cast("long")), digits, "0") for k in range(channels)])
    g = pixels.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("y", "x", value.alias("v")))).alias("p"), F.max("x").alias("mx"), F.max("y").alias("my"))
    return g.select(id_col, (F.col("mx") + 1).cast("long").alias("width"), (F.col("my") + 1).cast("long").alias("height"), F.unhex(F.array_join(F.col("p.v"), "")).alias("samples"))


def palette_table(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Palettes as rows: id_col, idx, r, g, b, a; alpha is 255 where the file has none."""
    p = images.filter("palette IS NOT NULL").select(id_col, "alphas", F.posexplode("palette").alias("idx", "c"))
    alpha = F.coalesce(F.try_element_at("alphas", F.col("idx") + 1), F.lit(255).cast("smallint"))
    return p.select(id_col, "idx", "c.r", "c.g", "c.b", alpha.alias("a"))


def expand_palette(pixels: DataFrame, palettes: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Index pixels -> RGBA pixels, by a join; an index that the palette lacks gets the error PaletteIndex. Spark sends
    palettes to all executors only if they are below its threshold."""
    p = palettes.withColumnRenamed("idx", "c0")
    out = pixels.drop("c1", "c2", "c3").join(p, [id_col, "c0"], "left")
    return out.select(
        *[c for c in pixels.columns if c not in ("c0", "c1", "c2", "c3")], *[F.col(v).cast("int").alias(f"c{k}") for k, v in enumerate("rgba")],
        F.when(F.col("r").isNull(), "PaletteIndex").alias("error"),
    )


# Colour conversion. Rules of this engine: 16 bits to 8 is v * 255 / 65535, rounded half up; 8 to 16 is v * 257; grey to
# RGB repeats the value; RGB to grey is (299 R + 587 G + 114 B + 500) / 1000, floored; a new alpha is opaque, and an
# alpha that goes is dropped.


def to_8(v: Column) -> Column:
    return F.floor((v + 128) / 257).cast("int")


def to_16(v: Column) -> Column:
    return (v * 257).cast("int")


def to_grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")


def convert(pixels: DataFrame, source: str, target: str, depth: int = 8, to_depth: int = 8) -> DataFrame:
    """pixels of one colour kind (grey, greyalpha, rgb, rgba) as another, at another depth if asked for."""
    has = {"grey": (False, False), "greyalpha": (False, True), "rgb": (True, False), "rgba": (True, True)}
    (colour, alpha), (to_colour, to_alpha) = has[source], has[target]
    c = [F.col(f"c{k}") for k in range(4)]
    scale = to_8 if (depth, to_depth) == (16, 8) else to_16 if (depth, to_depth) == (8, 16) else lambda v: v
    body = c[:3] if colour else c[:1]
    a = (c[3] if colour else c[1]) if alpha else F.lit((1 << depth) - 1)
    if colour and not to_colour:
        body = [to_grey(*body)]
    elif to_colour and not colour:
        body = body * 3
    out = [scale(v) for v in [*body, *([a] if to_alpha else [])]]
    out += [F.lit(None).cast("int")] * (4 - len(out))
    return pixels.select(*[x for x in pixels.columns if x not in ("c0", "c1", "c2", "c3")], *[v.cast("int").alias(f"c{k}") for k, v in enumerate(out)])


# Adam7


def pass_of(x: Column, y: Column) -> Column:
    """The pass (0 to 6) that has the pixel."""
    return (
        F.when((x % 8 == 0) & (y % 8 == 0), 0).when((x % 8 == 4) & (y % 8 == 0), 1).when((x % 4 == 0) & (y % 8 == 4), 2)
        .when((x % 4 == 2) & (y % 4 == 0), 3).when((x % 2 == 0) & (y % 4 == 2), 4).when((x % 2 == 1) & (y % 2 == 0), 5).otherwise(6)
    )


def _pick(p: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), p.cast("int") + 1)


def interlace(pixels: DataFrame) -> DataFrame:
    """Adds pass, px and py: where each pixel is in the reduced images."""
    p = pass_of(F.col("x"), F.col("y"))
    x0, y0, dx, dy = ([a[k] for a in ADAM7] for k in range(4))
    out = pixels.withColumn("pass", p)
    q = F.col("pass")
    px = ((F.col("x") - _pick(q, x0)) / _pick(q, dx)).cast("int")
    py = ((F.col("y") - _pick(q, y0)) / _pick(q, dy)).cast("int")
    return out.withColumn("px", px).withColumn("py", py)


def deinterlace(pixels: DataFrame) -> DataFrame:
    """(pass, px, py, ...) -> (y, x, ...)."""
    x0, y0, dx, dy = ([a[k] for a in ADAM7] for k in range(4))
    q = F.col("pass")
    out = pixels.withColumn("x", F.col("px") * _pick(q, dx) + _pick(q, x0)).withColumn("y", F.col("py") * _pick(q, dy) + _pick(q, y0))
    return out.drop("pass", "px", "py")


def pass_sizes(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(id_col, width, height) -> id_col, pass, w, h for the seven passes; both are 0 if one is."""
    spec = F.array(*[F.struct(F.lit(k).alias("pass"), *[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "dx", "dy"), a)]) for k, a in enumerate(ADAM7)])
    p = images.select(id_col, "width", "height", F.explode(spec).alias("p")).select(id_col, "width", "height", "p.*")
    w = F.greatest(F.ceil((F.col("width") - F.col("x0")) / F.col("dx")), F.lit(0)).cast("long")
    h = F.greatest(F.ceil((F.col("height") - F.col("y0")) / F.col("dy")), F.lit(0)).cast("long")
    none = (w == 0) | (h == 0)
    return p.select(id_col, "pass", F.when(none, 0).otherwise(w).alias("w"), F.when(none, 0).otherwise(h).alias("h"))


# Bits


def unpack_bits(rows: DataFrame, depth: int, value: str = "v", position: str = "x") -> DataFrame:
    """Bytes at `position` of a row -> samples of `depth` bits, the high ones first; `position` counts samples then."""
    per = 8 // depth
    out = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    v = F.expr(f"shiftright({value}, 8 - {depth} * (__k + 1)) & {(1 << depth) - 1}")
    return out.withColumn(value, v.cast("int")).withColumn(position, F.col(position) * per + F.col("__k")).drop("__k")


def pack_bits(rows: DataFrame, depth: int, keys: list[str], value: str = "v", position: str = "x") -> DataFrame:
    """The inverse; a last byte that is not full ends in 0 bits."""
    per = 8 // depth
    byte = F.floor(F.col(position) / per).cast("int").alias(position)
    shifted = F.expr(f"shiftleft({value}, {8 - depth} - {depth} * pmod({position}, {per}))")
    return rows.groupBy(*keys, byte).agg(F.sum(shifted).cast("int").alias(value))
