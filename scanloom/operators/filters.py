"""Row filters and the choice among them as DataFrame operations over bytes as rows (id, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("none", "sub", "up", "average", "paeth")


def neighbours(rows: DataFrame, step: int, id_col: str = "image_id", lane: tuple[str, ...] = ()) -> DataFrame:
    """Adds a (left), b (up), c (up and left); 0 outside. step: bytes of a pixel. One shuffle, by image: rows and columns
    are read in the order of a single sort where that is possible."""
    row = Window.partitionBy(id_col, *lane, "y").orderBy("x")
    column = Window.partitionBy(id_col, *lane, "x").orderBy("y")
    out = rows.repartition(id_col).withColumn("b", F.coalesce(F.lag("v").over(column), F.lit(0)))
    out = out.withColumn("a", F.coalesce(F.lag("v", step).over(row), F.lit(0)))
    return out.withColumn("c", F.coalesce(F.lag("b", step).over(row), F.lit(0)))


def paeth(a: Column, b: Column, c: Column) -> Column:
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - c - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def prediction(kind: int) -> Column:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return (F.lit(0), a, b, F.floor((a + b) / 2).cast("int"), paeth(a, b, c))[kind]


def filtered(kind: int) -> Column:
    """The byte by filter `kind`, over neighbours()."""
    return F.pmod(F.col("v") - prediction(kind) + 256, F.lit(256)).cast("int")


def filter_bytes(rows: DataFrame, kind: int, step: int, id_col: str = "image_id") -> DataFrame:
    """(id, y, x, v) with v filtered."""
    return neighbours(rows, step, id_col).select(id_col, "y", "x", filtered(kind).alias("v"))


def candidates(rows: DataFrame, step: int, id_col: str = "image_id") -> DataFrame:
    """id, y, x, type, s: each byte by each of the five filters."""
    tried = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), filtered(k).alias("s")) for k in range(5)]))
    return neighbours(rows, step, id_col).select(id_col, "y", "x", tried.alias("t")).select(id_col, "y", "x", "t.*")


def costs(tried: DataFrame, strategy: str, id_col: str = "image_id") -> DataFrame:
    """id, y, type, cost of each filter of each row."""
    s = F.col("s")
    if strategy == "zero":
        return tried.groupBy(id_col, "y", "type").agg(F.max("type").cast("double").alias("cost"))
    if strategy == "minsum":
        size = F.when(F.col("type") == 0, s).when(s < 128, s).otherwise(255 - s)
        return tried.groupBy(id_col, "y", "type").agg(F.sum(size).cast("double").alias("cost"))
    # The filter byte counts as a byte of the row.
    own = tried.select(id_col, "y", "type", "s").union(tried.filter("x = 0").select(id_col, "y", "type", F.col("type").alias("s")))
    counts = own.groupBy(id_col, "y", "type", "s").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(id_col, "y", "type"))
    p = F.col("n") / F.col("total")
    return counts.withColumn("total", total).groupBy(id_col, "y", "type").agg(F.round(F.sum(-p * F.log2(p)), 5).alias("cost"))


def choose(cost: DataFrame, id_col: str = "image_id") -> DataFrame:
    """id, y, type, cost: the cheapest of each row, the lowest type of equals."""
    best = F.min(F.struct("cost", "type")).alias("m")
    return cost.groupBy(id_col, "y").agg(best).select(id_col, "y", "m.type", "m.cost")


def auto_strategy(color_type: Column, depth: Column, asked: Column | None = None) -> Column:
    """What is asked for; else zero for palettes and depths below 8, and minsum."""
    own = F.when((color_type == 3) | (depth < 8), "zero").otherwise("minsum")
    return F.coalesce(asked, own) if asked is not None else own


def unfilter_sub(rows: DataFrame, step: int, id_col: str = "image_id") -> DataFrame:
    """Reverses sub: a running sum of each byte lane of a row."""
    w = Window.partitionBy(id_col, "y", F.col("x") % step).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(id_col, "y", "x", (F.sum("v").over(w) % 256).cast("int").alias("v"))


def unfilter_up(rows: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Reverses up, for images all of whose rows use it: a running sum of each column."""
    w = Window.partitionBy(id_col, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(id_col, "y", "x", (F.sum("v").over(w) % 256).cast("int").alias("v"))
