"""Queries over PNG files made of the tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binary, parsers
from ..operators import chunks as C
from ..operators import codec, filters, pixels
from ..sources import png as source
from ..streaming import ingest
from . import fixtures, rasters
from .rasters import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

R = """WITH r AS (SELECT vec_id, label, i - 1 AS i, CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS INTEGER) AS b
FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS e FROM embeddings)),
m AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST((b * 37 + (i // 8) * 11 + (i % 8) * 7) % 256 AS INTEGER) AS v FROM r)
"""
N = R + """, n AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS a, coalesce(lag(v) OVER (PARTITION BY vec_id, x ORDER BY y), 0) AS b
FROM m), o AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS c FROM n),
f AS (SELECT vec_id, y, x, unnest([0, 1, 2, 3, 4]) AS type, unnest([v, (v - a + 256) % 256, (v - b + 256) % 256, (v - (a + b) // 2 + 256) % 256,
(v - CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END + 256) % 256]) AS s FROM o)
"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# From rasters to files and back


@query("m0_label_mean", R + "SELECT label, CAST(count(DISTINCT vec_id) AS BIGINT) AS images, CAST(sum(b) AS BIGINT) AS sum_b, CAST(sum(b) AS DOUBLE) / count(*) AS mean_b FROM r GROUP BY label")
def m0_label_mean(spark, sf_dir):
    """Rasters to files, files to chunks whose checksums hold, image data to pixels, pixels to means by label."""
    r = rasters.rasters(spark, sf_dir, "gray8").withColumn("image_id", F.struct("image_id", "label"))
    png = codec.encode_png(r, filter_strategy="zero")
    px = pixels.explode_pixels(codec.decode_png(png))
    g = px.groupBy(F.col("image_id.label").alias("label")).agg(
        (F.count(F.lit(1)) / 64).cast("long").alias("images"), F.sum("c0").alias("sum_b"), (F.sum("c0").cast("double") / F.count(F.lit(1))).alias("mean_b")
    )
    return g


def _roundtrip(view: str, interlace: bool = False, strategy: str | None = None):
    def run(spark, sf_dir):
        v = rasters.VIEWS[view]
        done = codec.decode_png(rasters.files(spark, sf_dir, view, interlace=interlace, filter_strategy=strategy))
        px = pixels.explode_pixels(done)
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[v.color_type]
        at = (F.col("y") * v.width + F.col("x")) * channels
        s = sum(((at + k + 1) * F.col(f"c{k}") for k in range(channels)), F.lit(0))
        return px.groupBy(F.col("image_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(s.cast("long")).alias("s"))

    return run


def _roundtrip_sql(view: str) -> str:
    v = rasters.VIEWS[view]
    if v.bit_depth == 16:
        value = f"q AS (SELECT vec_id, i // 2 AS k, CAST(sum(CASE WHEN i % 2 = 0 THEN b * 256 ELSE b END) AS BIGINT) AS v FROM r WHERE i < {v.n_bytes} GROUP BY ALL)"
    elif v.bit_depth == 4:
        value = "q AS (SELECT vec_id, 2 * i + h AS k, CASE WHEN h = 0 THEN b // 16 ELSE b % 16 END AS v FROM r, (VALUES (0), (1)) t(h))"
    else:
        value = f"q AS (SELECT vec_id, i AS k, b AS v FROM r WHERE i < {v.n_bytes})"
    return R + f", {value} SELECT vec_id, CAST({v.width * v.height} AS BIGINT) AS n, CAST(sum((k + 1) * v) AS BIGINT) AS s FROM q GROUP BY vec_id"


for _view in rasters.VIEWS:
    query(f"roundtrip_{_view}", _roundtrip_sql(_view))(_roundtrip(_view))
for _view in ("gray8", "rgb16", "gray4"):
    query(f"roundtrip_interlaced_{_view}", _roundtrip_sql(_view))(_roundtrip(_view, True))
for _strategy in ("zero", "minsum", "entropy", "bruteforce"):
    query(f"roundtrip_strategy_{_strategy}", _roundtrip_sql("rgba8"))(_roundtrip("rgba8", False, _strategy))


@query("header_fields", """SELECT vec_id, CAST(16 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, 4 AS bit_depth, 'Grey' AS color, vec_id % 2 = 1 AS interlace FROM embeddings""")
def header_fields(spark, sf_dir):
    """Header fields without Python after the files are made."""
    r = rasters.rasters(spark, sf_dir, "gray4")
    png = codec.encode_png(r.filter("image_id % 2 = 0")).unionByName(codec.encode_png(r.filter("image_id % 2 = 1"), interlace=True))
    h = codec.headers(png)
    return h.select(F.col("image_id").alias("vec_id"), "width", "height", F.col("bit_depth").cast("int").alias("bit_depth"), parsers.color_name(F.col("color_type")).alias("color"), "interlace")


@query("signature_check", """SELECT vec_id, CASE vec_id % 3 WHEN 1 THEN 'InvalidSignature' WHEN 2 THEN 'Io' END AS error FROM embeddings""")
def signature_check(spark, sf_dir):
    c, k = F.col("content"), F.col("image_id") % 3
    own = F.when(k == 0, c).when(k == 1, F.concat(F.unhex(F.lit("88")), F.substring(c, 2, 1 << 30))).otherwise(F.substring(c, 1, 5))
    return rasters.files(spark, sf_dir).select(F.col("image_id").alias("vec_id"), binary.signature_error(own).alias("error"))


@query("crc32_chunk", R + """, t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS crc),
q AS (SELECT vec_id, list_concat([116, 69, 88, 116], list(CAST(b AS BIGINT) ORDER BY i)) AS bytes FROM r GROUP BY vec_id)
SELECT vec_id, CAST(xor(list_reduce(bytes, lambda c, v: xor(c // 256, crc[xor(c % 256, v) + 1]), 4294967295), 4294967295) AS BIGINT) AS crc FROM q, t""")
def crc32_chunk(spark, sf_dir):
    r = rasters.rasters(spark, sf_dir, "gray8")
    return r.select(F.col("image_id").alias("vec_id"), binary.crc32(F.lit("tEXt"), F.col("samples")).alias("crc"))


@query("adler32_raster", R + """SELECT vec_id, CAST(((64 + sum((64 - i) * b)) % 65521) * 65536 + (1 + sum(b)) % 65521 AS BIGINT) AS adler FROM r GROUP BY vec_id""")
def adler32_raster(spark, sf_dir):
    r = rasters.bytes_of(spark, sf_dir).select("vec_id", F.posexplode("b").alias("i", "b"))
    own = binary.adler32(F.col("b").cast("long"), 63 - F.col("i"), F.lit(64))
    return r.groupBy("vec_id").agg(own.cast("long").alias("adler"))


@query("chunk_crc_valid", """SELECT name, CAST(sum(CASE WHEN vec_id % 5 = k THEN 0 ELSE 1 END) AS BIGINT) AS good, CAST(sum(CASE WHEN vec_id % 5 = k THEN 1 ELSE 0 END) AS BIGINT) AS bad
FROM embeddings, (VALUES ('IHDR', 0), ('IDAT', 1), ('IEND', 2)) t(name, k) GROUP BY name""")
def chunk_crc_valid(spark, sf_dir):
    """Files of which some have a flipped bit in a checksum."""
    c, k, n = F.col("content"), F.col("image_id") % 5, F.octet_length("content")
    at = F.when(k == 0, 32).when(k == 1, n - 13).when(k == 2, n - 1)  # the last byte of a chunk's checksum, from 0
    flipped = F.concat(F.substring(c, F.lit(1), at), binary.put(binary.u8(c, at).bitwiseXOR(F.lit(1)), 1), F.substring(c, at + 2, n))
    broken = rasters.files(spark, sf_dir).select("image_id", F.when(at.isNotNull(), flipped).otherwise(c).alias("content"))
    ok = F.col("crc_stored") == F.col("crc_calc")
    return C.split_chunks(broken).groupBy("name").agg(F.sum(F.when(ok, 1).otherwise(0)).alias("good"), F.sum(F.when(ok, 0).otherwise(1)).alias("bad"))


# Files with all kinds of chunks, one per conversation. Their image data is four bytes that nothing reads.


def rich_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, chunk_idx (in order, with gaps), name, data."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image_id"), "turn", "role", "text")
    ids = t.select("image_id").distinct()
    i, num = F.col("image_id"), lambda x: F.lit(x).cast("long")
    even = i % 2 == 0
    rgb = parsers.write_bytes(F.flatten(F.transform(F.sequence(num(0), i % 5), lambda k: F.array((k * i) % 256, k, num(255) - k))))
    alphas = parsers.write_bytes(F.transform(F.sequence(num(0), i % 3), lambda k: (k * 10 + i) % 256))
    keys = F.when(i % 3 == 0, binary.put(i * 5 % 65536, 2)).otherwise(parsers.write_bytes(F.array(i % 65536, i * 3 % 65536, num(7)), 2))
    back = F.when(i % 3 == 0, binary.put(i % 256, 1)).when(i % 3 == 1, binary.put(i * 9 % 65536, 2)).otherwise(parsers.write_bytes(F.array(num(1), i % 65536, num(3)), 2))
    fixed = [
        (0, "IHDR", parsers.write_ihdr(i % 50 + 1, num(3), num(8), num(0), num(0))), (1, "pHYs", parsers.write_phys(i * 7 + 1, i + 2, even)),
        (2, "tIME", parsers.write_time(i % 30 + 2000, i % 14, i % 31 + 1, i % 24, i % 60, i % 60)), (3, "PLTE", F.when(even, rgb)), (4, "tRNS", F.when(even, alphas).otherwise(keys)),
        (5, "bKGD", back), (1000, "IDAT", F.unhex(F.lit("00010203"))), (1001, "IEND", F.unhex(F.lit(""))),
    ]
    # One scan: a row per image with all its fixed chunks, exploded.
    own = ids.select("image_id", F.explode(F.array(*[F.struct(F.lit(k).alias("chunk_idx"), F.lit(n).alias("name"), d.alias("data")) for k, n, d in fixed])).alias("c")).select("image_id", "c.*")
    kind = F.when(F.col("turn") % 3 == 0, "tEXt").when(F.col("turn") % 3 == 1, "zTXt").otherwise("iTXt")
    plain = t.filter("turn % 3 = 0").withColumn("data", parsers.write_text(F.col("role"), F.col("text")))
    packed = t.filter("turn % 3 = 1").withColumn("data", parsers.write_ztxt(F.col("role"), F.col("text")))
    intl = t.filter("turn % 3 = 2").withColumn("data", parsers.write_itxt(F.col("role"), F.lit("en"), F.concat(F.lit("clé "), "role"), F.col("text"), True))
    texts = plain.unionByName(packed).unionByName(intl).select("image_id", (F.col("turn") + 10).cast("int").alias("chunk_idx"), kind.alias("name"), "data")
    return own.unionByName(texts).filter("data IS NOT NULL")


def rich_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.assemble(rich_chunks(spark, sf_dir))


_KINDS = """WITH ids AS (SELECT DISTINCT conv_id FROM conversations), c AS (SELECT conv_id, k, name, n FROM ids, (VALUES (0, 'IHDR', 13), (1, 'pHYs', 9), (2, 'tIME', 7), (3, 'PLTE', -1), (4, 'tRNS', -2),
(5, 'bKGD', -3), (1000, 'IDAT', 4), (1001, 'IEND', 0)) t(k, name, n) WHERE name <> 'PLTE' OR conv_id % 2 = 0
UNION ALL SELECT conv_id, turn + 10, CASE turn % 3 WHEN 0 THEN 'tEXt' WHEN 1 THEN 'zTXt' ELSE 'iTXt' END, CASE WHEN turn % 3 = 0 THEN strlen(role) + 1 + strlen(text) ELSE -4 END FROM conversations)
"""


@query("chunk_list", _KINDS + "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS INTEGER) AS chunk_idx, name FROM c")
def chunk_list(spark, sf_dir):
    return C.split_chunks(rich_files(spark, sf_dir), with_data=False).select(F.col("image_id").alias("conv_id"), "chunk_idx", "name")


@query("chunk_lengths", _KINDS + """SELECT conv_id, name, CAST(sum(CASE n WHEN -1 THEN 3 * (conv_id % 5 + 1) WHEN -2 THEN CASE WHEN conv_id % 2 = 0 THEN conv_id % 3 + 1 WHEN conv_id % 3 = 0 THEN 2 ELSE 6 END
WHEN -3 THEN CASE conv_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 6 END ELSE n END) AS BIGINT) AS bytes FROM c WHERE n <> -4 GROUP BY conv_id, name""")
def chunk_lengths(spark, sf_dir):
    c = C.split_chunks(rich_files(spark, sf_dir), with_data=False).filter("name NOT IN ('zTXt', 'iTXt')")
    return c.groupBy(F.col("image_id").alias("conv_id"), "name").agg(F.sum("length").alias("bytes"))


def _typed(spark, sf_dir):
    return C.typed_chunks(C.split_chunks(rich_files(spark, sf_dir))).withColumnRenamed("image_id", "conv_id")


@query("ihdr_fields", "SELECT DISTINCT conv_id, conv_id % 50 + 1 AS width, CAST(3 AS BIGINT) AS height, 8 AS bit_depth, 0 AS color_type, false AS interlace FROM conversations")
def ihdr_fields(spark, sf_dir):
    return _typed(spark, sf_dir).filter("name = 'IHDR'").select("conv_id", "header.width", "header.height", F.col("header.bit_depth").cast("int").alias("bit_depth"), F.col("header.color_type").cast("int").alias("color_type"), "header.interlace")


@query("phys_fields", "SELECT DISTINCT conv_id, conv_id * 7 + 1 AS ppu_x, conv_id + 2 AS ppu_y, conv_id % 2 = 0 AS is_meter FROM conversations")
def phys_fields(spark, sf_dir):
    return _typed(spark, sf_dir).filter("name = 'pHYs'").select("conv_id", "physical.*")


@query("time_fields", """SELECT DISTINCT conv_id, CAST(conv_id % 30 + 2000 AS INTEGER) AS year, CAST(conv_id % 14 AS INTEGER) AS month, CAST(conv_id % 31 + 1 AS INTEGER) AS day, CAST(conv_id % 24 AS INTEGER) AS hour,
conv_id % 14 BETWEEN 1 AND 12 AND try_cast(CAST(conv_id % 30 + 2000 AS VARCHAR) || '-' || CAST(conv_id % 14 AS VARCHAR) || '-' || CAST(conv_id % 31 + 1 AS VARCHAR) AS DATE) IS NOT NULL AS is_date FROM conversations""")
def time_fields(spark, sf_dir):
    t = _typed(spark, sf_dir).filter("name = 'tIME'")
    return t.select("conv_id", "time.year", "time.month", "time.day", "time.hour", F.col("time.ts").isNotNull().alias("is_date"))


@query("plte_entries", """SELECT conv_id, CAST(k AS INTEGER) AS idx, CAST((k * conv_id) % 256 AS INTEGER) AS r, CAST(k AS INTEGER) AS g, CAST(255 - k AS INTEGER) AS b
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0), range(5) t(k) WHERE k <= conv_id % 5""")
def plte_entries(spark, sf_dir):
    p = _typed(spark, sf_dir).filter("name = 'PLTE'").select("conv_id", F.posexplode("palette").alias("idx", "c"))
    return p.select("conv_id", "idx", *[F.col(f"c.{x}").cast("int").alias(x) for x in "rgb"])


@query("trns_forms", """SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'alphas' WHEN conv_id % 3 = 0 THEN 'grey' ELSE 'rgb' END AS form, CASE WHEN conv_id % 2 = 0 THEN
list_sum(list_transform(range(conv_id % 3 + 1), lambda k: (k * 10 + conv_id) % 256)) WHEN conv_id % 3 = 0 THEN conv_id * 5 % 65536 ELSE conv_id % 65536 + conv_id * 3 % 65536 + 7 END::BIGINT AS total FROM conversations""")
def trns_forms(spark, sf_dir):
    t = _typed(spark, sf_dir).filter("name = 'tRNS'").select("conv_id", "transparency.*")
    form = F.when(F.col("alphas").isNotNull(), "alphas").when(F.col("gray_key").isNotNull(), "grey").when(F.col("rgb_key").isNotNull(), "rgb")
    sum_ = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))
    return t.select("conv_id", form.alias("form"), F.coalesce(sum_("alphas"), F.col("gray_key").cast("long"), sum_("rgb_key")).alias("total"))


@query("bkgd_forms", """SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'grey' ELSE 'rgb' END AS form, CASE conv_id % 3 WHEN 0 THEN conv_id % 256 WHEN 1 THEN conv_id * 9 % 65536 ELSE conv_id % 65536 END::BIGINT AS value FROM conversations""")
def bkgd_forms(spark, sf_dir):
    t = _typed(spark, sf_dir).filter("name = 'bKGD'").select("conv_id", "background.*")
    form = F.when(F.col("index").isNotNull(), "index").when(F.col("gray").isNotNull(), "grey").when(F.col("rgb").isNotNull(), "rgb")
    return t.select("conv_id", form.alias("form"), F.coalesce(F.col("index").cast("long"), F.col("gray").cast("long"), F.try_element_at("rgb", F.lit(2)).cast("long")).alias("value"))


@query("text_pairs", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'tEXt' WHEN 1 THEN 'zTXt' ELSE 'iTXt' END AS kind, role AS key, text AS val, CASE WHEN turn % 3 = 2 THEN 'clé ' || role END AS transkey, turn % 3 <> 0 AS compressed FROM conversations")
def text_pairs(spark, sf_dir):
    t = C.text_table(C.split_chunks(rich_files(spark, sf_dir)))
    first = F.min("chunk_idx").over(Window.partitionBy("image_id"))
    t = t.withColumn("turn", (F.col("chunk_idx") - first).cast("long"))  # turns are chunks without gaps
    return t.select(F.col("image_id").alias("conv_id"), "turn", "kind", "key", "val", "transkey", "compressed")


def _texts(kind: str):
    def run(spark, sf_dir):
        t = C.text_table(C.split_chunks(rich_files(spark, sf_dir)).filter(F.col("name") == kind))
        return t.groupBy(F.col("image_id").alias("conv_id")).agg(F.count("val").alias("n"), F.sum(F.char_length("val")).cast("long").alias("chars"), F.max("val").alias("last"))

    return run


for _k, _kind in enumerate(("text", "ztxt", "itxt")):
    query(f"{_kind}_roundtrip", f"SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, max(text) AS last FROM conversations WHERE turn % 3 = {_k} GROUP BY conv_id")(_texts(("tEXt", "zTXt", "iTXt")[_k]))


@query("text_last_wins", "SELECT conv_id, role AS key, arg_max(text, turn) AS val FROM conversations GROUP BY conv_id, role")
def text_last_wins(spark, sf_dir):
    return C.last_text(C.text_table(C.split_chunks(rich_files(spark, sf_dir)))).withColumnRenamed("image_id", "conv_id")


@query("serialize_parse_again", _KINDS + "SELECT name, count(*) AS n, count(*) AS good FROM c GROUP BY name")
def serialize_parse_again(spark, sf_dir):
    """Chunks of files, put together again as files, are the same chunks."""
    one = C.split_chunks(rich_files(spark, sf_dir))
    two = C.split_chunks(C.assemble(one)).select("image_id", "chunk_idx", F.col("name").alias("name2"), F.col("data").alias("data2"))
    both = one.join(two, ["image_id", "chunk_idx"], "left")
    same = (F.col("name") == F.col("name2")) & (F.col("data") == F.col("data2")) & (F.col("crc_stored") == F.col("crc_calc"))
    return both.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(same, 1)).alias("good"))


# Order of chunks: events of a user stand for the chunks of an image.

_EVENTS = """WITH e AS (SELECT user_id AS image_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS chunk_idx, event_id FROM events),
c AS (SELECT image_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, event_id % 100 AS length, CASE WHEN chunk_idx = 0 AND image_id % 4 <> 0 THEN 'IHDR' WHEN event_id % 11 <= 4 THEN 'IDAT' WHEN event_id % 11 <= 6 THEN 'tEXt'
WHEN event_id % 11 = 7 THEN 'tIME' WHEN event_id % 11 = 8 THEN 'PLTE' WHEN event_id % 11 = 9 THEN 'IEND' ELSE 'abCd' END AS name FROM e)
"""


def event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), "event_id")
    e = e.withColumn("chunk_idx", (F.row_number().over(Window.partitionBy("image_id").orderBy("event_id")) - 1).cast("int"))
    k = F.col("event_id") % 11
    name = F.when((F.col("chunk_idx") == 0) & (F.col("image_id") % 4 != 0), "IHDR").when(k <= 4, "IDAT").when(k <= 6, "tEXt").when(k == 7, "tIME").when(k == 8, "PLTE").when(k == 9, "IEND").otherwise("abCd")
    return e.select("image_id", "chunk_idx", name.alias("name"), (F.col("event_id") % 100).alias("length"))


@query("idat_runs", _EVENTS + """, d AS (SELECT *, chunk_idx - row_number() OVER (PARTITION BY image_id ORDER BY chunk_idx) AS island FROM c WHERE name = 'IDAT'),
s AS (SELECT image_id, min(chunk_idx) AS first_chunk, count(*) AS n_chunks, CAST(sum(length) AS BIGINT) AS n_bytes FROM d GROUP BY image_id, island)
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY first_chunk) - 1 AS INTEGER) AS frame_idx, first_chunk, n_chunks, n_bytes FROM s""")
def idat_runs(spark, sf_dir):
    return C.idat_runs(event_chunks(spark, sf_dir))


@query("duplicate_chunks", _EVENTS + "SELECT image_id, name, count(*) AS n FROM c WHERE name IN ('IHDR', 'PLTE', 'tIME', 'IEND') GROUP BY image_id, name HAVING count(*) > 1")
def duplicate_chunks(spark, sf_dir):
    return C.duplicate_chunks(event_chunks(spark, sf_dir))


@query("order_violations", _EVENTS + """, w AS (SELECT *, row_number() OVER (PARTITION BY image_id, name ORDER BY chunk_idx) AS nth, lead(name) OVER (PARTITION BY image_id ORDER BY chunk_idx) IS NULL AS last,
coalesce(bool_or(name = 'IDAT') OVER p, false) AS data, coalesce(bool_or(name = 'IEND') OVER p, false) AS ended FROM c WINDOW p AS (PARTITION BY image_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CASE WHEN ended THEN NULL WHEN (chunk_idx = 0) <> (name = 'IHDR') THEN 'ChunkOrder' WHEN name = 'PLTE' AND data THEN 'ChunkOrder' WHEN name IN ('PLTE', 'tIME') AND nth > 1 THEN 'Multiple'
WHEN name = 'IEND' AND NOT data THEN 'NoImageData' WHEN data AND name = 'abCd' THEN 'UnknownChunkType' WHEN last AND name <> 'IEND' THEN 'NoImageData' END AS code FROM w)
SELECT image_id, min(chunk_idx) AS chunk_idx, arg_min(name, chunk_idx) AS name, arg_min(code, chunk_idx) AS code FROM v WHERE code IS NOT NULL GROUP BY image_id""")
def order_violations(spark, sf_dir):
    return C.order_violations(event_chunks(spark, sf_dir), strict=True)


@query("plte_seen_flag", _EVENTS + "SELECT image_id, chunk_idx, coalesce(bool_or(name = 'PLTE') OVER (PARTITION BY image_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM c")
def plte_seen_flag(spark, sf_dir):
    return event_chunks(spark, sf_dir).select("image_id", "chunk_idx", C.has_palette().alias("seen"))


# Filters


def _filter(kind: int):
    def run(spark, sf_dir):
        return filters.filter_bytes(rasters.grey_rows(spark, sf_dir), kind, 1, "vec_id").groupBy("vec_id", "y").agg(F.sum(F.col("v") * (F.col("x") + 1)).cast("long").alias("s"))

    return run


for _k, _name in enumerate(filters.TYPES):
    query(f"filter_{_name}", N + f"SELECT vec_id, y, CAST(sum(s * (x + 1)) AS BIGINT) AS s FROM f WHERE type = {_k} GROUP BY vec_id, y")(_filter(_k))


def _strategy(name: str):
    def run(spark, sf_dir):
        tried = filters.candidates(rasters.grey_rows(spark, sf_dir), 1, "vec_id")
        return filters.choose(filters.costs(tried, name, "vec_id"), "vec_id").select("vec_id", "y", "type")

    return run


_CHOSEN = "SELECT vec_id, y, type FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, y ORDER BY cost, type) AS k FROM cost) WHERE k = 1"
query("strategy_zero", N + ", cost AS (SELECT DISTINCT vec_id, y, type, type AS cost FROM f) " + _CHOSEN)(_strategy("zero"))
query("strategy_minsum", N + ", cost AS (SELECT vec_id, y, type, sum(CASE WHEN type = 0 OR s < 128 THEN s ELSE 255 - s END) AS cost FROM f GROUP BY ALL) " + _CHOSEN)(_strategy("minsum"))
query(
    "strategy_entropy",
    N + """, g AS (SELECT vec_id, y, type, s, count(*) AS n FROM (SELECT vec_id, y, type, s FROM f UNION ALL SELECT vec_id, y, type, type FROM f WHERE x = 0) GROUP BY ALL),
cost AS (SELECT vec_id, y, type, round(sum(-(n / 9.0) * log2(n / 9.0)), 5) AS cost FROM g GROUP BY ALL) """ + _CHOSEN,
)(_strategy("entropy"))


@query("strategy_minsum_costs", R + """, q AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, b AS v FROM r), n AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS a,
coalesce(lag(v) OVER (PARTITION BY vec_id, x ORDER BY y), 0) AS b FROM q), o AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS c FROM n),
f AS (SELECT vec_id, y, unnest([0, 1, 2, 3, 4]) AS type, unnest([v, (v - a + 256) % 256, (v - b + 256) % 256, (v - (a + b) // 2 + 256) % 256,
(v - CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END + 256) % 256]) AS s FROM o),
cost AS (SELECT vec_id, y, type, sum(CASE WHEN type = 0 OR s < 128 THEN s ELSE 255 - s END) AS cost FROM f GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, y ORDER BY cost, type) AS k FROM cost) SELECT type, count(*) AS n, CAST(sum(cost) AS BIGINT) AS cost FROM k WHERE k = 1 GROUP BY type""")
def strategy_minsum_costs(spark, sf_dir):
    tried = filters.candidates(rasters.grey_rows(spark, sf_dir, wrapped=False), 1, "vec_id")
    best = filters.choose(filters.costs(tried, "minsum", "vec_id"), "vec_id")
    return best.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").cast("long").alias("cost"))


@query("strategy_auto", """SELECT color_type, bit_depth, CASE WHEN color_type = 3 OR bit_depth < 8 THEN 'zero' ELSE 'minsum' END AS strategy FROM
(VALUES (0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)) t(color_type, bit_depth)""")
def strategy_auto(spark, sf_dir):
    from ..kernels import DEPTHS

    modes = spark.createDataFrame([(c, d) for c, ds in DEPTHS.items() for d in ds], "color_type int, bit_depth int")
    return modes.withColumn("strategy", filters.auto_strategy(F.col("color_type"), F.col("bit_depth")))


@query("strategy_bruteforce")
def strategy_bruteforce(spark, sf_dir):
    """Sizes of files by strategy; strict brute force never leaves filter type 0."""
    r = rasters.rasters(spark, sf_dir, "gray8")
    out = None
    for name, strict in (("zero", False), ("bruteforce", False), ("bruteforce", True)):
        own = codec.encode_png(r, filter_strategy=name, strict=strict).agg(F.sum(F.octet_length("content")).alias("bytes"))
        own = own.select(F.lit(name).alias("strategy"), F.lit(strict).alias("strict"), "bytes")
        out = own if out is None else out.unionByName(own)
    return out


@query("compression_level_monotone")
def compression_level_monotone(spark, sf_dir):
    r = rasters.rasters(spark, sf_dir, "gray8")
    out = None
    for level in (0, 1, 6, 9, 10):
        own = codec.encode_png(r, compression_level=level).agg(F.sum(F.octet_length("content")).alias("bytes")).select(F.lit(level).alias("level"), "bytes")
        out = own if out is None else out.unionByName(own)
    return out


def _unfilter(kind: int):
    def run(spark, sf_dir):
        f = filters.filter_bytes(rasters.grey_rows(spark, sf_dir), kind, 1, "vec_id")
        back = filters.unfilter_sub(f, 1, "vec_id") if kind == 1 else filters.unfilter_up(f, "vec_id")
        return back.select("vec_id", "y", "x", "v")

    return run


query("unfilter_sub_window", R + "SELECT vec_id, y, x, v FROM m")(_unfilter(1))
query("unfilter_up_window", R + "SELECT vec_id, y, x, v FROM m")(_unfilter(2))


# Adam7, bits, palettes, colours

_PASSES = "(VALUES (0, 0, 0, 8, 8), (1, 4, 0, 8, 8), (2, 0, 4, 4, 8), (3, 2, 0, 4, 4), (4, 0, 2, 2, 4), (5, 1, 0, 2, 2), (6, 0, 1, 1, 2)) p(pass, x0, y0, dx, dy)"


@query("adam7_pass_dims", f"""WITH d AS (SELECT p_partkey AS image_id, pass, greatest(0, (p_partkey % 40 + 1 - x0 + dx - 1) // dx) AS w, greatest(0, (p_size - y0 + dy - 1) // dy) AS h FROM part, {_PASSES})
SELECT image_id, pass, CAST(CASE WHEN w * h = 0 THEN 0 ELSE w END AS BIGINT) AS w, CAST(CASE WHEN w * h = 0 THEN 0 ELSE h END AS BIGINT) AS h FROM d""")
def adam7_pass_dims(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 40 + 1).alias("width"), F.col("p_size").cast("long").alias("height"))
    return pixels.pass_sizes(p)


@query("adam7_pixel_pass", R + f""", q AS (SELECT vec_id, v, pass, (x - x0) // dx AS px, (y - y0) // dy AS py FROM m, {_PASSES} WHERE x >= x0 AND y >= y0 AND (x - x0) % dx = 0 AND (y - y0) % dy = 0)
SELECT vec_id, pass, count(*) AS n, CAST(sum(v * (py * 8 + px + 1)) AS BIGINT) AS s FROM q GROUP BY vec_id, pass""")
def adam7_pixel_pass(spark, sf_dir):
    p = pixels.interlace(rasters.grey_rows(spark, sf_dir))
    return p.groupBy("vec_id", "pass").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * (F.col("py") * 8 + F.col("px") + 1)).cast("long").alias("s"))


@query("adam7_deinterlace", R + "SELECT vec_id, y, x, v FROM m")
def adam7_deinterlace(spark, sf_dir):
    return pixels.deinterlace(pixels.interlace(rasters.grey_rows(spark, sf_dir))).select("vec_id", "y", "x", "v")


@query("subbyte_unpack", R + """, d AS (SELECT vec_id, i, b, depth, k FROM r, (VALUES (1), (2), (4)) t(depth), range(8) u(k) WHERE k < 8 // depth)
SELECT vec_id, depth, CAST(sum((i * (8 // depth) + k + 1) * ((b >> (8 - depth * (k + 1))) & ((1 << depth) - 1))) AS BIGINT) AS s FROM d GROUP BY vec_id, depth""")
def subbyte_unpack(spark, sf_dir):
    r = rasters.bytes_of(spark, sf_dir).select("vec_id", F.posexplode("b").alias("x", "v"))
    out = None
    for depth in (1, 2, 4):
        own = pixels.unpack_bits(r, depth).withColumn("depth", F.lit(depth))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("vec_id", "depth").agg(F.sum((F.col("x") + 1) * F.col("v")).cast("long").alias("s"))


@query("subbyte_pack", R + "SELECT vec_id, CAST(i AS INTEGER) AS x, b AS v FROM r")
def subbyte_pack(spark, sf_dir):
    r = rasters.bytes_of(spark, sf_dir).select("vec_id", F.posexplode("b").alias("x", "v"))
    return pixels.pack_bits(pixels.unpack_bits(r, 2), 2, ["vec_id"]).select("vec_id", "x", "v")


@query("palette_expand", R + """SELECT vec_id, CAST(sum((i + 1) * b) AS BIGINT) AS r, CAST(sum((i + 1) * (255 - b)) AS BIGINT) AS g, CAST(sum((i + 1) * (b * 7 % 256)) AS BIGINT) AS b,
CAST(sum((i + 1) * CASE WHEN b < 100 THEN b * 2 ELSE 255 END) AS BIGINT) AS a FROM r GROUP BY vec_id""")
def palette_expand(spark, sf_dir):
    done = codec.decode_png(rasters.files(spark, sf_dir, "palette"))
    px = pixels.expand_palette(pixels.explode_pixels(done), pixels.palette_table(done))
    at = F.col("y") * 8 + F.col("x") + 1
    return px.filter("error IS NULL").groupBy(F.col("image_id").alias("vec_id")).agg(*[F.sum(at * F.col(f"c{k}")).cast("long").alias(n) for k, n in enumerate("rgba")])


def _converted(view: str, source_: str, target: str, depth: int, to_depth: int):
    def run(spark, sf_dir):
        px = pixels.explode_pixels(codec.decode_png(rasters.files(spark, sf_dir, view)))
        c = pixels.convert(px, source_, target, depth, to_depth)
        n = {"grey": 1, "greyalpha": 2, "rgb": 3, "rgba": 4}[target]
        return c.groupBy(F.col("image_id").alias("vec_id")).agg(*[F.sum(F.col(f"c{k}") * (F.col("y") * 8 + F.col("x") + 1)).cast("long").alias(f"s{k}") for k in range(n)])

    return run


def _grid(width: int, per: int, n: int = 64) -> str:
    """Pixels of an image whose pixels are `per` bytes: y, x and bytes b0, b1, ..."""
    cols = ", ".join(f"max(CASE WHEN i % {per} = {k} THEN b END) AS b{k}" for k in range(per))
    return R + f", q AS (SELECT vec_id, (i // {per}) // {width} * 8 + (i // {per}) % {width} + 1 AS pos, {cols} FROM r WHERE i < {n} GROUP BY vec_id, i // {per}) "


_s = lambda *cols: "SELECT vec_id, " + ", ".join(f"CAST(sum(pos * ({c})) AS BIGINT) AS s{k}" for k, c in enumerate(cols)) + " FROM q GROUP BY vec_id"
query("color_convert_rgb8_grey8", _grid(4, 3, 48) + _s("(b0 * 299 + b1 * 587 + b2 * 114 + 500) // 1000"))(_converted("rgb8", "rgb", "grey", 8, 8))
query("color_convert_grey16_grey8", _grid(8, 2) + _s("(b0 * 256 + b1 + 128) // 257"))(_converted("gray16", "grey", "grey", 16, 8))
query("color_convert_greya8_rgba16", _grid(8, 2) + _s("b0 * 257", "b0 * 257", "b0 * 257", "b1 * 257"))(_converted("graya8", "greyalpha", "rgba", 8, 16))
query("color_convert_rgba8_rgb8", _grid(4, 4) + _s("b0", "b1", "b2"))(_converted("rgba8", "rgba", "rgb", 8, 8))
query("color_convert_grey8_rgba8", _grid(8, 1) + _s("b0", "b0", "b0", "255"))(_converted("gray8", "grey", "rgba", 8, 8))


# Errors


def _fixture_frame(spark, rows, name):
    return spark.createDataFrame([(n, bytearray(d)) for n, d, _ in rows], f"{name} string, content binary").coalesce(2)


_CODES = ", ".join(f"('{n}', '{c}')" for n, _, c in fixtures.errors())


@query("decode_errors", f"SELECT image_id, code FROM (VALUES {_CODES}) t(image_id, code)")
def decode_errors(spark, sf_dir):
    """Exactly one error row for each broken file."""
    source.ship(spark)
    done = codec.decode_png(_fixture_frame(spark, fixtures.errors(), "image_id"))
    return done.filter("error IS NOT NULL").select("image_id", F.col("error.code").alias("code"))


@query("decode_errors_strict", "SELECT image_id, code FROM (VALUES " + ", ".join(f"('{n}', '{c}')" for n, _, c in fixtures.strict_errors()) + ") t(image_id, code)")
def decode_errors_strict(spark, sf_dir):
    source.ship(spark)
    done = codec.decode_png(_fixture_frame(spark, fixtures.strict_errors(), "image_id"), strict=True)
    return done.filter("error IS NOT NULL").select("image_id", F.col("error.code").alias("code"))


@query("trailing_warning", "SELECT 'trailing' AS image_id, 'TrailingChunk' AS warning, 2 AS width")
def trailing_warning(spark, sf_dir):
    source.ship(spark)
    done = codec.decode_png(_fixture_frame(spark, [("trailing", fixtures.trailing(), "")], "image_id"))
    return done.filter("error IS NULL").select("image_id", "warning", F.col("width").cast("int").alias("width"))


@query("encode_errors", "SELECT image_id, error FROM (VALUES ('no palette', 'BadPalette'), ('257 colours', 'BadPalette'), ('short', 'ShortData'), ('rgb 4', 'ColorMode'), ('empty', 'ImageDimensions'), ('good', NULL)) t(image_id, error)")
def encode_errors(spark, sf_dir):
    source.ship(spark)
    many = [(k % 256, 0, 0) for k in range(257)]
    rows = [
        ("no palette", 1, 1, 3, 8, bytearray(1), None), ("257 colours", 1, 1, 3, 8, bytearray(1), many), ("short", 2, 1, 0, 8, bytearray(1), None),
        ("rgb 4", 1, 1, 2, 4, bytearray(3), None), ("empty", 0, 1, 0, 8, bytearray(), None), ("good", 1, 1, 0, 8, bytearray(1), None),
    ]
    kind = "image_id string, width long, height long, color_type int, bit_depth int, samples binary, palette array<struct<r:smallint,g:smallint,b:smallint>>"
    return codec.encode_png(spark.createDataFrame(rows, kind).coalesce(1)).select("image_id", "error")


# Sources and streams


def _folder(spark) -> str:
    """A folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    base = (found.rstrip("/") if found else tempfile.mkdtemp(prefix="scanloom-shared-")) + f"/png-{uuid.uuid4().hex}"
    return base


def write_pngs(spark, sf_dir, view: str, path: str) -> None:
    source.register(spark)
    own = rasters.rasters(spark, sf_dir, view).withColumn("name", F.col("image_id").cast("string")).drop("image_id", "label")
    own.write.format("png").mode("append").save(path)


def _number(path: str = "path"):
    return F.regexp_extract(path, r"(\d+)\.png$", 1).cast("long").alias("vec_id")


_SUMS = R + "SELECT vec_id, CAST(sum((i + 1) * b) AS BIGINT) AS s FROM r GROUP BY vec_id"


def _sums(frames: DataFrame) -> DataFrame:
    px = pixels.explode_pixels(frames, "path")
    return px.groupBy(_number()).agg(F.sum((F.col("y") * 8 + F.col("x") + 1) * F.col("c0")).cast("long").alias("s"))


@query("source_write_read", _SUMS)
def source_write_read(spark, sf_dir):
    """Files written and read by the data source."""
    path = _folder(spark)
    write_pngs(spark, sf_dir, "gray8", path)
    return _sums(spark.read.format("png").load(path))


@query("source_binary_files", _SUMS)
def source_binary_files(spark, sf_dir):
    path = _folder(spark)
    write_pngs(spark, sf_dir, "gray8", path)
    return _sums(source.read_images(spark, path))


@query("source_chunks_pushed", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(13 * count(*) AS BIGINT) AS bytes FROM embeddings")
def source_chunks_pushed(spark, sf_dir):
    path = _folder(spark)
    write_pngs(spark, sf_dir, "gray8", path)
    c = spark.read.format("png_chunks").load(path).filter("name = 'IHDR'")
    return c.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


@query("stream_images", _SUMS)
def stream_images(spark, sf_dir):
    """Files taken up by a stream, decoded, and written as Parquet."""
    path = _folder(spark)
    write_pngs(spark, sf_dir, "gray8", path)
    q = ingest.into(ingest.stream_images(spark, path, files_per_trigger=250), f"{path}-out", f"{path}-state")
    q.awaitTermination()
    return _sums(spark.read.parquet(f"{path}-out"))


@query("stream_chunks", "SELECT name, count(*) AS n FROM embeddings, (VALUES ('IHDR'), ('IDAT'), ('IEND')) t(name) GROUP BY name")
def stream_chunks(spark, sf_dir):
    path = _folder(spark)
    write_pngs(spark, sf_dir, "gray8", path)
    q = ingest.into(ingest.stream_chunks(spark, path), f"{path}-out", f"{path}-state")
    q.awaitTermination()
    return spark.read.parquet(f"{path}-out").filter("crc_stored = crc_calc").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
