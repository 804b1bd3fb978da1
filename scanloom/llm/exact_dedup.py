"""Exact dedup by deterministic block naming (native: DataFrame operations only).

Every normalised text is cut into fixed-size blocks. Distinct blocks are sorted and numbered; then adjacent pairs of
numbers are sorted and numbered, level by level, until a document is one number. Two documents have the same number
at the same level if and only if their texts are the same: numbers stand for contents, so nothing can collide.

Blocks are moved once, to be compared. Elsewhere a 128-bit hash stands in for a block; hashes that two different
blocks share are found by comparing the blocks, and their rows are joined by content instead.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, table

BLOCK_CHARS = 8192


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null is empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def blocks_of(text: Column, chars: int) -> Column:
    """Whole text as an array of blocks of `chars` code points; an empty text is one empty block."""
    return F.when(F.char_length(text) <= chars, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    )


def _hashed(block: Column) -> Column:
    return F.struct(F.xxhash64(block).alias("h1"), F.xxhash64(F.lit(0x5CA1), block).alias("h2"))


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows in sorted order, each with an integer name of its own."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _name_blocks(texts: DataFrame, refs: DataFrame, hashes) -> DataFrame:
    """refs (key, pos, h1, h2) -> (key, pos, name), by the contents of the blocks of texts (block)."""
    named = _numbered(texts.withColumn("h", hashes(F.col("block"))).select("h.h1", "h.h2", "block").distinct(), "block", "h1", "h2")
    by_hash = named.groupBy("h1", "h2").agg(F.min("name").alias("name"), F.max("name").alias("other"))
    by_hash = stage(by_hash, "block-names")
    joined = refs.join(by_hash, ["h1", "h2"]).select(*refs.columns, "name", (F.col("name") != F.col("other")).alias("shared"))
    return joined


def exact_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hashes=_hashed
) -> DataFrame:
    """One row per document with (id_col, text_sha256, copies, level, name); (level, name) is its identity.

    copies counts input rows with the same id and the same text: they are one document here. A null text is an empty
    one; a null id is an id like others. hashes is a parameter for tests only.
    """
    base = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm"))
    cut = base.select("id", F.sha2(F.col("norm"), 256).alias("sha"), blocks_of(F.col("norm"), block_chars).alias("blocks"))
    thin = cut.select("id", "sha", F.transform("blocks", lambda b: hashes(b)).alias("hs"))
    thin = stage(thin.groupBy("id", "sha").agg(F.first("hs").alias("hs"), F.count(F.lit(1)).alias("copies")), "block-hashes")
    texts = base.select(F.explode(blocks_of(F.col("norm"), block_chars)).alias("block"))
    refs = thin.select("id", "sha", "copies", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h"))
    refs = refs.select("id", "sha", "copies", "n", "pos", "h.h1", "h.h2")
    level = stage(_name_blocks(texts, refs, hashes), "level-0")
    clash = level.filter("shared").select("h1", "h2").distinct()
    if not clash.isEmpty():  # different blocks share a hash: these go by content
        own = cut.select("id", "sha", F.posexplode("blocks").alias("pos", "block")).withColumn("h", hashes(F.col("block")))
        own = own.select("id", "sha", "pos", "block", "h.h1", "h.h2").join(clash, ["h1", "h2"], "left_semi").distinct()
        names = stage(_numbered(own.select("block").distinct(), "block"), "clash-names")
        # Names of one hash and names by content must not meet: the latter are negative.
        own = own.join(names, "block").select("id", "sha", "pos", (-F.col("name") - 1).alias("exact"))
        left, right = level.alias("l"), own.alias("r")
        on = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.sha") == F.col("r.sha")) & (F.col("l.pos") == F.col("r.pos"))
        level = left.join(right, on, "left").select("l.id", "l.sha", "l.copies", "l.n", "l.pos", F.coalesce("r.exact", "l.name").alias("name"))
    level = level.select("id", "sha", "copies", "n", "pos", "name")
    done, depth = [level.filter("n = 1").withColumn("level", F.lit(0))], 0
    rest = level.filter("n > 1")
    while not rest.isEmpty():
        depth += 1
        even = F.col("pos") % 2 == 0
        pairs = rest.groupBy("id", "sha", "copies", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"), F.max(F.when(~even, F.col("name"))).alias("right")
        )
        pairs = stage(pairs, f"pairs-{depth}")
        names = stage(_numbered(pairs.select("left", "right").distinct(), "left", "right"), f"pair-names-{depth}")
        p, q = pairs.alias("p"), names.alias("q")
        named = p.join(q, (F.col("p.left") == F.col("q.left")) & F.col("p.right").eqNullSafe(F.col("q.right")))
        named = named.select("id", "sha", "copies", F.expr("(n + 1) div 2").cast("int").alias("n"), "pos", "name")
        named = stage(named, f"level-{depth}")
        done.append(named.filter("n = 1").withColumn("level", F.lit(depth)))
        rest = named.filter("n > 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_col), F.col("sha").alias("text_sha256"), "copies", "level", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after lower-casing A-Z; null counts as empty. Of equal texts, the largest id stays.
    Rows that repeat both id and text are one document: they all count in group_size, and each has kept set if their
    id is the one to keep (a group without any id keeps the null id). Very long texts are more blocks, no larger rows.
    An empty table gives an empty result; other columns of docs are ignored, whatever their names.
    """
    classes = stage(exact_classes(docs, id_col, text_col, block_chars).withColumnRenamed(id_col, "id"), "identities")
    groups = classes.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = stage(groups, "groups")  # a plain scan on this side, so that a large group's rows can be split in the join
    out = classes.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
