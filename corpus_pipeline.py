"""The corpus pipeline: quality, line dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; what it returns is written as Parquet
and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import line_dedup, mixing, near_dedup, quality, sentencepiece_codec
from scanloom.llm.common import free_name, stage, table, unstage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of these documents, doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = free_name("__score", docs)
    return quality.score(docs, model, to=score).filter(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that have been before; n_chars follows. Documents of which nothing is left go."""
    full = free_name("__full", docs)
    out = line_dedup.line_dedup(docs.withColumn(full, F.char_length("text") > 0))
    out = out.filter((F.char_length("text") > 0) | F.coalesce(~F.col(full), F.lit(True)))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens."""
    return sentencepiece_codec.encode_column(docs)


STAGES = [
    ("quality", keep_good), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL expresses neither the classifier nor the hashes. Tests hold the line and near operators by themselves against brute
#: force; of the stages they check schemas, unique ids, the tokens' parity and how many documents labelled good are lost.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, one in STAGES[:-1]:
        before, docs = docs, stage(one(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
