"""Corpus pipeline: documents in, placed pieces of packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``; ``n_chars`` follows the text.

Every stage gives an empty table for an empty one, takes nulls in any column,
and keeps null and repeated ids apart by the text; a null text is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.llm.bloom import meet, without
from tabulark.llm.common import WORD, shared, shared_table
from tabulark.llm.line_dedup import dedup_lines
from tabulark.llm.mixing import mixed_documents
from tabulark.llm.near_dedup import near_groups
from tabulark.llm.packing import pack
from tabulark.llm.quality_rules import judge

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the base rules or the forest reject go.
    Null and empty texts hold too few words, so they go; rows that agree in id
    and text share a verdict, and all of them stay or go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    rejected = shared(judge(docs, labels).where(~F.col("kept")).select("doc_id", "th").distinct())
    keyed = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    return _columns(without(keyed, rejected))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of similar lines one stays. A document whose lines are all
    repeats of others goes; one that never had a line stays. Rows that agree
    in id and text are one place, so all of them lose the same lines."""
    out = dedup_lines(docs, keep=("lang", "source", "n_chars"))
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return _columns(out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 with five-word shingles and a similarity of 0.8: of each
    group the document with the smallest id, then text hash, stays, and of rows
    that agree in both the least by the other columns."""
    keyed = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    verdicts = near_groups(docs).where("n_shingles > 0").groupBy("doc_id", "th").agg(F.first("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    some, none = meet(keyed, shared(verdicts.where("not _kept or _n > 1")))
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = some.where("_kept").groupBy("doc_id", "th").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("_row"))
    one = one.select("doc_id", *[F.col(f"_row.{c}").alias(c) for c in rest])
    return _columns(none).unionByName(_columns(some.where("_kept is null"))).unionByName(_columns(one))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents come as often as the mix takes them, so ids may
    repeat from here on. Documents are taken whole; ones without a word have
    no size and are never taken; a null source is a source."""
    out = mixed_documents(docs, keep=("lang", "source"))
    return _columns(out.withColumn("n_chars", F.length("text").cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every piece of every document with its ids and its place;
    repeated rows are packed each on its own, an empty text as its end id."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL expresses neither the forest nor the packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
