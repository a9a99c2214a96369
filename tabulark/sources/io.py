"""Sources and sinks.

Readers return DataFrames with the reference's missing-value and naming
conventions; sinks write with Spark's committers (task retries are safe)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import NA_TOKENS
from .json_array import as_lines
from ..functions.columns import nan_to_null, q, resolve
from ..functions.ordering import with_positions
from ..operators.filters import search_condition

# Separator preference when sniffing delimited text.
SEPARATORS = ("\t", ";", ",")
# Text read as a boolean by the CSV type inference (pandas).
CSV_TRUE = ("True", "TRUE", "true")
CSV_FALSE = ("False", "FALSE", "false")


def _na_to_null(c: Column) -> Column:
    return F.when(c.isin(*NA_TOKENS) | F.trim(c).isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def infer_text_types(df: DataFrame) -> DataFrame:
    """Type string columns like pandas' CSV reader: bigint if every present
    value is an integer, double if every one is a number, boolean for
    True/False text, else string. One aggregate pass decides all columns."""
    cols = df.columns
    if not cols:
        return df
    checks = []
    for i, c in enumerate(cols):
        x = F.trim(q(c))
        present = x.isNotNull()
        checks += [
            F.count_if(present).alias(f"p{i}"),
            F.count_if(present & x.try_cast("bigint").isNotNull() & ~x.contains(".")).alias(f"i{i}"),
            F.count_if(present & x.try_cast("double").isNotNull()).alias(f"d{i}"),
            F.count_if(present & x.isin(*CSV_TRUE, *CSV_FALSE)).alias(f"b{i}"),
        ]
    r = df.agg(*checks).first()
    out = []
    for i, c in enumerate(cols):
        p, n_i, n_d, n_b = r[f"p{i}"], r[f"i{i}"], r[f"d{i}"], r[f"b{i}"]
        x = F.trim(q(c))
        if p == 0:
            out.append(q(c).alias(c))
        elif n_i == p:
            out.append(x.try_cast("bigint").alias(c))
        elif n_d == p:
            out.append(x.try_cast("double").alias(c))
        elif n_b == p:
            out.append(x.isin(*CSV_TRUE).alias(c))
        else:
            out.append(q(c).alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, infer: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV with header; pandas NA tokens become null, then types are
    inferred. Quotes inside a cell are doubled. ``multi_line`` reads cells with
    line breaks; Spark cannot split such files, so each file is one task."""
    raw = spark.read.csv(path, sep=sep, header=header, inferSchema=False, multiLine=multi_line, escape='"')
    if not header:
        raw = raw.toDF(*[f"col_{i + 1}" for i in range(len(raw.columns))])
    raw = raw.select(*[_na_to_null(q(c)).alias(c) for c in raw.columns])
    return infer_text_types(raw) if infer else raw


def sniff_separator(spark: SparkSession, path: str, lines: int = 20) -> str:
    """TAB > ';' > ',' judged on the first lines (a bounded sample)."""
    sample = [r.value for r in spark.read.text(path).limit(lines).collect()]
    text = "\n".join(sample)
    for s in SEPARATORS:
        if s in text:
            return s
    return ","


def read_delimited(spark: SparkSession, path: str, has_header: bool = True) -> DataFrame:
    """Delimited text with sniffed separator; headerless columns are col_1..col_n."""
    return read_csv(spark, path, sep=sniff_separator(spark, path), header=has_header)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3; NaN becomes null."""
    return nan_to_null(spark.read.parquet(path))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct leaves become top-level columns named ``a.b``; arrays/maps untouched."""

    def leaves(dt: T.StructType, prefix: list[str]):
        for f in dt.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, path)
            else:
                yield path

    cols = []
    for path in leaves(df.schema, []):
        c = q(path[0])
        for p in path[1:]:
            c = c.getField(p)
        cols.append(c.alias(sep.join(path)))
    return df.select(*cols)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, or an object holding a ``data`` array; flattened.

    Arrays are split over many tasks, whatever the size of a file; an object
    is one record of one task."""
    head = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    if head is not None and head["c"] == "[":
        return read_jsonl(spark, as_lines(spark, path))
    raw = spark.read.json(path, multiLine=True)
    if "data" in raw.columns and isinstance(raw.schema["data"].dataType, T.ArrayType):
        raw = raw.select(F.inline(q("data")))
    return nan_to_null(flatten(raw))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines, flattened."""
    return nan_to_null(flatten(spark.read.json(path)))


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Parquet sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with header (struct/array columns must be flattened first)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def clean_export(df: DataFrame, actions: Sequence[str], path: str) -> DataFrame:
    """Clean, write CSV, and return before/after row and column deltas."""
    from ..operators.quality import clean

    cleaned, _ = clean(df, actions)
    write_csv(cleaned, path)
    before = df.agg(F.count(F.lit(1)).alias("rows_before"))
    after_rows = cleaned.agg(F.count(F.lit(1))).scalar()
    return before.select(
        "rows_before",
        after_rows.alias("rows_after"),
        (F.col("rows_before") - after_rows).alias("rows_removed"),
        F.lit(len(df.columns)).alias("columns_before"),
        F.lit(len(cleaned.columns)).alias("columns_after"),
        F.lit(len(df.columns) - len(cleaned.columns)).alias("columns_removed"),
    )


def page(
    df: DataFrame,
    order_by: Sequence[str],
    page: int = 1,
    page_size: int = 100,
    search: str | None = None,
    sort_col: str | None = None,
    sort_dir: str = "asc",
) -> tuple[DataFrame, DataFrame]:
    """Search -> sort -> 1-based page. Returns (rows with original 1-based
    ``row_number``, info row with filtered_rows/total_pages/page).

    Positions come from range partitions (no single-task window), so deep
    pages cost the same as the first one. ``page_size <= 0`` returns all rows."""
    found = search_condition(df, search) if search else F.lit(True)
    numbered = with_positions(df, list(order_by), name="row_number").where(found)
    if sort_col:
        sc = q(resolve(df, sort_col))
        key = sc.desc_nulls_last() if sort_dir == "desc" else sc.asc_nulls_last()
        ordered = with_positions(numbered, [key, F.col("row_number")], name="__pos")
    elif search:
        ordered = with_positions(numbered, [F.col("row_number")], name="__pos")
    else:
        ordered = numbered.withColumn("__pos", F.col("row_number"))
    # counting needs no positions
    total = df.where(found).agg(F.count(F.lit(1))).scalar()
    if page_size and page_size > 0:
        lo = (max(page, 1) - 1) * page_size
        rows = ordered.where((F.col("__pos") > lo) & (F.col("__pos") <= lo + page_size))
        pages = F.ceil(total / F.lit(page_size))
    else:
        rows = ordered
        pages = F.lit(1)
    info = df.sparkSession.range(1).select(total.alias("filtered_rows"), pages.cast("long").alias("total_pages"), F.lit(page).alias("page"))
    return rows.orderBy("__pos").drop("__pos"), info
