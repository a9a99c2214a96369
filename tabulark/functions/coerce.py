"""Null-on-failure coercions (F6, F7). ANSI mode is on, so plain casts raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import dtype_of, is_numeric, q, value

# The accepted date/time layouts for mixed-format text dates, tried
# in this order (first match wins).
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "yyyyMMdd",
    "MMM d, yyyy",
    "d MMM yyyy",
    "MMMM d, yyyy",
)

# The leading shape every layout above can produce (a cheap
# pre-check so text that cannot be a date skips the parse attempts).
DATE_SHAPE = r"^(\d{1,4}[-/.]\d|\d{8}$|\d{1,2} [A-Za-z]{3}|[A-Za-z]{3,9} \d)"

# Text tokens read as booleans (lower-cased, trimmed).
TRUE_TOKENS = ("true", "yes", "1")
FALSE_TOKENS = ("false", "no", "0")

# Text read as missing on CSV ingestion (pandas defaults).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# The characters Python's str.split() treats as whitespace, as a
# regex class (works in Java regex and RE2).
PY_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(c, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def to_number(c: Column) -> Column:
    """F6 for text: try_cast(trim(string) as double); bad text and text that
    reads as NaN -> null."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def number(df: DataFrame, name: str) -> Column:
    """F6 for any column as double: a numeric column is cast, never rendered
    as text; NaN is missing."""
    return value(df, name).cast("double") if is_numeric(dtype_of(df, name)) else to_number(q(name))


def to_timestamp_mixed(c: Column, formats=DATE_FORMATS) -> Column:
    """first layout that parses; bad text -> null."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(DATE_SHAPE), F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]))


def is_blank(c: Column) -> Column:
    """Missing for validation: null, or nothing but white space."""
    return c.isNull() | (strip(c.cast("string")) == "")
