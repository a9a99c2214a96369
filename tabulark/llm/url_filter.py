"""Operator 9, URL filters: curated rules first, gradient-boosted trees on
lexical features for the rest (DataFrame functions and MLlib only).

Features: length, depth, digit ratio, entropy of the characters, counts of
parameters, hyphens and host labels, and statistics of the host's last label
(its length and its share of all rows). The trees are fitted on a bounded
sample of labelled URLs."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: labelled URLs the trees are fitted on, about this many (a uniform hash sample)
SAMPLE_ROWS = 20_000
TREES, DEPTH = 12, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("f_length", "f_host_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_labels", "f_suffix_length", "f_suffix_share")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; from there up to ``?``, ``#`` or the end. Both are
    empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, or null.
    A rule ``host/path`` fits its host and all subdomains where the url's path
    starts with the rule's."""
    best = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        cut = rule.index("/")
        of, start = rule[:cut], rule[cut:]
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        best = F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features but the suffix share, doubles without nulls."""
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    letters = F.array_distinct(F.split(url, ""))

    def part(c: Column) -> Column:
        p = (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
        return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))

    suffix = F.substring_index(host, ".", -1)
    return {
        "f_length": F.length(url),
        "f_host_length": F.length(host),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "f_digits": F.regexp_count(url, F.lit("[0-9]")) / n,
        "f_entropy": F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + part(c)),
        "f_params": F.when(F.instr(url, "?") > 0, F.regexp_count(F.substring_index(url, "?", -1), F.lit("[&;]")) + 1).otherwise(0),
        "f_hyphens": F.regexp_count(url, F.lit("[-_]")),
        "f_labels": F.size(F.split(host, r"\.")),
        "f_suffix_length": F.length(suffix),
    }


def describe(pages: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = parts(url)
    rows = pages.select(*keep, url.alias("_url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_suffix", F.substring_index("host", ".", -1))
    return rows.withColumns({k: v.cast("double") for k, v in lexical(F.col("_url"), F.col("host"), F.col("path")).items()})


def suffix_shares(rows: DataFrame) -> DataFrame:
    """Share of all rows of each last host label."""
    counts = rows.groupBy("_suffix").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 1
    return counts.select("_suffix", (F.col("_n") / F.lit(float(total))).alias("f_suffix_share"))


def fit(rows: DataFrame, label: str = "_label", seed: int = 5):
    """Trees on a sample of described rows with a 0/1 label, or the only label
    (0.0 or 1.0, None without rows) where there is just one."""
    labelled = rows.where(F.col(label).isNotNull())
    kinds = {int(x[label]): x.n for x in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return next(iter(kinds), None)
    part = int((1 << 20) * min(1.0, SAMPLE_ROWS / sum(kinds.values())))
    sample = labelled.where(F.pmod(F.xxhash64(F.lit(seed), "_url"), F.lit(1 << 20)) < part)
    sample = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(sample).select("_x", F.col(label).cast("double").alias("_y"))
    gbt = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=TREES, maxDepth=DEPTH, seed=seed, checkpointInterval=-1)
    return gbt.fit(sample.coalesce(8))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row.

    A fitting rule decides (the longest wins). Other URLs, empty and null ones
    included, are judged by the trees: block from a score of 0.5. ``labelled``
    (url, block 0/1) are the URLs to learn from; by default those of ``pages``
    that a rule decides. Without labelled URLs the method allows, with labels
    of one kind it repeats it. Repeated rows are judged alike; other columns
    are not read."""
    rows = describe(pages.withColumn("_id", F.col(id_col)), url_col, ("_id",))
    shares = suffix_shares(rows)
    rows = rows.withColumn("_hit", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.join(shares, "_suffix", "left").fillna(0.0, ["f_suffix_share"])
    if labelled is None:
        known = rows.withColumn("_label", F.when(F.col("_hit.verdict") == "block", 1).when(F.col("_hit.verdict") == "allow", 0))
    else:
        known = describe(labelled.withColumnRenamed("block", "_label"), "url", ("_label",))
        known = known.join(shares, "_suffix", "left").fillna(0.0, ["f_suffix_share"])
    model = fit(known)
    if model is None or isinstance(model, int):
        scored = rows.withColumn("score", F.lit(float(model or 0)))
    else:
        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(rows))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    method = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        F.col("_id").alias("page_id"), "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce(F.col("_hit.verdict"), method).alias("verdict"), "score"
    )
