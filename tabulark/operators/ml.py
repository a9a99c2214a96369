"""Random-forest training, evaluation, explanation and scoring.

Training and scoring are ``pyspark.ml`` pipelines (distributed tree
induction, vectorised transforms). Explanations are DataFrame plans: the
permutation shuffle rotates a feature within hash buckets (a distributed
permutation, no join), partial dependence explodes a quantile grid per row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_numeric, q, resolve
from ..functions.columns import value as cell
from ..functions.ordering import exact_quantiles, quantile_wide
from ..session import cut_lineage, written
from .forest import mean_by_setting, node_table, with_spread
from .profile import modes, value_freq
from .roles import identifier_flags

# Levels of a usable text feature, rows needed to train, rows of
# one training task (the forest keeps about trees x 4 bytes for each)
MAX_LEVELS = 15
MIN_ROWS = 30
TASK_ROWS = 50_000


@dataclass
class TrainedModel:
    """A fitted pipeline plus what scoring needs to prepare new rows."""

    pipeline: PipelineModel
    task: str
    target: str
    numeric: list[str]
    categorical: list[str]
    medians: dict = field(default_factory=dict)
    labels: list[str] = field(default_factory=list)
    feature_names: list[str | None] = field(default_factory=list)
    seed: int = 42

    @property
    def forest(self):
        return self.pipeline.stages[-1]


def model_task(df: DataFrame, target: str) -> DataFrame:
    """Regression for a numeric target with > 10 distinct values, else
    classification; for a binary target, minority share and a < 40% flag."""
    target = resolve(df, target)
    numeric = is_numeric(df.schema[target].dataType)
    vf = value_freq(df, [target]).where(F.col("value").isNotNull())
    s = vf.agg(F.count(F.lit(1)).alias("classes"), F.min("count").alias("mn"), F.sum("count").alias("n"))
    task = F.when(F.lit(numeric) & (F.col("classes") > 10), "regression").otherwise("classification")
    share = F.when((task == "classification") & (F.col("classes") == 2), F.round(F.col("mn") * 100.0 / F.col("n"), 1))
    return s.select(F.lit(target).alias("target"), task.alias("task"), "classes", share.alias("minority_pct"), F.coalesce(share < 40, F.lit(False)).alias("imbalanced"))


def select_features(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """M1 column choice: drop id-like columns (id/index/_id names, or integer
    columns > 95% unique); numerics, plus text columns with <= 15 levels.
    Reads one small per-column fact table."""
    flags = identifier_flags(df).collect()
    facts = {r["column"]: r for r in flags}
    num, cat = [], []
    for f in df.schema.fields:
        if f.name == target:
            continue
        name = f.name.lower()
        r = facts.get(f.name)
        if r is None:
            continue
        ratio = (r["distinct"] or 0) / max(r["rows"] or 1, 1)
        # fixed rule: names, or integers that are nearly all different
        idlike = name in ("id", "index") or name.endswith("_id") or (
            f.dataType.typeName() in ("integer", "long", "short", "byte") and ratio > 0.95
        )
        if idlike:
            continue
        if is_numeric(f.dataType):
            num.append(f.name)
        elif f.dataType.typeName() == "string" and 0 < (r["distinct"] or 0) <= MAX_LEVELS:
            cat.append(f.name)
    return num, cat


def feature_pipeline(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], medians: dict) -> tuple[DataFrame, list]:
    """M1: null targets dropped, numeric nulls <- exact medians, categoricals
    (<= 15 levels) one-hot encoded, assembled into ``features``. Levels are
    indexed alphabetically; a level unseen in training encodes as all zeros
    (trees need no dropped reference level). Returns (prepared frame, stages)."""
    prepared = df.where(q(target).isNotNull()).select(
        *[F.coalesce(cell(df, c).cast("double"), F.lit(medians.get(c))).alias(c) for c in numeric],
        *[F.coalesce(q(c).cast("string"), F.lit("__missing__")).alias(c) for c in categorical],
        q(target),
    )
    stages = []
    enc_out = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetDesc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__ohe", dropLast=True, handleInvalid="keep"))
        enc_out.append(f"{c}__ohe")
    stages.append(VectorAssembler(inputCols=[*numeric, *enc_out], outputCol="features", handleInvalid="keep"))
    return prepared, stages


def split(df: DataFrame, by: str, train_pct: int = 75, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M2: exact ``train_pct``/rest split inside each value of ``by``. Rows get
    seeded random keys that do not depend on their values, so copies of a row
    spread over both sides. A row's place in its class is its place in its
    key bucket plus the sizes of the buckets before it: no task holds a class,
    however large. Written to the shared folder once, so both sides agree."""
    keyed = cut_lineage(df.withColumn("__u", F.rand(seed)))
    size = keyed.groupBy(q(by).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    # about 50,000 rows per (class, bucket)
    buckets = max(1, -(-(size.agg(F.max("__n")).first()[0] or 1) // 50_000))
    keyed = keyed.withColumn("__b", F.floor(F.col("__u") * buckets).cast("int"))
    parts = keyed.groupBy(q(by).alias("__cls"), F.col("__b").alias("__bk")).agg(F.count(F.lit(1)).alias("__k"))
    upto = F.sum("__k").over(Window.partitionBy("__cls").orderBy("__bk").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("__before", upto - F.col("__k")).join(size, F.col("__cls").eqNullSafe(F.col("__c"))).drop("__c", "__k")
    w = Window.partitionBy("__cls", "__bk").orderBy("__u")
    joined = keyed.join(parts, q(by).eqNullSafe(F.col("__cls")) & (F.col("__b") == F.col("__bk")))
    place = F.col("__before") + F.row_number().over(w)
    joined = cut_lineage(joined.withColumn("__train", place <= F.round(F.col("__n") * train_pct / 100.0)))
    cols = [q(c) for c in df.columns]
    return joined.where("__train").select(*cols), joined.where("not __train").select(*cols)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (materialised) in partitions of about ``TASK_ROWS``. Narrow rows
    make few partitions by their bytes, but the forest keeps each with its
    counts for all trees and reads them again at every level."""
    parts = -(-rows.count() // TASK_ROWS)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def train(df: DataFrame, target: str, trees: int = 200, seed: int = 42, max_depth: int | None = None) -> tuple[TrainedModel, DataFrame]:
    """M2: random forest; classification for a text target or <= 10 classes,
    else regression (depth 10 / 12). Returns (model, held-out 25% test frame)."""
    target = resolve(df, target)
    # its facts take several passes; what the caller's columns cost is paid once
    df = written(df)
    task = model_task(df, target).select("task").first()["task"]
    n = df.where(q(target).isNotNull()).agg(F.count(F.lit(1))).first()[0]
    if n < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} rows with a target, have {n}")
    num, cat = select_features(df, target)
    if not num and not cat:
        raise ValueError("no usable feature columns")
    medians = {r["column"]: r["median"] for r in quantile_wide(df, num, [0.5], names=["median"]).collect()} if num else {}
    prepared, stages = feature_pipeline(df, target, num, cat, medians)
    labels: list[str] = []
    if task == "classification":
        prepared = prepared.withColumn("__label_txt", q(target).cast("string"))
        lab = StringIndexer(inputCol="__label_txt", outputCol="__label", stringOrderType="alphabetAsc")
        classes = prepared.select("__label_txt").distinct().count()
        if classes < 2:
            raise ValueError("target has a single class")
        est = RandomForestClassifier(featuresCol="features", labelCol="__label", numTrees=trees, maxDepth=max_depth or 10, seed=seed)
    else:
        prepared = prepared.withColumn("__label", q(target).cast("double"))
        est = RandomForestRegressor(featuresCol="features", labelCol="__label", numTrees=trees, maxDepth=max_depth or 12, seed=seed)
    if task == "classification":
        # fitted on all labelled rows and kept out of the scoring pipeline:
        # rows without a target, or with a class unseen in training, can be scored
        indexer = lab.fit(prepared)
        prepared = indexer.transform(prepared)
        labels = list(indexer.labels)
        tr, te = split(prepared, "__label_txt", seed=seed)
    else:
        tr, te = split(prepared.withColumn("__all", F.lit(0)), "__all", seed=seed)
        tr, te = tr.drop("__all"), te.drop("__all")
    tr, te = dealt(tr), dealt(te)
    pm = Pipeline(stages=[*stages, est]).fit(tr)
    names = list(num)
    for c in cat:
        idx = [s for s in pm.stages if getattr(s, "getOutputCol", lambda: "")() == f"{c}__idx"][0]
        # the indexer keeps a place for unseen levels behind the known ones
        names += [*(f"{c}_{level}" for level in idx.labels), None]
    return TrainedModel(pm, task, target, list(num), list(cat), medians, labels, names, seed), te


def prepare(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Rows shaped like training input (same fills), target kept when present."""
    cols = [F.coalesce(cell(df, c).cast("double"), F.lit(model.medians.get(c))).alias(c) for c in model.numeric]
    cols += [F.coalesce(q(c).cast("string"), F.lit("__missing__")).alias(c) for c in model.categorical]
    extra = [c for c in df.columns if c not in model.numeric and c not in model.categorical]
    out = df.select(*cols, *[q(c) for c in extra])
    if model.target in out.columns:
        if model.task == "classification":
            # null for an unknown target or a class that no labelled row had
            at = F.array_position(F.array(*[F.lit(x) for x in model.labels]), q(model.target).cast("string"))
            out = out.withColumn("__label", F.when(at > 0, (at - 1).cast("double")))
        else:
            out = out.withColumn("__label", q(model.target).cast("double"))
    return out


def score(model: TrainedModel, df: DataFrame) -> DataFrame:
    """M7: batch scoring; classification adds the predicted class and its probability."""
    out = model.pipeline.transform(prepare(model, df))
    if model.task == "classification":
        labels = F.array(*[F.lit(x) for x in model.labels])
        prob = vector_to_array("probability")
        out = out.withColumn("predicted", labels[F.col("prediction").cast("int")]).withColumn("confidence", F.array_max(prob))
    else:
        out = out.withColumn("predicted", F.col("prediction"))
    drop = [c for c in out.columns if c.endswith("__idx") or c.endswith("__ohe") or c in ("features", "rawPrediction", "__label_txt", "__label")]
    return out.drop(*drop)


def _r2(y, p):
    """1 - SSE/SST in one aggregate pass; null for a constant target. The
    variance aggregate updates a mean, so large offsets do not cancel."""
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))


def evaluate(model: TrainedModel, df: DataFrame, digits: int = 4) -> DataFrame:
    """M3: accuracy and weighted F1 (classification) or R2 and MAE
    (regression), as SQL aggregates over the scored rows with a known target."""
    s = model.pipeline.transform(prepare(model, df)).where(F.col("__label").isNotNull())
    if model.task == "classification":
        # rows are scored once; the table of label and prediction is classes x classes
        s = cut_lineage(s.groupBy("__label", "prediction").agg(F.count(F.lit(1)).alias("__n")))
        per = s.groupBy("__label").agg(
            F.sum("__n").alias("support"),
            F.coalesce(F.sum(F.when(F.col("prediction") == F.col("__label"), F.col("__n"))), F.lit(0)).alias("tp"),
        )
        pred_n = s.groupBy(F.col("prediction").alias("__label")).agg(F.sum("__n").alias("pred_n"))
        j = per.join(pred_n, "__label", "left").fillna(0, ["pred_n"])
        f1 = F.when((F.col("support") + F.col("pred_n")) > 0, 2 * F.col("tp") / (F.col("support") + F.col("pred_n"))).otherwise(0.0)
        return j.agg(
            F.round(F.sum("tp") / F.sum("support"), digits).alias("accuracy"),
            F.round(F.sum(f1 * F.col("support")) / F.sum("support"), digits).alias("f1_weighted"),
            F.sum("support").alias("rows"),
        )
    return s.agg(
        F.round(_r2(F.col("__label"), F.col("prediction")), digits).alias("r2"),
        F.round(F.avg(F.abs(F.col("__label") - F.col("prediction"))), digits).alias("mae"),
        F.count(F.lit(1)).alias("rows"),
    )


def importances(model: TrainedModel, top: int = 12, digits: int = 4) -> DataFrame:
    """M4: impurity importances with feature names, top ``top``."""
    vals = model.forest.featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(model.feature_names, vals, strict=True) if n is not None]
    from pyspark.sql import SparkSession

    # one row per model feature: metadata of the fitted model, not table data
    df = SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(top).select("feature", F.round("importance", digits).alias("importance"))


def permutation_importance(
    model: TrainedModel, df: DataFrame, repeats: int = 5, rows_per_range: int = 50_000, digits: int = 4
) -> DataFrame:
    """M5: drop in the metric (accuracy or R2) when one input column is
    permuted, mean and std over ``repeats``.

    For each (feature, repeat) rows get seeded random keys and the column is
    rotated along them: row k takes the value of row k + 1, the last one that
    of the first. Keys are independent of the row's values, so copies of a row
    are spread, and with two rows or more none keeps its own. Rotation runs in
    key ranges of about ``rows_per_range`` rows; the last row of a range takes
    the first value of the next, so the number of ranges never shows."""
    base = cut_lineage(prepare(model, df).where(F.col("__label").isNotNull()).withColumn("__rid", F.monotonically_increasing_id()))
    ranges = max(1, -(-base.count() // rows_per_range))
    feats = [*model.numeric, *model.categorical]
    copies = []
    for r in range(repeats):
        for f in feats:
            # a bijection of the unique row number, as good as a random key
            u = F.xxhash64("__rid", F.lit(r), F.lit(f), F.lit(model.seed))
            keyed = base.withColumn("__u", u).withColumn("__b", F.floor((F.col("__u") / float(1 << 64) + 0.5) * ranges).cast("int"))
            heads = keyed.groupBy("__b").agg(F.min_by(F.struct(q(f).alias("v")), F.struct("__u", "__rid")).alias("h"))
            # one row per range: the first value of the next one, cyclically
            around = Window.orderBy("__b")
            whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            heads = heads.select(F.col("__b").alias("__hb"), F.coalesce(F.lead("h").over(around), F.first("h").over(whole)).alias("__next"))
            w = Window.partitionBy("__b").orderBy("__u", "__rid")
            moved = F.coalesce(F.lead(F.struct(q(f).alias("v"))).over(w), F.col("__next"))["v"]
            c = keyed.join(F.broadcast(heads), F.col("__b") == F.col("__hb")).withColumn(f, moved)
            copies.append(c.select(*base.columns).withColumn("__feature", F.lit(f)).withColumn("__repeat", F.lit(r)))
    orig = base.withColumn("__feature", F.lit(None).cast("string")).withColumn("__repeat", F.lit(-1))
    allc = orig
    for c in copies:
        allc = allc.unionByName(c)
    scored = model.pipeline.transform(allc)
    if model.task == "classification":
        m = scored.groupBy("__feature", "__repeat").agg(F.avg((F.col("__label") == F.col("prediction")).cast("double")).alias("metric"))
    else:
        m = scored.groupBy("__feature", "__repeat").agg(_r2(F.col("__label"), F.col("prediction")).alias("metric"))
    baseline = m.where(F.col("__repeat") == -1).select(F.max("metric")).scalar()
    drops = m.where(F.col("__repeat") >= 0).withColumn("drop", baseline - F.col("metric"))
    return drops.groupBy(F.col("__feature").alias("feature")).agg(
        F.round(F.avg("drop"), digits).alias("importance_mean"), F.round(F.stddev_pop("drop"), digits).alias("importance_std")
    )


def feature_slots(model: TrainedModel) -> dict[str, dict[str | None, int]]:
    """Each input column's places in the feature vector: {None: place} of a
    number, {level: place} of a category."""
    slots: dict[str, dict[str | None, int]] = {c: {None: i} for i, c in enumerate(model.numeric)}
    at = len(model.numeric)
    for c in model.categorical:
        index = next(s for s in model.pipeline.stages if getattr(s, "getOutputCol", lambda: "")() == f"{c}__idx")
        slots[c] = {level: at + k for k, level in enumerate(index.labels)}
        at += len(index.labels) + 1
    return slots


def leading_features(model: TrainedModel, k: int = 2) -> list[str]:
    """The ``k`` input columns with the largest impurity importance, all
    levels of a category together."""
    weight = model.forest.featureImportances.toArray()
    total = {c: sum(float(weight[i]) for i in places.values()) for c, places in feature_slots(model).items()}
    return sorted(total, key=lambda c: (-total[c], c))[:k]


def partial_dependence(model: TrainedModel, df: DataFrame, feature: str, grid: int = 20, digits: int = 4) -> DataFrame:
    """M6: mean prediction (of the second class's probability for two classes)
    with ``feature`` set to each of ``grid`` quantile points (numeric) or each
    level (categorical), over all rows. Equal feature vectors are counted
    first, and each is scored once per grid value inside its task; only sums
    per value leave it."""
    spark = df.sparkSession
    base = model.pipeline.transform(prepare(model, df))
    slots = feature_slots(model)
    if feature in model.numeric:
        probs = [i / (grid - 1) for i in range(grid)] if grid > 1 else [0.5]
        points = sorted({r["value"] for r in exact_quantiles(df, [feature], probs).collect()})
        settings = [(str(v), {slots[feature][None]: float(v)}) for v in points]
    else:
        # at most MAX_LEVELS values at training; a level unseen there sets no place
        values = sorted(r["value"] for r in value_freq(df, [feature]).collect() if r["value"] is not None)
        settings = [(v, {i: float(level == v) for level, i in slots[feature].items()}) for v in values]
    vectors = base.groupBy("features").agg(F.count(F.lit(1)).alias("weight"))
    if model.task == "regression":
        outcome = lambda y: y[:, 0]
    elif len(model.labels) == 2:
        outcome = lambda y: y[:, 1]
    else:
        outcome = lambda y: y.argmax(axis=1).astype(float)
    sums = mean_by_setting(vectors, node_table(model.forest, spark), len(model.feature_names), settings, outcome)
    return sums.select("value", F.round(F.col("total") / F.col("rows"), digits).alias("mean_prediction"), "rows")


def leading_dependence(model: TrainedModel, df: DataFrame, k: int = 2, grid: int = 20) -> DataFrame:
    """M6 for the ``k`` leading features: (feature, value, mean_prediction, rows)."""
    parts = [partial_dependence(model, df, c, grid).select(F.lit(c).alias("feature"), "*") for c in leading_features(model, k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_with_interval(model: TrainedModel, df: DataFrame, z: float = 1.645, digits: int = 4) -> DataFrame:
    """M8: regression prediction with a 90% interval: +- z * population std of
    the per-tree predictions. The columns of ``df`` come first; what
    :func:`train` added to its test rows is left out."""
    if model.task != "regression":
        raise ValueError("intervals are for regression models")
    df = df.select(*[q(c) for c in df.columns if not c.startswith("__label")])
    spread = with_spread(
        model.pipeline.transform(prepare(model, df)).select(*[q(c) for c in df.columns], "features", "prediction"),
        node_table(model.forest, df.sparkSession),
        len(model.feature_names),
    )
    return spread.select(
        *[q(c) for c in df.columns],
        F.round("prediction", digits).alias("prediction"),
        F.round(F.col("prediction") - z * F.col("__sd"), digits).alias("lower"),
        F.round(F.col("prediction") + z * F.col("__sd"), digits).alias("upper"),
    )


def scenario(model: TrainedModel, df: DataFrame, changes: Sequence[tuple[str, str, object]], digits: int = 4) -> DataFrame:
    """M9: score rows before and after ``changes`` [(feature, "set"|"delta"|
    "percent", amount)], each result rounded to 4 dp and a missing number
    counting as 0; percent is v*(1+p/100). Returns the caller's columns with
    ``before``, ``after`` and the change, one row per row: the edited features
    travel in the row, so nothing is joined."""
    edited = {}
    for feat, kind, amount in changes:
        feat = resolve(df, feat)
        numeric = is_numeric(df.schema[feat].dataType)
        c = edited.get(feat, F.coalesce(cell(df, feat).cast("double"), F.lit(0.0)) if numeric else q(feat))
        if kind == "set":
            edited[feat] = F.round(F.lit(float(amount)), 4) if numeric else F.lit(amount).cast("string")
        elif kind == "delta":
            edited[feat] = F.round(c + F.lit(float(amount)), 4)
        elif kind == "percent":
            edited[feat] = F.round(c * (1 + F.lit(float(amount)) / 100.0), 4)
        else:
            raise ValueError(f"unknown change kind {kind!r}")
    inputs = [c for c in df.columns if c in model.numeric or c in model.categorical]
    base = df.withColumn("__row", F.struct(*[q(c) for c in df.columns]))
    start = base.select("__row", *[q(c) for c in inputs], F.struct(*[edited.get(c, q(c)).alias(c) for c in inputs]).alias("__after"))
    first = score(model, start).select("__row", "__after", F.col("predicted").alias("before"))
    second = first.select("__row", "before", *[F.col("__after").getField(c).alias(c) for c in inputs])
    j = score(model, second).select("__row.*", "before", F.col("predicted").alias("after"))
    rows = [q(c) for c in df.columns]
    if model.task == "regression":
        return j.select(
            *rows, F.round("before", digits).alias("before"), F.round("after", digits).alias("after"),
            F.round(F.col("after") - F.col("before"), digits).alias("delta"),
            F.round((F.col("after") - F.col("before")) / F.greatest(F.abs("before"), F.lit(1e-9)) * 100, 2).alias("pct_change"),
        )
    return j.select(*rows, "before", "after", (F.col("before") != F.col("after")).alias("label_changed"))


def feature_defaults(df: DataFrame, features: Sequence[str] | None = None, max_options: int | None = None) -> DataFrame:
    """Default input row: exact medians for numeric features, modes for
    the others, with the sorted options of each categorical feature (null
    above ``max_options`` values, where that is given). ``(feature, kind, default, options)``."""
    feats = list(features) if features else list(df.columns)
    nums = [c for c in feats if is_numeric(df.schema[c].dataType)]
    cats = [c for c in feats if c not in nums]
    parts = []
    if nums:
        med = quantile_wide(df, nums, [0.5], names=["median"])
        parts.append(med.select(F.col("column").alias("feature"), F.lit("numeric").alias("kind"), F.col("median").cast("string").alias("default"), F.lit(None).cast("array<string>").alias("options")))
    if cats:
        md = modes(df, cats)
        vf = value_freq(df, cats).where(F.col("value").isNotNull())
        if max_options is not None:
            small = vf.groupBy("column").agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") <= max_options)
            vf = vf.join(small, "column", "left_semi")
        opts = vf.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("options"))
        parts.append(md.join(opts, "column", "left").select(F.col("column").alias("feature"), F.lit("categorical").alias("kind"), F.col("mode").alias("default"), "options"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
