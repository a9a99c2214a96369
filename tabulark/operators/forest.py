"""A fitted forest as one table of nodes, evaluated for all trees at once.

The nodes come from the forest's own saved form, so reading them costs one
small job whatever the number of trees. Workers get them as arrays and take
all rows of a batch down all trees level by level."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: rows that go down the trees together
ROWS = 1 << 11


def node_table(forest, spark) -> dict[str, np.ndarray]:
    """Arrays over all nodes of all trees: ``feature`` (-1 in a leaf),
    ``threshold``, ``below`` (bits of the categories that go left, 0 for a
    threshold), ``left``, ``right``, and ``value``: the prediction or the class
    shares; ``root`` has the first node of each tree. The size is that of the
    model: trees times nodes."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    forest.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").toPandas()
    tree = nodes["treeID"].to_numpy()
    root = np.searchsorted(tree, np.arange(tree[-1] + 1))
    feature = np.array([s["featureIndex"] for s in nodes["split"]])
    cut = [s["leftCategoriesOrThreshold"] for s in nodes["split"]]
    ordered = np.array([s["numCategories"] == -1 for s in nodes["split"]])
    leaf = nodes["leftChild"].to_numpy() < 0
    classes = hasattr(forest, "numClasses")
    stats = np.stack(nodes["impurityStats"].to_numpy()) if classes else None
    return {
        "feature": np.where(leaf, -1, feature),
        "threshold": np.array([c[0] if o and len(c) else 0.0 for c, o in zip(cut, ordered, strict=True)]),
        "below": np.array([0 if o else sum(1 << int(v) for v in c) for c, o in zip(cut, ordered, strict=True)], np.int64),
        "ordered": ordered,
        # a node's children by their place in the table
        "left": np.where(leaf, 0, nodes["leftChild"].to_numpy() + root[tree]),
        "right": np.where(leaf, 0, nodes["rightChild"].to_numpy() + root[tree]),
        "value": stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300) if classes else nodes["prediction"].to_numpy()[:, None],
        "root": root,
    }


def tree_values(nodes: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """(rows, trees, values) of the leaves that the rows of ``x`` end in."""
    at = np.tile(nodes["root"], (len(x), 1))
    row = np.arange(len(x))[:, None]
    while True:
        f = nodes["feature"][at]
        if (f < 0).all():
            return nodes["value"][at]
        v = x[row, np.maximum(f, 0)]
        with np.errstate(invalid="ignore"):
            low = v <= nodes["threshold"][at]
            bit = nodes["below"][at] >> np.clip(np.nan_to_num(v), 0, 62).astype(np.int64) & 1
        go = np.where(nodes["ordered"][at], low, bit == 1)
        at = np.where(f < 0, at, np.where(go, nodes["left"][at], nodes["right"][at]))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, ROWS):
        yield b.slice(i, ROWS)


def with_spread(scored: DataFrame, nodes: dict[str, np.ndarray], width: int) -> DataFrame:
    """``scored`` (with ``features``) plus ``__mean`` and ``__sd``: mean and
    population deviation of the trees' predictions."""
    sent = scored.sparkSession.sparkContext.broadcast(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _blocks(whole):
                y = tree_values(sent.value, _matrix(b.column("__x"), width))[:, :, 0]
                cols = [b.column(c) for c in b.schema.names if c != "__x"]
                names = [c for c in b.schema.names if c != "__x"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(y.mean(axis=1)), pa.array(y.std(axis=1))], [*names, "__mean", "__sd"])

    rows = scored.withColumn("__x", vector_to_array("features")).drop("features")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__x")
    return rows.mapInArrow(run, f"{fields}, __mean double, __sd double")


def mean_by_setting(vectors: DataFrame, nodes: dict[str, np.ndarray], width: int, settings: list[tuple[str, dict[int, float]]], outcome: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(value, total, rows) for each of ``settings`` (value, entries of the
    feature vector that it sets) over ``vectors`` (features, weight), each
    different vector once. ``outcome``: leaf values averaged over the trees,
    (rows, values), to one number per row. Partial sums leave a task, no rows."""
    sent = vectors.sparkSession.sparkContext.broadcast(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(settings)), 0
        for whole in batches:
            for b in _blocks(whole):
                x, weight = _matrix(b.column("__x"), width), b.column("weight").to_numpy()
                rows += int(weight.sum())
                for k, (_, entries) in enumerate(settings):
                    moved = x.copy()
                    for i, v in entries.items():
                        moved[:, i] = v
                    total[k] += outcome(tree_values(sent.value, moved).mean(axis=1)) @ weight
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in settings]), pa.array(total), pa.array([rows] * len(settings))], ["value", "total", "rows"])

    sums = vectors.select(vector_to_array("features").alias("__x"), "weight").mapInArrow(run, "value string, total double, rows long")
    return sums.groupBy("value").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
