"""JSON arrays read by many tasks.

Spark reads a file that holds one JSON array as a single record in a single
task. Here it is read as text split at closing braces, which Spark can do from
any byte on. Whether a brace closes a record depends on all text before it, so
a first pass sums up each block of a file as what it does to a scanner that
enters it outside a string, inside one, or behind a backslash; these summaries
are chained along the file (one small row per block, like the file listing).
A second pass then enters every block in the right state and cuts its records;
only a record that crosses a border between blocks is put together by a
shuffle. The records are kept as JSON Lines in the shared folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, written

#: states of the scanner
OUT, IN, ESCAPED = 0, 1, 2
_MARK = re.compile(r'["\\{}\[\]]')
_QUOTE = re.compile(r'["\\]')


def step(text: str, state: int) -> tuple[int, int]:
    """(state behind ``text``, change of nesting depth)."""
    depth, i, n = 0, 0, len(text)
    while i < n:
        if state == ESCAPED:
            state, i = IN, i + 1
            continue
        m = (_QUOTE if state == IN else _MARK).search(text, i)
        if m is None:
            break
        c, i = m.group(), m.end()
        if state == IN:
            state = OUT if c == '"' else ESCAPED
        elif c == '"':
            state = IN
        elif c != "\\":
            depth += 1 if c in "{[" else -1
    return state, depth


def pieces(text: str, state: int, depth: int) -> Iterator[tuple[str, int, int]]:
    """``text`` cut behind every record, i.e. where the depth comes back to 1,
    with the state and depth there; the last piece may end anywhere."""
    start, i, n = 0, 0, len(text)
    while i < n:
        if state == ESCAPED:
            state, i = IN, i + 1
            continue
        m = (_QUOTE if state == IN else _MARK).search(text, i)
        if m is None:
            break
        c, i = m.group(), m.end()
        if state == IN:
            state = OUT if c == '"' else ESCAPED
        elif c == '"':
            state = IN
        elif c != "\\":
            depth += 1 if c in "{[" else -1
            if depth == 1 and c == "}":
                yield text[start:i], state, depth
                start = i
    if start < n:
        yield text[start:], state, depth


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    """(file, start of the block, text); a split text has lost its brace."""
    for b in batches:
        yield from zip(b.column("path").to_pylist(), b.column("block").to_pylist(), b.column("value").to_pylist(), strict=True)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does to a scanner, for each state it may enter in."""
    at, ways = None, []

    def row():
        cols = [[at[0]], [at[1]], [[w[0] for w in ways]], [[w[1] for w in ways]]]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "block", "state", "depth"])

    for path, block, text in _segments(batches):
        if (path, block) != at:
            if at is not None:
                yield row()
            at, ways = (path, block), [(s, 0) for s in (OUT, IN, ESCAPED)]
        for k, (s, d) in enumerate(ways):
            s, more = step(text + "}", s)
            ways[k] = (s, d + more)
    if at is not None:
        yield row()


def _cut(entries):
    """Whole records of each block (side -1), and the pieces at its ends: up to
    its first record border (0) and behind its last one (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, depth, held, first, out = None, OUT, 0, [], True, []

        def flush(final: bool):
            rows, out[:] = list(out), []
            if final and held:
                rows.append((at[0], at[1], 1, "".join(held)))
                held.clear()
            if rows:
                names, kinds = ("path", "block", "side", "value"), (pa.string(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

        for path, block, text in _segments(batches):
            if (path, block) != at:
                yield from flush(True)
                at, first = (path, block), True
                state, depth = entries.value[at]
            for piece, after, deep in pieces(text + "}", state, depth):
                held.append(piece)
                state, depth = after, deep
                if state == OUT and depth == 1 and piece.endswith("}"):
                    # the text before the first border may have begun in an earlier block
                    out.append((at[0], at[1], 0 if first else -1, "".join(held)))
                    first = False
                    held.clear()
            if len(out) >= 10_000:
                yield from flush(False)
        yield from flush(True)

    return run


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the text of each object of the JSON arrays in the files at
    ``path``, without line breaks. Elements that are no objects are left out."""
    text = spark.read.option("lineSep", "}").text(path)
    text = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    blocks = text.mapInArrow(_summaries, "path string, block long, state array<int>, depth array<long>").collect()
    entries, last, state, depth = {}, None, OUT, 0
    for b in sorted(blocks, key=lambda r: (r["path"], r["block"])):
        if b["path"] != last:
            last, state, depth = b["path"], OUT, 0
        entries[b["path"], b["block"]] = (state, depth)
        state, depth = b["state"][state], depth + b["depth"][state]
    cut = written(text.mapInArrow(_cut(spark.sparkContext.broadcast(entries)), "path string, block long, side int, value string"))
    # a record that crosses borders: the end of one block, perhaps whole blocks,
    # and the start of the block that has its border, which names the chain
    borders = {(r["path"], r["block"]) for r in cut.where("side = 0").select("path", "block").collect()}
    chain, rows = None, []
    for path_, block in sorted(entries, reverse=True):
        if chain is None or chain[0] != path_:
            chain = (path_, None)
        rows.append((path_, block, 1, chain[1]))
        if (path_, block) in borders:
            chain = (path_, block)
            rows.append((path_, block, 0, block))
    chains = spark.createDataFrame(rows, "path string, block long, side int, chain long")
    ends = cut.where("side >= 0").join(chains, ["path", "block", "side"]).where("chain is not null")
    parts = F.array_sort(F.collect_list(F.struct("block", "side", "value")))
    chained = ends.groupBy("path", "chain").agg(F.concat_ws("", F.transform(parts, lambda p: p["value"])).alias("value")).select("value")
    record = cut.where("side < 0").select("value").unionByName(chained)
    plain = F.regexp_replace("value", r"[\r\n]", " ")
    # what lies between two records: the opening bracket, commas, other elements
    return record.select(F.regexp_replace(plain, r"^[^{]*", "").alias("value")).where(F.length("value") > 0)


def as_lines(spark: SparkSession, path: str) -> str:
    """The arrays at ``path`` as JSON Lines in the shared folder: its path."""
    out = f"{checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    array_records(spark, path).write.text(out)
    return out
