"""Operator 5, best-fit packing with bounds that certify each partition.

Texts are tokenised to pieces of at most ``capacity`` ids; full pieces are
sequences of their own. The others are dealt to partitions of about ``PART``
pieces and packed by best-fit decreasing. Dual-feasible functions give each
partition a lower bound on its sequences; partitions that meet it are proven
optimal. Those with a gap hand the documents of their emptiest sequences to a
common pool, which is dealt and packed again, for as long as that saves
sequences. Only counts reach the driver."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, buffers, shared, text_or_empty

CAPACITY = 4096
EOT = 1
PART = 8192
#: sequences that a partition with a gap gives up, per sequence above its bound
RELEASE = 8
ROUNDS = 6
#: words, and parts of them, whose ids a worker remembers
CACHE, PARTS = 600_000, 300_000

#: words of ASCII and letters of Latin-1, which no Unicode version or form
#: changes; "<" begins all added tokens
_PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+")
#: the tokenizer's split pattern as it is for lower-cased plain words
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: what a tokenizer does to a text before its model, where the above holds
_BEFORE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Parts(dict):
    """Ids of the lower-cased parts of plain words, from the tokenizer's model."""

    def __init__(self, model):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokens = model.tokenize
        bytes_ = ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {c: bytes_.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= PARTS:
            self.clear()
        self[part] = ids = pack_ids([t.id for t in self.tokens(part if part.isascii() else part.translate(self.table))])
        return ids


class WordTokenizer:
    """ids of texts, word by word: the vocabulary drops white space and never
    merges across it, so a text's ids are those of its white-space-separated
    words in turn (a word may hold other white space than that of ASCII). Words already seen come from a bounded memory; so do the
    parts (runs of letters, digits, runs of marks) of plain new words, which the
    tokenizer's model encodes one by one. Any other word, and all of them with
    a tokenizer that prepares texts otherwise, takes the tokenizer's whole way."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        self.known: dict[str, bytes] = {}
        before = tuple(x and json.loads(x.__getstate__()) for x in (self.model.normalizer, self.model.pre_tokenizer))
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.parts = _Parts(self.model.model) if before == _BEFORE and all("<" in t for t in added) else None

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        here = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        new = [w for w in here if w not in known]
        if len(known) + len(new) > CACHE:
            # the words of these texts stay, frequent ones among them
            self.known = known = {w: known[w] for w in here if w in known}
        todo = new
        if self.parts is not None:
            part, todo = self.parts.__getitem__, []
            for w in new:
                if _PLAIN.fullmatch(w):
                    known[w] = part(w.lower()) if w.isalpha() else b"".join(map(part, _PARTS.findall(w.lower())))
                else:
                    todo.append(w)
        for w, e in zip(todo, self.encode(todo, add_special_tokens=False), strict=True):
            known[w] = pack_ids(e.ids)
        # the ids of each word in turn, gathered from those of the different words
        each = [known[w] for w in here]
        ids = np.frombuffer(b"".join(each), "<u4")
        sizes = np.array([len(x) // 4 for x in each], np.int64)
        code = coded.indices.to_numpy()
        n = sizes[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = ids[np.repeat((np.cumsum(sizes) - sizes)[code] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cut = 4 * ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [raw[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _tokenise(path: str | None, capacity: int, eot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # for each task anew: kept by the process, the words would take memory from later stages
        tok = WordTokenizer(path or default_tokenizer())
        end = np.array([eot], "<u4").tobytes()
        for b in batches:
            texts = b.column("text")
            for i, j in blocks(buffers(texts)[1], 1 << 21):
                row, piece, start, ids = [], [], [], []
                for k, x in enumerate(tok.ids(texts.slice(i, j - i))):
                    x += end
                    for n, s in enumerate(range(0, len(x), 4 * capacity)):
                        row.append(i + k)
                        piece.append(n)
                        start.append(s // 4)
                        ids.append(x[s : s + 4 * capacity])
                cols = [b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64())]
                cols += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids"])

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, eot: int = EOT) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit): the
    ids of each text and the end id, cut every ``capacity`` ids. A null text
    is empty and gives one piece that holds the end id. ``tokenizer`` is a path
    that every worker can open; without one each looks up the public one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_tokenise(tokenizer, capacity, eot), f"doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length by best-fit decreasing. A big integer has one bit for
    each free space that some open bin has."""
    out = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            space, b = capacity, bins
            bins += 1
        out[i] = b
        if space > n:
            free[space - n].append(b)
            mask |= 1 << (space - n)
    return out


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Largest bound of two families of dual-feasible functions: those that
    round pieces above capacity - e up and drop pieces below e, and those that
    round (k + 1) x down, k = 1 to 12."""
    if not len(lengths):
        return 0
    x = np.asarray(lengths, np.int64)
    count = np.bincount(x, minlength=capacity + 1)
    mass = np.cumsum(count * np.arange(capacity + 1))
    many = np.cumsum(count)
    e = np.arange(1, capacity // 2 + 1)
    large = len(x) - many[capacity - e]
    middle = mass[capacity - e] - mass[e - 1]
    best = max(-(-int(mass[-1]) // capacity), int((large + -(-middle // capacity)).max()))
    sizes = np.arange(capacity + 1)
    for k in range(1, 13):
        scaled = (k + 1) * sizes
        # k * f(x), an integer unless (k + 1) x is a multiple of the capacity
        value = np.where(scaled % capacity == 0, k * sizes / capacity, scaled // capacity)
        best = max(best, int(np.ceil((value * count).sum() / k - 1e-9)))
    return best


def _pack_part(capacity: int, release: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_p")
        n = p["length"].to_numpy()
        b = best_fit(n, capacity)
        fill = np.bincount(b, n)
        gap = len(fill) - lower_bound(n, capacity)
        # the emptiest sequences are given up: a function of the gap alone
        out = np.argsort(fill, kind="stable")[: min(len(fill), (release + 1) * gap)] if gap > 0 else []
        order = np.argsort(b, kind="stable")
        ends = np.cumsum(n[order])
        before = np.concatenate([[0], np.cumsum(fill.astype(np.int64))])
        offset = np.empty(len(n), np.int64)
        offset[order] = ends - n[order] - before[b[order]]
        cols = {"_p": p["_p"].to_numpy(), "length": n, "offset": offset, "_part": p["_part"].to_numpy(), "_bin": b, "_open": np.isin(b, out)}
        return pd.DataFrame(cols)

    return run


def place(sized: DataFrame, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """``sized`` (materialised: bigint ``_p`` unique, long ``length``, at most
    ``capacity``) to _p, sequence_id, offset."""
    full = sized.where(F.col("length") == capacity).select("_p", (F.lit(1 << 62) + F.col("_p")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = sized.where(F.col("length") < capacity).select("_p", "length")
    done: list[DataFrame] = []
    kept, bins = None, 0
    schema = "_p long, length long, offset long, _part int, _bin long, _open boolean"
    for r in range(ROUNDS):
        parts = max(1, -(-todo.count() // part))
        dealt = todo.withColumn("_part", F.pmod(F.xxhash64(F.lit(r), "_p"), F.lit(parts)).cast("int"))
        packed = shared(dealt.groupBy("_part").applyInPandas(_pack_part(capacity, RELEASE), schema))
        packed = packed.withColumn("sequence_id", F.lit(r << 56) + F.col("_part").cast("long") * (1 << 24) + F.col("_bin"))
        sums = packed.groupBy("_part").agg(
            (F.max("_bin") + 1).alias("all"), F.count_distinct(F.when(F.col("_open"), F.col("_bin"))).alias("open")
        ).agg(F.sum("all").alias("all"), F.sum("open").alias("open")).first()
        if kept is not None and (sums["all"] or 0) >= bins:
            # the pool did not get smaller: its earlier sequences stand
            done.append(kept)
            kept = None
            break
        done.append(packed.where(~F.col("_open")))
        if not sums["open"]:
            kept = None
            break
        kept, bins = packed.where("_open"), sums["open"]
        todo = kept.select("_p", "length")
    if kept is not None:
        done.append(kept)
    rest = done[0]
    for d in done[1:]:
        rest = rest.unionByName(d)
    return full.unionByName(rest.select("_p", "sequence_id", "offset"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with
    ``ids``, the ids themselves (they are then written once to the shared
    folder): everything a writer of sequences needs.

    Null texts are empty. Rows that repeat are packed each on its own. An
    empty table gives an empty result; other columns are not read."""
    cut = pieces(docs, id_col, text_col, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids"))
    if not ids:
        cut = cut.drop("ids")
    cut = shared(cut.withColumn("_p", F.monotonically_increasing_id()))
    placed = place(cut.select("_p", "length"), capacity)
    return cut.join(placed, "_p").drop("_p")
