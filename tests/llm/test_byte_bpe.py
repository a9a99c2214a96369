"""Operator 12 against the tokenizer library on whole texts."""

import hashlib
import random
import struct

import pytest

from tabulark.llm import byte_bpe as bb
from tabulark.llm.queries import QUERIES

from .fixtures import SF, documents, hostile_texts, rows_of


def awkward_texts():
    rng = random.Random(1)
    mixed = " ".join(rng.choice(["foo", "bar's", "12", "  x", "\n\nñ", "日本語，", "'re", "!!"]) for _ in range(2000))
    rows = [(1, None), (2, ""), (3, mixed), (4, mixed), (None, mixed), (5, "a" * 5000), (6, "it's  \n\n ok </s><|endoftext|>")]
    rows += [(7, "日本語" * 2000), (8, "foo " * 900 + "'" * 3000 + "s" * 100), (9, " " * 4000), (10, "x " + "\n" * 3000 + "y")]
    return [*rows, (10, "é" * 300 + "՘՘ a" * 500), (11, "''st" * 2000), (12, "\U0001f600" * 900), *hostile_texts()]


@pytest.mark.parametrize(("chunk", "overlap"), [(500, 60), (64, 8), (1 << 16, 1024)])
def test_ids_are_those_of_whole_texts(spark, chunk, overlap):
    texts = awkward_texts()
    got = bb.decode(bb.encode(documents(spark, texts), chunk=chunk, overlap=overlap))
    assert got.columns == ["doc_id", "ids", "decoded"]
    own = bb.encoding()
    want = [(str(i), b"".join(struct.pack("<I", x) for x in own.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts]
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in rows_of(got)) == sorted(want)


def test_long_texts_are_cut_where_chunks_agree(spark):
    text = " ".join(f"word{i}" for i in range(3000))
    p = bb.boundaries(text)
    assert len(p) > 2000 and all(text[x - 1] != " " for x in p)
    assert not len(bb.boundaries("a" * 3000)) and not len(bb.boundaries(" " * 3000))


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bb.decode(bb.encode(empty)).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bytes(bb.decode(nothing).first()["decoded"]) == b""


def test_registered_query(spark):
    own = bb.encoding()
    got = {r["doc_id"]: r for r in QUERIES["op12_byte_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = own.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(struct.pack("<I", x) for x in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
