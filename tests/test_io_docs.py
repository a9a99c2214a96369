import json
import os
import time

from pyspark.sql import functions as F

from tabulark.operators import contract as C
from tabulark.operators import docs as D
from tabulark.sources import io as S
from tabulark.streaming.validate import run_validation


def test_json_flatten_and_jsonl(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "nested.json")
    with open(p, "w") as fh:
        json.dump({"data": [{"id": 1, "user": {"name": "a"}}, {"id": 2, "user": {"name": "b"}}]}, fh)
    df = S.read_json(spark, p)
    assert "user.name" in df.columns and df.count() == 2
    q = os.path.join(tmpdir_path, "rows.jsonl")
    with open(q, "w") as fh:
        fh.write('{"a": 1, "b": 2}\n{"a": 3, "b": 4}\n')
    assert S.read_jsonl(spark, q).count() == 2


def test_csv_na_tokens_types_and_sniffing(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "people.csv")
    with open(p, "w") as fh:
        fh.write("name,age,salary\nann,30,NA\nbo,,2000\ncy,41,3000.5\n")
    df = S.read_csv(spark, p)
    types = dict(df.dtypes)
    assert types == {"name": "string", "age": "bigint", "salary": "double"}
    assert df.where(F.col("salary").isNull()).count() == 1
    t = os.path.join(tmpdir_path, "tabbed.txt")
    with open(t, "w") as fh:
        fh.write("1\tx\n2\ty\n")
    h = S.read_delimited(spark, t, has_header=False)
    assert h.columns == ["col_1", "col_2"] and h.count() == 2


def test_page_and_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "col1 int, col2 string")
    rows, info = S.page(df, ["col1"], page=2, page_size=2)
    assert [r["col1"] for r in rows.collect()] == [3]
    assert info.first()["total_pages"] == 2
    S.write_dataset(df, os.path.join(tmpdir_path, "out.parquet"))
    assert S.read_parquet(spark, os.path.join(tmpdir_path, "out.parquet")).count() == 3
    d = S.clean_export(df.union(df), ["remove_duplicate_rows"], os.path.join(tmpdir_path, "clean.csv")).first()
    assert (d["rows_before"], d["rows_after"]) == (6, 3)


def test_chunks_embeddings_and_search(spark):
    text = ("alpha beta gamma delta " * 60).strip()
    docs = spark.createDataFrame([(1, text), (2, "  short  "), (3, "zeta eta theta " * 40)], "doc_id long, text string")
    ch = D.chunk(docs)
    counts = {r["doc_id"]: r["chunks"] for r in D.doc_summary(ch).collect()}
    assert 2 not in counts and counts[1] == len(range(0, len(text), 520))
    assert max(len(r["text"]) for r in ch.collect()) == 600
    emb = D.embed_hash(ch)
    norms = emb.groupBy("doc_id", "chunk_idx").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms)
    qs = spark.createDataFrame([(10, "gamma delta alpha"), (11, "theta eta")], "query_id long, text string")
    cv, qv = D.embed_arrays(ch), D.embed_arrays(qs, id_cols=("query_id",))
    dense = D.search(cv, qv, k=2).collect()
    sparse = D.search(cv, qv, k=2, query_block=1).collect()
    assert sorted(map(tuple, dense)) == sorted(map(tuple, sparse))
    best = {r["query_id"]: r["doc_id"] for r in dense if r["rank"] == 1}
    assert best == {10: 1, 11: 3}


def test_stream_validation_matches_batch(spark, tmpdir_path):
    base = spark.createDataFrame([(1, "A", 10.0), (2, "B", 20.0), (3, "A", 30.0)], "id long, cat string, v double")
    contract = C.infer_contract(base).collect()
    src = os.path.join(tmpdir_path, "in")
    spark.createDataFrame([(4, "C", "x"), (5, "A", "7")], "id long, cat string, v string").write.parquet(src)
    stream = spark.readStream.schema("id long, cat string, v string").parquet(src)
    q = run_validation(stream, contract, "id", os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck"))
    q.awaitTermination()
    got = {(r["row"], r["code"]) for r in spark.read.parquet(os.path.join(tmpdir_path, "out")).collect()}
    assert got == {(4, "unknown_category"), (4, "type_mismatch")}


def test_vectors_take_tokens_and_norm_once(spark):
    docs = spark.createDataFrame([(1, "ein zwei zwei drei " * 20), (2, "  \n"), (3, None), (4, "a b c " * 20)], "doc_id long, text string")
    emb = D.embed_hash(D.chunk(docs))
    plan = emb._jdf.queryExecution().optimizedPlan().toString().lower()
    # neither all tokens for a test that there are some, nor the norm for each entry
    assert plan.count("regexp_extract_all(") == 1 and "/ sqrt" not in plan and plan.count("regexp_replace(") == 1
    rows = emb.collect()
    assert {r["doc_id"] for r in rows} == {1} and abs(max(r["weight"] for r in rows) - 40 / (40**2 + 20**2 + 20**2) ** 0.5) < 1e-12
