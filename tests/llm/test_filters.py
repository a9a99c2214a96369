"""Operators 1, 9 and 10: held-out accuracy, brute force and edge cases."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabulark.llm.language_id import identify
from tabulark.llm.queries import QUERIES, URL_RULES
from tabulark.llm.quality_rules import BASE, IsolationForest, calibrate, judge, rule_statistics
from tabulark.llm.url_filter import describe, judge_urls

from .fixtures import SF, WORD, documents, hostile_texts, prose, rows_of


def test_language_id_on_held_out_rows(spark):
    out = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = rows_of(out.join(docs, "doc_id"))
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if r["held_out"]} and len(rows) == 1000
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    sure = [r for r in held if r["accepted"]]
    assert len(sure) > 0.9 * len(held) and sum(r["lang"] != r["lang_pred"] for r in sure) <= 0.03 * len(sure)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_edges(spark):
    texts = [(i, t) for i, t in hostile_texts() if i != 25] + [(None, "bala"), (90, "123 %% --"), (91, "漢字"), (92, "é")]
    out = {r["doc_id"]: r for r in rows_of(identify(documents(spark, texts)))}
    for i, t in texts:
        letters = any(map(str.isalpha, t or ""))
        assert (out[i]["lang_pred"] == "und") == (not letters) and (letters or out[i]["score"] == 0)
    assert not out[None]["held_out"]
    unlabelled = documents(spark, texts).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in rows_of(identify(unlabelled))} == {"und"}
    assert rows_of(identify(documents(spark, texts).where("false"))) == []


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    cover = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover))


def test_rule_statistics(spark):
    texts = [*hostile_texts(), (80, "a | b <c>\n\n a\r\na\n a\n"), (81, "w " * 30), (82, "\n\n"), (None, "é é")]
    out = rows_of(rule_statistics(documents(spark, texts)))
    assert {(r["doc_id"], *(r[c] for c in BASE)) for r in out} == {(i, *brute_statistics(t)) for i, t in texts}


def test_forest_rejects_what_good_texts_never_show(spark):
    rng = random.Random(1)
    good = [(i, prose(rng, 80)) for i in range(400)]
    bad = [(1000 + i, " ".join(w + "%%$" for w in prose(rng, 60).split())) for i in range(40)]
    texts = good + bad + [(2000, "short"), (2001, None)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in texts[::2]] + [(None, 1), (0, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in rows_of(judge(documents(spark, texts), labels))}
    assert not any(out[i]["kept"] for i, _ in bad) and sum(out[i]["kept"] for i, _ in good) >= 396
    assert out[2000]["base_failed"] and out[2001]["base_failed"] and not out[2000]["kept"]
    # without labels of both kinds only the base rules reject
    for some in (None, labels.where("quality = 1"), labels.where("false")):
        assert all(r["kept"] != r["base_failed"] for r in rows_of(judge(documents(spark, texts), some)))
    assert rows_of(judge(documents(spark, texts).where("false"), labels)) == []


def test_calibration():
    assert calibrate({}) == 2.0 and calibrate({5: (10, 0)}) == 2.0
    assert calibrate({3000: (0, 5), 100: (1000, 1)}, 0.001) == 3000 / 4096
    import numpy as np

    f = IsolationForest(np.zeros((1, 2)), np.zeros(2), np.zeros(2))
    assert (f.score(np.ones((3, 2))) <= 1).all()


URLS = [
    ("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("HTTPS://EXAMPLE.NET/de/1?x=/en/", "example.net", "/de/1", "net/", "block"),
    ("http://example.com/de/#t", "example.com", "/de/", "example.com/de/", "block"),
    ("x://b.ORG/fr/a?b#c", "b.org", "/fr/a", "org/fr/", "allow"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("http://a.net", "a.net", "", None, None),
    ("http://a.net?x/", "a.net", "", None, None),
    ("a.net/en/", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("http://É.example.net/en/x://y", "É.example.net", "/en/x://y", "example.net/en/", "allow"),
    ("http://net/", "net", "/", "net/", "block"),
]


def test_url_rules_and_parts(spark):
    pages = spark.createDataFrame([(n, u[0], "h", "p") for n, u in enumerate(URLS)], "page_id long, url string, host string, path string")
    out = {r["page_id"]: r for r in rows_of(judge_urls(pages, URL_RULES))}
    for n, (_, host, path, rule, verdict) in enumerate(URLS):
        r = out[n]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert rows_of(judge_urls(pages.where("false"), URL_RULES)) == []
    assert {r["verdict"] for r in rows_of(judge_urls(pages, []))} == {"allow"}


def test_url_trees_learn_from_labels(spark):
    rng = random.Random(2)
    rows = [(f"http://h{i % 50}.example.{'xyz' if bad else 'org'}/{'9' * rng.randrange(8, 20) if bad else 'page/about'}{i}", int(bad)) for i in range(1200) for bad in [i % 3 == 0]]
    labelled = spark.createDataFrame(rows[:800], "url string, block int")
    pages = spark.createDataFrame([(n, u) for n, (u, _) in enumerate(rows)], "page_id long, url string")
    out = {r["page_id"]: r["verdict"] == "block" for r in rows_of(judge_urls(pages, [], labelled))}
    assert sum(out[n] == bool(rows[n][1]) for n in range(800, 1200)) >= 392


@pytest.mark.parametrize("url", ["http://a.b-c.org/x/y1?p=1&q=2", "", "x"])
def test_url_features(spark, url):
    import math

    r = rows_of(describe(spark.createDataFrame([(url,)], "url string")))[0]
    n = max(len(url), 1)
    entropy = -sum(k / n * math.log2(k / n) for k in collections.Counter(url).values())
    assert r["f_length"] == len(url) and abs(r["f_entropy"] - entropy) < 1e-9
    assert abs(r["f_digits"] - sum(c.isdigit() for c in url) / n) < 1e-9
    if url.startswith("http"):
        assert (r["f_depth"], r["f_params"], r["f_labels"], r["f_suffix_length"], r["f_hyphens"]) == (2, 2, 3, 3, 1)


def test_native_operators_run_no_python(spark):
    for key in ("op8_chat_format", "op9_url_filter"):
        plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), key
