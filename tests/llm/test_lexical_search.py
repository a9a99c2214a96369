"""Operator 13 against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tabulark.llm import lexical_search as ls

from .fixtures import AZ, documents, hostile_texts, prose, rows_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    words = [(i, collections.Counter(TERM.findall((t or "").translate(AZ)))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n_docs, n_terms = len(words), sum(sum(c.values()) for _, c in words)
    df = collections.Counter(t for _, c in words for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in words:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in set(TERM.findall((text or "").translate(AZ))):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is not None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return out


def queries_of(texts, seed=2):
    rng = random.Random(seed)
    out = [(1, None), (2, ""), (3, "nowhere-to-be-found 0xZZZ"), (None, "ein zwei"), (5, "Ein, ZWEI; ein"), (5, "aaaa"), (5, "Ein, ZWEI; ein")]
    for n in range(20):
        words = (rng.choice(texts)[1] or "").split()
        at = rng.randrange(max(1, len(words) - 12))
        out.append((10 + n, " ".join(words[at : at + 12])))
    return out


@pytest.mark.parametrize("many", [False, True])
def test_results_are_those_of_brute_force(spark, many, monkeypatch):
    rng = random.Random(3)
    texts = hostile_texts() + [(None, "ein zwei"), (7, "ein zwei"), (7, "ein zwei"), (200, "naïve CAFÉ café")]
    texts += [(1000 - n, "ein zwei drei") for n in range(40)] + [(2000 + n, prose(rng, 200)) for n in range(60)]
    asked = queries_of(texts)
    if many:
        monkeypatch.setattr(ls, "ITEMS", 3)
        monkeypatch.setattr(ls, "FIRST", 20)
    items = spark.createDataFrame(asked, "item_id long, text string").repartition(2)
    got = ls.search(documents(spark, texts), items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r.values()) for r in rows_of(got)), key=key) == sorted(brute(texts, asked), key=key)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    rows, terms = 400, 60
    sets = [np.sort(rng.choice(terms, rng.integers(1, 20), replace=False)) for _ in range(rows)]
    weight = rng.integers(1, 5000, terms)
    at, first = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    x, root = rng.integers(1, 10**6, len(at)), np.sqrt(weight.astype(float))
    row = np.repeat(np.arange(rows), np.diff(first))
    length = np.sqrt(np.bincount(row, weight[at] * x.astype(float) ** 2))
    bucket = ls.Bucket(at, x, first, length, root)
    for _ in range(20):
        item = rng.choice(terms, 8, replace=False)
        item = item[np.argsort(-weight[item], kind="stable")]
        own = np.zeros(terms, np.int64)
        own[item] = weight[item]
        exact = bucket.scores(np.arange(rows), own)
        for beat in (0, int(np.sort(exact)[-10])):
            bound = bucket.bounds(item, root, beat)
            assert (bound * (1 + ls.SLACK) >= np.where(exact >= beat, exact, 0)).all()
        assert (bound < beat).sum() > rows // 4


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "ein"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ein")], "item_id long, text string")
    assert ls.search(docs.where("false"), items).collect() == []
    assert ls.search(docs, items.where("false")).collect() == []
    assert ls.search(docs.where("doc_id = 2"), items).collect() == []
    assert [tuple(r)[:3] for r in ls.search(docs, items).collect()] == [(1, 1, 1)]
