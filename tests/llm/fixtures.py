"""Small hostile tables for the training-data operators."""

import random
import re

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = [a + b + c for a in ("ba", "ko", "ri", "tu", "ñe", "zé") for b in ("lan", "mor", "sti", "ga") for c in ("", "n", "ra", "do")]


def prose(rng, words, lines=3):
    out = [rng.choice(VOCABULARY) for _ in range(words)]
    for _ in range(lines - 1):
        if len(out) > 4:
            k = rng.randrange(1, len(out) - 1)
            out[k] += "\n" + out[k].capitalize()
    return " ".join(out)


def hostile_texts(seed=4):
    """(doc_id, text): nulls, empties, one word, copies, near copies, shared
    passages, repeated lines, a long text, control characters."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    passage = prose(rng, 60, 1)
    rows = [(1, base), (2, None), (3, ""), (4, "  \n\t "), (5, "ein"), (6, "ein zwei"), (7, base), (8, base.upper())]
    words = base.split(" ")
    for i in range(9, 15):
        w = list(words)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        rows.append((i, " ".join(w)))
    rows += [(i, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 25)) for i in range(15, 22)]
    rows += [(22, "same line here\n" * 40), (23, "aaaa" * 400), (24, "\x1c odd \x1f space\x85 here </s> <|endoftext|> ok"), (25, prose(rng, 9000, 50))]
    rows += [(i, prose(rng, rng.randrange(3, 150))) for i in range(26, 60)]
    rows += [(60, None), (61, ""), (62, passage), (63, passage + " " + passage)]
    return rows


def documents(spark, rows, parts=3):
    """The rows with a language, a source and columns whose names clash with
    those that the operators use inside."""
    full = [(i, t, ("en", "de", None)[n % 3], (None, "web", "Zeta", "alpha")[n % 4], len(t or "")) for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("th", "_k", "_maybe", "kept", "node", "key", "size", "_n", "_source", "_row", "score"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(parts)


def rows_of(df):
    return [r.asDict() for r in df.collect()]
