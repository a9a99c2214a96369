"""The read-only guard, NaN literals, p-values and hashed vectors."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from tabulark.functions.stats import incomplete_beta, p_value_f, p_value_t
from tabulark.operators import aggregate as A
from tabulark.operators import docs as D
from tabulark.operators import filters as FL

REFUSED = [
    r"SELECT '\nCTE [other]\n' AS x, s FROM other",
    "SELECT reflect('java.lang.System', 'currentTimeMillis') FROM data",
    "SELECT java_method('java.lang.System', 'currentTimeMillis')",
    "SELECT try_reflect('java.lang.System', 'currentTimeMillis')",
    "SELECT * FROM range(5)",
    "SELECT * FROM other",
    "SELECT * FROM parquet.`/tmp/x`",
    "SELECT * FROM default.data",
    "SELECT * FROM data WHERE a IN (SELECT s FROM other)",
    "SELECT (SELECT max(s) FROM other) FROM data",
    "SELECT * FROM other WHERE EXISTS (WITH other AS (SELECT 1 AS s) SELECT * FROM other)",
    "WITH b AS (SELECT * FROM c), c AS (SELECT * FROM data) SELECT * FROM b",
    "INSERT INTO data SELECT 1",
    "DROP TABLE data",
    "SELECT 1; SELECT 2",
    "SELECT no_such_function(a) FROM data",
    "SET x=1",
    "SELECT input_file_name() FROM data",
]
ALLOWED = [
    ("SELECT replace(b, 'drop', 'insert') AS r FROM data WHERE a > 1", 1),
    ("WITH other AS (SELECT a FROM data) SELECT count(*) FROM other o JOIN data d ON o.a = d.a", 1),
    ("SELECT a, sum(a) OVER (ORDER BY a) AS s FROM DATA ORDER BY a LIMIT 1", 1),
    ("SELECT * FROM (VALUES (1), (2)) v(x) UNION ALL SELECT a FROM data", 4),
    ("SELECT b, count(*) FROM data GROUP BY ROLLUP (b) HAVING count(*) > 0", 3),
    ("SELECT * FROM data WHERE a = (SELECT max(a) FROM data)", 1),
    ("SELECT CAST(a AS string) FROM data d LEFT ANTI JOIN data e ON d.a = e.a + 10;", 2),
    ("SELECT a FROM data INTERSECT SELECT 1", 1),
]


@pytest.fixture(scope="module")
def data(spark):
    spark.createDataFrame([("secret",)], "s string").createOrReplaceTempView("other")
    return spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, data, sql):
    with pytest.raises(ValueError):
        FL.sql_select(spark, sql, {"data": data})


@pytest.mark.parametrize(("sql", "rows"), ALLOWED)
def test_allowed(spark, data, sql, rows):
    assert FL.sql_select(spark, sql, {"data": data}).count() == rows


@pytest.mark.parametrize("op", ["==", "<", "<=", ">", ">="])
def test_nothing_compares_with_nan(spark, op):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, None)], "x double, i int")
    for c in ("x", "i"):
        assert FL.apply_filters(df, [(c, op, "nan")]).count() == 0


def test_p_values_of_tables():
    # quantiles of printed tables: two-sided t and upper F
    for t, df, p in ((12.7062, 1, 0.05), (2.2281, 10, 0.05), (2.7500, 30, 0.01), (1.9600, 10**7, 0.05)):
        assert p_value_t(t, df) == pytest.approx(p, abs=2e-5)
    for f, a, b, p in ((4.9646, 1, 10, 0.05), (3.8853, 2, 12, 0.05), (2.3299, 5, 50, 0.05641), (7.5594, 2, 12, 0.00749)):
        assert p_value_f(f, a, b) == pytest.approx(p, abs=6e-4)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert incomplete_beta(0.5, 0.5, 0.3) == pytest.approx(2 / math.pi * math.asin(math.sqrt(0.3)), abs=1e-13)
    assert p_value_t(0, 4) == 1 and p_value_f(math.inf, 2, 9) == 0


def test_two_groups_and_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", 7.0), ("b", 8.0)], "g string, x double")
    r = A.mean_difference_test(df, "g", "x").first()
    va, vb = (7 / 3) / 3, 7 / 3  # variances over counts
    t, dof = (7 / 3 - 6) / math.sqrt(va + vb), (va + vb) ** 2 / (va * va / 2 + vb * vb / 2)
    assert r["test"] == "welch_t" and r["statistic"] == pytest.approx(t, abs=1e-4) and r["df1"] == pytest.approx(dof, abs=1e-4)
    assert r["p_value"] == pytest.approx(p_value_t(t, dof), abs=1e-6)
    flat = A.mean_difference_test(df.withColumn("x", F.lit(1.0)), "g", "x").first()
    assert flat["statistic"] is None and flat["p_value"] is None
    assert A.mean_difference_test(df.where("g = 'a'"), "g", "x").count() == 0


def test_vector_counts_each_bucket(spark):
    texts = [(0, "aa bb aa cc aa"), (1, "zz"), (2, "x y z"), (3, " ".join(f"w{i % 37}" for i in range(400)))]
    rows = {r["i"]: r for r in D.embed_arrays(spark.createDataFrame(texts, "i long, text string"), ["i"]).collect()}
    assert set(rows) == {0, 1, 3}
    bucket = {}
    words = sorted({w for _, t in texts for w in t.split()})
    for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "int(pmod(xxhash64(w), 768)) AS b").collect():
        bucket[r["w"]] = r["b"]
    for i, t in texts:
        if i in rows:
            want = collections.Counter(bucket[w] for w in t.split() if len(w) > 1)
            norm = math.sqrt(sum(v * v for v in want.values()))
            assert dict(zip(rows[i]["dims"], rows[i]["weights"], strict=True)) == pytest.approx({b: v / norm for b, v in want.items()})
