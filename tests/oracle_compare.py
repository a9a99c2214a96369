"""Run queries() against oracle_sql() on DuckDB, like the driver's check.

python tests/oracle_compare.py [sf_dir] [key-prefix ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tabulark.plans.catalog import TABLES  # noqa: E402
from tabulark.session import local_session  # noqa: E402


def norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (pd.Timestamp,)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "tolist"):
        return str(v.tolist())
    if isinstance(v, (list, tuple)):
        return str(list(v))
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return v


def normalise(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(norm_value(r[c]) for c in cols) for r in df.to_dict("records")]
    rows.sort(key=lambda t: tuple((x is None, str(x)) for x in t))
    return cols, rows


def compare(spark, con, sf_dir, key, fn, sql):
    t = time.time()
    sdf = fn(spark, sf_dir).toPandas()
    ts = time.time() - t
    if sql is None:
        return f"{key}: rows={len(sdf)} (no oracle) {ts:.1f}s"
    odf = con.execute(sql).fetchdf()
    sc, sr = normalise(sdf)
    oc, orows = normalise(odf)
    if sc != oc:
        return f"{key}: SCHEMA MISMATCH spark={sc} oracle={oc}"
    if len(sr) != len(orows):
        return f"{key}: ROWCOUNT MISMATCH spark={len(sr)} oracle={len(orows)}"
    bad = [(a, b) for a, b in zip(sr, orows) if a != b]
    if bad:
        return f"{key}: VALUE MISMATCH {len(bad)} rows e.g. spark={bad[0][0]} oracle={bad[0][1]}"
    return f"{key}: OK rows={len(sr)} {ts:.1f}s"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = local_session()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, orc = queries(), oracle_sql()
    fails = 0
    for key, fn in qs.items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        try:
            msg = compare(spark, con, sf_dir, key, fn, orc.get(key))
        except Exception as e:  # noqa: BLE001
            msg = f"{key}: ERROR {type(e).__name__}: {str(e)[:400]}"
        if "OK" not in msg and "no oracle" not in msg:
            fails += 1
        print(msg, flush=True)
    print(f"FAILURES: {fails}")


if __name__ == "__main__":
    main()
