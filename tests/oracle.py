"""Runs queries beside their SQL: python tests/oracle.py [NAME...] (SF_DIR for the data)."""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings context_entries context_versions version_commits version_commit_parents version_entry_deltas vote_payloads antibodies mix_targets common_words".split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c


def cells(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return "~"
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cells, v)) + "]"
    if isinstance(v, dict) or hasattr(v, "asDict"):
        v = v if isinstance(v, dict) else v.asDict()
        return "{" + ",".join(f"{k}={cells(x)}" for k, x in v.items()) + "}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        x = round(float(v), 6)
        return repr(x + 0.0 if x else 0.0)
    if isinstance(v, int):
        return repr(round(float(v), 6)) if False else str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cells(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, name, query, sql, d) -> str:
    df = query(spark, d)
    got, gc = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    cols = [x[0] for x in rel.description]
    exp, ec = rows_of(cols, rel.fetchall())
    if gc != ec:
        return f"columns {gc} <> {ec}"
    loose = lambda rs: [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in rs]
    if sorted(loose(got)) != sorted(loose(exp)):
        a, b = set(loose(got)), set(loose(exp))
        return f"rows {len(got)} <> {len(exp)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    if got != exp:
        return f"ok but for int/double: {len(got)}"
    return "ok" if got else "ok, but no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from palimpsest.session import get_spark

    spark = get_spark()
    spark.sparkContext.setLogLevel("ERROR")
    d = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(d)
    q, s = entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or q:
        t = time.time()
        try:
            if name in s:
                said = compare(spark, con, name, q[name], s[name], d)
            else:
                said = f"no SQL; {q[name](spark, d).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        print(name, f"{time.time() - t:.1f}s", said, flush=True)
