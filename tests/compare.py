"""Runs registered queries against DuckDB. ``python tests/compare.py SF [key ...]`` prints one line per key."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
DATA = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool):
        return str(v)
    return str(v)


_KINDS = {"bigint": "int64", "long": "int64", "int": "int32", "integer": "int32", "double": "double", "float": "float",
          "string": "varchar", "boolean": "boolean", "smallint": "int16", "varchar": "varchar",
          "timestamp_ntz": "timestamp", "timestamp": "timestamp", "hugeint": "hugeint", "date": "date"}


def compare(df, sql: str, con) -> str:
    """'' when rows, columns, types and values agree, else what differs."""
    rel = con.sql(sql)
    want_cols = {c: str(t).lower() for c, t in zip(rel.columns, rel.types)}
    got_cols = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sorted(want_cols) != sorted(got_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    kinds = [(c, got_cols[c], want_cols[c]) for c in want_cols
             if _KINDS.get(got_cols[c], got_cols[c]) != _KINDS.get(want_cols[c], want_cols[c])]
    order = sorted(want_cols)
    got = sorted(tuple(_norm(r[c]) for c in order) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    want = sorted(tuple(_norm(r[i]) for i in at) for r in rel.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference {g} vs {w}"[:600]
    return f"types {kinds}" if kinds else ""


def main() -> int:
    from quire.plans import load
    from quire.session import build_session

    sf, keys = sys.argv[1], sys.argv[2:]
    catalog = load()
    spark = build_session("compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(f"{DATA}/sf{sf}")
    bad = 0
    for key in (keys or catalog):
        q = catalog[key]
        start = time.time()
        try:
            df = q.run(spark, f"{DATA}/sf{sf}")
            if q.sql is None:
                res = f"no oracle, rows {df.count()}"
            else:
                res = compare(df, q.sql, con)
                bad += bool(res)
                res = f"FAIL {res}" if res else f"ok"
        except Exception as e:  # report and go on with the next key
            bad += 1
            res = f"ERROR {type(e).__name__} {str(e)[:900]}"
        print(f"{key:28s} {time.time() - start:6.2f}s {res}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
