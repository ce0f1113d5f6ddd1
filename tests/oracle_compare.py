"""Run registered queries in Spark and their oracle SQL in DuckDB and compare
row count, column names/types and the order-insensitive multiset of rows.

Usage: python tests/oracle_compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import os  # noqa: E402

STRICT = os.environ.get("ORACLE_STRICT") == "1"  # compare floats bit for bit

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "long", "int64"):
        return "bigint"
    if t in ("int", "integer", "int32"):
        return "int"
    if t in ("double", "float64"):
        return "double"
    if t in ("string", "varchar"):
        return "string"
    if t.startswith("timestamp"):
        return "timestamp"
    if t in ("boolean", "bool"):
        return "boolean"
    return t


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if STRICT:
            return v + 0.0
        return round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_types = {f.name: _kind(f.dataType.simpleString()) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    d_types = {c: _kind(str(t)) for c, t in zip(d_cols, [str(x) for x in con.execute(
        f"DESCRIBE {sql}").fetchall() and [r[1] for r in con.execute(f'DESCRIBE {sql}').fetchall()]])}
    s_cols = list(s_types)
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
    else:
        for c in s_cols:
            if s_types[c] != d_types[c]:
                problems.append(f"type {c}: spark={s_types[c]} duck={d_types[c]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        order = sorted(s_cols)
        si = [s_cols.index(c) for c in order]
        di = [d_cols.index(c) for c in order]
        from collections import Counter
        a = Counter(tuple(_norm(r[i]) for i in si) for r in s_rows)
        b = Counter(tuple(_norm(r[i]) for i in di) for r in d_rows)
        only_s, only_d = list((a - b).elements()), list((b - a).elements())
        if only_s or only_d:
            problems.append(f"{len(only_s)} rows differ, e.g. spark={only_s[:2]} duck={only_d[:2]}")
    return problems, t1 - t0, len(s_rows)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    from tablesmith.session import get_session
    from tablesmith.suite import ORACLE, QUERIES
    spark = get_session(os.environ.get("CORES", "*"))
    con = duck_connect(sf_dir)
    ok = bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        sql = ORACLE.get(name)
        if sql is None:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"ROWS  {name}: {n} rows ({time.time() - t0:.1f}s, no oracle)")
            continue
        try:
            problems, secs, n = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            problems, secs, n = [f"error {type(e).__name__}: {str(e)[:300]}"], 0, 0
        if problems:
            bad += 1
            print(f"FAIL  {name}: " + " | ".join(problems))
        else:
            ok += 1
            print(f"OK    {name}: {n} rows ({secs:.1f}s)")
    print(f"{ok} ok, {bad} failed")


if __name__ == "__main__":
    main()
