"""Run registered Spark queries and their DuckDB oracle side by side."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


EXACT = bool(os.environ.get("CARELAKE_EXACT"))


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(rows, cols, in_order=False):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return out if in_order else sorted(out, key=repr)


def is_ordered(sql: str) -> bool:
    """Does the statement itself (no subquery, no window) end in ORDER BY?"""
    at = sql.upper().rfind("ORDER BY")
    depth = 0
    for ch in sql[at:] if at >= 0 else ")":
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if depth < 0:
            return False
    return True


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = []
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"SPARK-ERR {name}: {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if name not in sql:
            print(f"nosql {name} rows={len(srows)} {ts:.2f}s")
            continue
        try:
            rel = con.sql(sql[name])
            drows, dcols = rel.fetchall(), rel.columns
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"DUCK-ERR {name}: {str(e)[:400]}")
            continue
        io = is_ordered(sql[name])
        ok = sorted(scols) == sorted(dcols) and canon(srows, scols, io) == canon(drows, dcols, io)
        if not ok:
            bad.append(name)
            print(f"MISMATCH {name}: spark cols={scols} duck cols={dcols} rows {len(srows)} vs {len(drows)}")
            a, b = canon(srows, scols), canon(drows, dcols)
            diff_a = [r for r in a if r not in b][:3]
            diff_b = [r for r in b if r not in a][:3]
            print("   spark-only:", diff_a)
            print("   duck-only :", diff_b)
        elif verbose:
            print(f"ok {name} rows={len(srows)} {ts:.2f}s")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from carelake.session import build_session
    spark = build_session("local[8]", 8)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    bad = compare(spark, sf, names)
    print("BAD:", bad)
