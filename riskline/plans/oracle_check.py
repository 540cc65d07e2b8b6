"""Local correctness check: a registered Spark query against its DuckDB SQL.

Compares row count, column names (sorted) and an order-insensitive hash of
the values, the same three things the correctness gate records. Values are
hashed exactly as returned (no re-rounding): the queries round their doubles
themselves, identically in both engines.

    python -m riskline.plans.oracle_check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256()
    for ln in lines:
        h.update(ln.encode())
        h.update(b"\n")
    return h.hexdigest(), lines


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def run(spark, sf_dir: str, names=None, verbose=True):
    sys.path.insert(0, ".")
    from riskline.plans.catalog import queries
    from riskline.plans.oracle import oracle_sql
    q, o = queries(), oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(q):
        t0 = time.time()
        df = q[name](spark, sf_dir)
        cols = df.columns
        rows = [tuple(r) for r in df.collect()]
        t1 = time.time() - t0
        rec = {"rows": len(rows), "spark_sec": round(t1, 2)}
        if name in o:
            rel = con.sql(o[name])
            ocols = rel.columns
            orows = rel.fetchall()
            hs, ls = digest(cols, rows)
            ho, lo = digest(ocols, orows)
            rec.update(oracle_rows=len(orows), cols_match=sorted(cols) == sorted(ocols),
                       hash_match=hs == ho)
            if verbose and not (rec["hash_match"] and rec["cols_match"]):
                print("  spark cols", sorted(cols), "oracle cols", sorted(ocols))
                diff_s = sorted(set(ls) - set(lo))[:3]
                diff_o = sorted(set(lo) - set(ls))[:3]
                print("  only spark:", [d[:300] for d in diff_s])
                print("  only oracle:", [d[:300] for d in diff_o])
        out[name] = rec
        if verbose:
            print(name, rec, flush=True)
    return out


if __name__ == "__main__":
    from riskline.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    res = run(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v.get("hash_match") is False or v.get("cols_match") is False]
    print("MISMATCH:", bad)
