"""Run registered queries in Spark and their SQL oracles in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]

Compares column names, row counts and the multiset of rows (values as text,
columns sorted by name), the way the correctness gate does.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in records)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, con, name, query, sf_dir, verbose=True):
    t0 = time.time()
    sdf = query.build(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if query.oracle is None:
        return {"name": name, "status": "rows-only", "rows": len(s_rows), "sec": round(t1 - t0, 2)}
    rel = con.sql(query.oracle_sql())
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "sec": round(t1 - t0, 2)}
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS differ: spark-only={sorted(set(s_cols)-set(d_cols))} sql-only={sorted(set(d_cols)-set(s_cols))}"
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a == b:
        res["status"] = "match"
    else:
        sa, sb = set(a), set(b)
        res["status"] = f"VALUES differ ({len(sa - sb)} spark-only, {len(sb - sa)} sql-only)"
        if verbose:
            cols = sorted(s_cols)
            for x in list(sa - sb)[:2]:
                print("   spark:", dict(zip(cols, x)))
            for x in list(sb - sa)[:2]:
                print("   sql  :", dict(zip(cols, x)))
    s_types = dict(sdf.dtypes)
    d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
    res["types"] = {c: (s_types[c], d_types.get(c)) for c in s_cols}
    return res


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from cohortlens.plans import REGISTRY
    from cohortlens.session import get_session

    spark = get_session(master="local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name, q in REGISTRY.items():
        if names and name not in names:
            continue
        try:
            r = check(spark, con, name, q, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += not ok
        types = r.pop("types", {})
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
        odd = {c: t for c, t in types.items() if not _same_type(*t)}
        if odd:
            print("    type differences:", odd)
    print(f"{bad} problems")


def _same_type(s, d):
    m = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    return m.get(s, s) == d


if __name__ == "__main__":
    main()
