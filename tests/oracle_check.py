"""Run registered queries in Spark and their oracle SQL in DuckDB, and compare.

Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``. Compares row
count, column names and types, and the multiset of rows (order-insensitive).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
            "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
            "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
            "timestamp": "TIMESTAMP WITH TIME ZONE"}


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def key(row):
    return tuple("\x00" if x is None else x for x in row)


def compare(spark, con, q, sf_dir: str, verbose: bool = True) -> dict:
    t0 = time.time()
    sdf = q.spark(spark, sf_dir)
    s_cols = sdf.columns
    s_types = [TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in sdf.schema.fields]
    s_rows = [tuple(norm(v) for v in r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": q.name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    sql = q.oracle()
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = [tuple(norm(v) for v in r) for r in rel.fetchall()]
    res["duck_rows"] = len(d_rows)
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark-only {sorted(set(s_cols) - set(d_cols))} "
                        f"duck-only {sorted(set(d_cols) - set(s_cols))}")
    else:
        st = dict(zip(s_cols, s_types))
        dtp = dict(zip(d_cols, d_types))
        bad = {c: (st[c], dtp[c]) for c in s_cols if st[c] != dtp[c]}
        if bad:
            problems.append(f"types differ: {bad}")
        # align duck rows to spark column order
        idx = [d_cols.index(c) for c in s_cols]
        d_rows = [tuple(r[i] for i in idx) for r in d_rows]
        if len(s_rows) != len(d_rows):
            problems.append(f"row count {len(s_rows)} vs {len(d_rows)}")
        sa = sorted(s_rows, key=key)
        da = sorted(d_rows, key=key)
        if sa != da:
            from collections import Counter
            cs, cd = Counter(s_rows), Counter(d_rows)
            only_s = list((cs - cd).elements())[:3]
            only_d = list((cd - cs).elements())[:3]
            n_diff = sum((cs - cd).values())
            msg = f"{n_diff} rows differ"
            if verbose and only_s:
                # show differing columns of the first mismatching pair
                a = only_s[0]
                b = min(only_d, key=lambda r: sum(x != y for x, y in zip(a, r))) if only_d else None
                if b:
                    diffs = {s_cols[i]: (a[i], b[i]) for i in range(len(a)) if a[i] != b[i]}
                    msg += f"; e.g. {diffs} at {dict(zip(s_cols[:3], a[:3]))}"
            problems.append(msg)
    res["status"] = "ok" if not problems else "FAIL"
    if problems:
        res["problems"] = problems
    res["total_sec"] = round(time.time() - t0, 2)
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from tillcast.plans.registry import load_all
    from tillcast.session import build_session
    spark = build_session("local[8]", int(os.environ.get("ORACLE_PARTITIONS", "8")))
    con = duck(sf_dir)
    reg = load_all()
    sel = [reg[n] for n in names] if names else list(reg.values())
    n_fail = 0
    for q in sel:
        try:
            r = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": q.name, "status": "ERROR", "error": repr(e)[:800]}
        if r["status"] in ("FAIL", "ERROR"):
            n_fail += 1
        print(r, flush=True)
    print(f"{len(sel) - n_fail}/{len(sel)} passed")
    return n_fail


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
