"""Compare large results with their oracle inside DuckDB (no collect to Python).

Usage: ``python tests/big_compare.py <scratch_dir> <sf_dir> <query> ...``: Spark
writes each query's result as Parquet into the scratch folder, DuckDB counts the
rows that differ in either direction with EXCEPT ALL.
"""
import sys
import os
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT); sys.path.insert(0, os.path.join(ROOT, "tests"))
from tillcast.session import build_session
from tillcast.plans.registry import load_all
from oracle_check import duck
run, sf = sys.argv[1], sys.argv[2]
spark = build_session("local[8]", 16, extra={"spark.driver.memory": "16g"})
reg = load_all()
con = duck(sf)
for name in sys.argv[3:]:
    q = reg[name]
    path = f"{run}/{name}.parquet"
    q.spark(spark, sf).write.mode("overwrite").parquet(path)
    cols = sorted(spark.read.parquet(path).columns)
    sel = ", ".join(f'"{c}"' for c in cols)
    a = f"SELECT {sel} FROM read_parquet('{path}/*.parquet')"
    b = f"SELECT {sel} FROM ({q.oracle()}) o"
    n_a = con.sql(f"SELECT count(*) FROM ({a})").fetchall()[0][0]
    n_b = con.sql(f"SELECT count(*) FROM ({b})").fetchall()[0][0]
    d1 = con.sql(f"SELECT count(*) FROM ({a} EXCEPT ALL {b})").fetchall()[0][0]
    d2 = con.sql(f"SELECT count(*) FROM ({b} EXCEPT ALL {a})").fetchall()[0][0]
    print(name, "rows", n_a, n_b, "spark-only", d1, "oracle-only", d2, flush=True)
