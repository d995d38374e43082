"""Local side-by-side check: every queries() entry against its oracle_sql() in DuckDB.

Usage: SF=/root/testdata/sf0.01 [STRICT=1] [TZ_SESSION=Area/City] python tools/check_oracles.py [names...]
"""
import math
import os
import sys
import time
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb
from tabscope.session import local_session
import importlib
spark = local_session(8)
if os.environ.get("TZ_SESSION"): spark.conf.set("spark.sql.session.timeZone", os.environ["TZ_SESSION"])
sf = os.environ.get("SF", "/root/testdata/sf0.01")
ent = importlib.import_module("__spark_entry__")
Q, O = ent.queries(), ent.oracle_sql()
names = sys.argv[1:] or list(Q)
con = duckdb.connect()
for t in ["region","nation","customer","supplier","part","orders","lineitem","events","documents","embeddings","pages","benchmark","labels","conversations"]:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
con.execute("SET TimeZone='UTC'")
def norm(v):
    if isinstance(v, float):
        if math.isnan(v): return "nan"
        return v if os.environ.get("STRICT") else round(v, 9)
    if hasattr(v, 'isoformat'): return v.isoformat()
    if isinstance(v, (list, tuple)): return tuple(norm(x) for x in v)
    return v
ok = bad = 0
for n in names:
    t = time.time()
    try:
        df = Q[n](spark, sf)
        cols = df.columns
        rows = [tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()]
        dt = time.time() - t
    except Exception as e:
        print(f"FAIL-SPARK {n}: {str(e).splitlines()[0][:300]}"); bad += 1; continue
    if n not in O:
        print(f"rows-only {n}: {len(rows)} rows {dt:.1f}s"); ok += 1; continue
    try:
        rel = con.execute(O[n])
        ocols = [d[0] for d in rel.description]
        orows = rel.fetchall()
        orows = [tuple(norm(r[ocols.index(c)]) for c in sorted(ocols)) for r in orows]
    except Exception as e:
        print(f"FAIL-ORACLE {n}: {str(e).splitlines()[0][:300]}"); bad += 1; continue
    if sorted(cols) != sorted(ocols):
        print(f"COLS {n}: spark={sorted(cols)} oracle={sorted(ocols)}"); bad += 1; continue
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(rows, key=key), sorted(orows, key=key)
    if a == b:
        print(f"ok {n}: {len(rows)} rows {dt:.1f}s"); ok += 1
    else:
        bad += 1
        print(f"MISMATCH {n}: spark {len(a)} rows, oracle {len(b)} rows; cols={sorted(cols)}")
        sa, sb = set(a), set(b)
        for r in list(sa - sb)[:4]: print("   spark only:", r)
        for r in list(sb - sa)[:4]: print("   oracle only:", r)
print(f"ok={ok} bad={bad}")
