"""Compare registered queries with their SQL twins. usage: check.py [sf] [name ...]"""
import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    want = sys.argv[2:]
    from spanlake.session import build_session
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                               "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from spanlake.catalogue import registry
    mods = os.environ.get("MODS")
    import spanlake.catalogue as cat
    for m in (mods.split(",") if mods else cat.MODULES):
        importlib.import_module(f"spanlake.catalogue.{m}")
    con = duckdb.connect()
    d = f"/root/testdata/sf{sf}"
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    bad = []
    for name, fn in registry.QUERIES.items():
        if want and name not in want:
            continue
        t0 = time.time()
        try:
            df = fn(spark, d)
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:
            bad.append(name)
            print(f"FAIL {name}: spark {type(e).__name__} {str(e)[:700]}", flush=True)
            continue
        t1 = time.time() - t0
        sql = registry.SQL.get(name)
        if not sql:
            print(f"ROWS {name} {len(rows)} {t1:.2f}s", flush=True)
            if not rows:
                bad.append(name)
            continue
        t0 = time.time()
        try:
            cur = con.execute(sql)
            exp = cur.fetchall()
        except Exception as e:
            bad.append(name)
            print(f"FAIL {name}: duck {str(e)[:500]}", flush=True)
            continue
        t2 = time.time() - t0
        a = sorted(tuple(norm(v) for v in r) for r in rows)
        b = sorted(tuple(norm(v) for v in r) for r in exp)
        if a == b and a:
            print(f"ok   {name} {len(a)} {t1:.2f}s duck {t2:.2f}s", flush=True)
        else:
            bad.append(name)
            sa, sb = set(a), set(b)
            print(f"DIFF {name} spark {len(a)} duck {len(b)}; only spark {list(sa - sb)[:3]} only duck {list(sb - sa)[:3]}", flush=True)
    print("BAD", bad)


main()
