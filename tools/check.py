"""Run registered queries against DuckDB on the same tables: check.py [sf] [name ...]"""
import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import duckdb  # noqa: E402

from capstrata.plans.catalog import QUERIES  # noqa: E402
from capstrata.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(QUERIES)
    d = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    spark = local_session("check", cpus=8)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    if os.environ.get("SLICES"):
        spark.conf.set("spark.capstrata.slices", os.environ["SLICES"])
    bad = 0
    for n in names:
        q = QUERIES[n]
        t0 = time.time()
        try:
            df = q.run(spark, d)
            rows = df.collect()
            cols = df.columns
            dt = time.time() - t0
            got = sorted(tuple(norm(r[c]) for c in sorted(cols)) for r in rows)
            note = ""
            if q.oracle():
                t1 = time.time()
                res = con.execute(q.oracle())
                oc = [x[0] for x in res.description]
                orows = res.fetchall()
                idx = [oc.index(c) for c in sorted(oc)]
                want = sorted(tuple(norm(r[i]) for i in idx) for r in orows)
                ot = time.time() - t1
                if sorted(oc) != sorted(cols):
                    note = f"COLUMNS {sorted(cols)} vs {sorted(oc)}"
                elif got != want:
                    g, w = set(got), set(want)
                    note = f"MISMATCH rows {len(got)} vs {len(want)}; only spark {sorted(g - w)[:3]} only sql {sorted(w - g)[:3]}"
                else:
                    note = f"ok (sql {ot:.1f}s)"
            else:
                note = "rows only"
            if "MIS" in note or "COL" in note:
                bad += 1
            print(f"{n:28s} {len(rows):7d} rows {dt:6.1f}s  {note}", flush=True)
            if len(names) < 4:
                print("   ", rows[:2])
        except Exception as e:  # noqa: BLE001
            bad += 1
            msg = str(e)
            print(f"{n:28s} ERROR {type(e).__name__} {msg[:900]}", flush=True)
    print("bad:", bad)


main()
