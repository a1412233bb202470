"""Run registered queries on Spark and their SQL on DuckDB and compare the results.

usage: python tools/check.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from routelab.plans import catalog  # noqa: E402
from routelab.session import local_session  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str(v)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    d = f"/root/testdata/sf{sf}"
    want = sys.argv[2:]
    skip = set(os.environ.get("SKIP", "").split(","))
    only = os.environ.get("GROUPS_ONLY")
    if only:
        catalog.GROUPS[:] = only.split(",")
    catalog.load()
    spark = local_session(8, "check")
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    bad = []
    for name, fn in list(catalog.QUERIES.items()):
        if name in skip or want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            df = fn(spark, d)
            cols = sorted(df.columns)
            got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
            sec = time.time() - t
            sql = catalog.ORACLES.get(name)
            if sql is None:
                print(f"rows  {name}: {len(got)} {sec:.1f}s", flush=True)
                continue
            cur = con.execute(sql)
            names = [c[0] for c in cur.description]
            raw = cur.fetchall()
            if sorted(names) != cols:
                raise AssertionError(f"columns {cols} vs {sorted(names)}")
            pos = [names.index(c) for c in cols]
            exp = [tuple(norm(r[p]) for p in pos) for r in raw]
            got.sort(), exp.sort()
            if got != exp:
                have, need = set(got), set(exp)
                miss = [r for r in exp if r not in have][:2]
                extra = [r for r in got if r not in need][:2]
                raise AssertionError(f"{len(got)} vs {len(exp)} rows; cols {cols}\n   sql only {miss}\n   spark only {extra}")
            print(f"ok    {name}: {len(got)} {sec:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {str(e)[:1500]}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
