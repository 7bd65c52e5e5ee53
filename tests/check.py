"""Compare registered queries with their SQL on DuckDB: python tests/check.py [names...]"""
from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb
import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf_dir):
    from waymark.plans.registry import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


TIMES: list = [(0, 0)]


def plain(v):
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v if isinstance(v, str) else str(v)


def compare(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    t0 = time.time()
    got = sorted((tuple(plain(r[c]) for c in cols) for r in spark_df.collect()), key=repr)
    t1 = time.time()
    cur = con.execute(sql)
    TIMES.append((t1 - t0, time.time() - t1))
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first got {got[:2]} want {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ, e.g. {cols}: got {bad[0][0]} want {bad[0][1]}"
    types_differ = [type(a).__name__ + "/" + type(b).__name__ for g, w in zip(got[:50], want[:50]) for a, b in zip(g, w) if type(a) is not type(b)]
    if types_differ:
        return f"value types differ {set(types_differ)}"
    return None if got else "EMPTY"


def main(names, sf_dir):
    from tests.conftest import make_session

    import __spark_entry__ as entry

    spark = make_session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    failed = []
    for name, fn in queries.items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            t1 = time.time()
            if name in oracles:
                err = compare(df, con, oracles[name])
            else:
                n = df.count()
                err = None if n else "EMPTY"
        except Exception as exc:  # noqa: BLE001
            err = f"{type(exc).__name__}: {str(exc)[:1500]}"
        kind = "oracle" if name in oracles else "rows"
        spark_s, duck_s = TIMES[-1]
        print(f"spark {spark_s:5.1f} duck {duck_s:5.1f} {'ok  ' if err is None else 'FAIL'} {name:34s} {kind:6s} {time.time() - t0:6.1f}s {err or ''}", flush=True)
        if err:
            failed.append(name)
    print("failed:", failed, "of", len(queries), "oracles", len(oracles))
    return 1 if failed else 0


if __name__ == "__main__":
    import os

    sys.exit(main(sys.argv[1:], os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")))
