"""Run registered queries next to their SQL oracles.

Usage: python tests/compare.py [sf] [name-prefix ...]
"""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
DATA = "/root/testdata"


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf{sf}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    got = spark_df.collect()
    gc, gr = rows_of(spark_df.columns, got)
    cur = con.execute(sql)
    wc, wr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if gc != wc:
        return f"columns {gc} != {wc}"
    if len(gr) != len(wr):
        extra = [r for r in gr if r not in set(wr)][:2]
        missing = [r for r in wr if r not in set(gr)][:2]
        return f"rows {len(gr)} != {len(wr)}; extra {extra}; missing {missing}"
    bad = [(a, b) for a, b in zip(gr, wr) if a != b]
    if bad:
        return f"{len(bad)} of {len(gr)} rows differ, first {bad[0]}"
    kinds = [(n, {type(x).__name__ for r in gr for x in [r[i]] if x is not None}) for i, n in enumerate(gc)]
    return None if gr or not wr else f"no rows {kinds}"


def main(argv: list[str]) -> int:
    from curbcast.plans.registry import oracles, queries
    from curbcast.session import local_session
    sf = argv[0] if argv else "0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, osql = duck(sf), queries(), oracles()
    names = [n for n in qs if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    failed = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, f"{DATA}/sf{sf}")
            if n in osql:
                msg = compare(df, con, osql[n])
                tag = "OK  " if msg is None else "DIFF"
            else:
                msg, tag = f"rows-only {df.count()}", "ROWS"
        except Exception as e:  # noqa: BLE001
            msg, tag = f"{type(e).__name__}: {str(e)[:600]}", "FAIL"
        failed += tag in ("DIFF", "FAIL")
        print(f"{tag} {n} {time.time() - t0:.1f}s {msg or ''}"[:900], flush=True)
        spark.catalog.clearCache()
    print(f"{failed} failed of {len(names)}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
