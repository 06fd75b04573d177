"""Runs registered queries against their oracle SQL: python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels runs run_items map_sample document_chunks fetched_pages fetched_docs container_sizes mix_targets".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if isinstance(v, str) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data), [columns[i] for i in order]


def duck(root: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(root, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def differences(spark, con, root, query, sql):
    df = query(spark, root)
    ours, c1 = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs, c2 = rows([d[0] for d in cur.description], cur.fetchall())
    return sum(ours.values()), sum(theirs.values()), c1 == c2, list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from tests.conftest import make_session

    import __spark_entry__ as entry

    spark, root = make_session(8), sys.argv[1]
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            if name in sqls:
                n, m, same, more, less = differences(spark, duck(root), root, queries[name], sqls[name])
                ok = same and not more and not less
                print("ok  " if ok else "DIFF", name, n, m, f"{time.time() - began:.1f}s", "" if ok else f"columns {same}\n  spark {more}\n  sql   {less}", flush=True)
            else:
                print("rows", name, queries[name](spark, root).count(), f"{time.time() - began:.1f}s", flush=True)
        except Exception as e:
            print("FAIL", name, type(e).__name__, str(e)[:1500], flush=True)
