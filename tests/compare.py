"""Spark results against DuckDB SQL: ``python tests/compare.py [SF_DIR] [NAME...]``."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings verify report prediction_items categories_multilingual benchmark sample_targets mix_targets".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    number = lambda x: float(x) if isinstance(x, (int, str)) and not isinstance(x, bool) and _is_number(x) else x
    return sorted((tuple(number(x) for x in r) for r in out), key=repr)


def _is_number(x) -> bool:
    try:
        float(x)
        return True
    except ValueError:
        return False


def compare(spark, con, name: str, f, sql: str | None, sf_dir: str) -> str:
    df = f(spark, sf_dir)
    got = rows(df.columns, df.collect())
    if sql is None:
        return f"rows {len(got)}"
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = rows(want_cols, cur.fetchall())
    if sorted(df.columns) != sorted(want_cols):
        return f"COLUMNS {sorted(df.columns)} {sorted(want_cols)}"
    if got != want:
        a, b = [r for r in got if r not in want][:3], [r for r in want if r not in got][:3]
        return f"DIFFERS {len(got)} {len(want)} spark {a} sql {b}"
    return f"same {len(got)}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from quillstone.session import local_session

    args = sys.argv[1:]
    d = args.pop(0) if args and glob.glob(args[0] + "/verify.parquet") else "/root/testdata/sf0.01"
    spark = local_session(8, 8, "8g")
    con = connect(d)
    sqls = entry.oracle_sql()
    for n, q in entry.queries().items():
        if args and not any(n.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            said = compare(spark, con, n, q, sqls.get(n), d)
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__} {str(e)[:600]}"
        print(f"{n}: {said} ({time.time() - t:.1f} s)", flush=True)
