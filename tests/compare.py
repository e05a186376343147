"""Run registered queries on Spark and their SQL on DuckDB and compare values.

    python tests/compare.py FOLDER [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else x + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def table(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, bool) else int(x)) for x in r))
    return [columns[i] for i in order], out


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Row count of the Spark result and a list of differences (empty when equal)."""
    left_cols, left = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    right_cols, right = table([d[0] for d in res.description], res.fetchall())
    if left_cols != right_cols:
        return len(left), [f"columns {left_cols} / {right_cols}"]
    if len(left) != len(right):
        only = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return len(left), [f"rows {len(left)} / {len(right)}: {only}"]
    bad = [f"{a} / {b}" for a, b in zip(left, right, strict=True) if a != b]
    return len(left), bad[:3] + ([f"{len(bad)} rows differ"] if bad else [])


def main() -> int:
    from tideblock.plans import all_queries
    from tideblock.session import local_session

    folder, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = local_session(8, "compare")
    con = connect(folder)
    failed = 0
    for name, q in all_queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if q.sql is None:
                n, bad = len(q.build(spark, folder).collect()), []
                note = "rows only"
            else:
                n, bad = differences(q.compared(spark, folder), con, q.sql)
                note = "ok"
        except Exception as e:  # noqa: BLE001
            n, bad, note = -1, [f"{type(e).__name__}: {str(e)[:600]}"], "error"
        failed += bool(bad)
        print(f"{'FAIL' if bad else note:10} {name:36} rows={n} {time.time() - start:.1f}s", flush=True)
        for b in bad:
            print("     ", b, flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
