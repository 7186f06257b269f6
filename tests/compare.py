"""Run registered queries beside their SQL twins: ``python tests/compare.py [sf] [key-part ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        raise TypeError("decimal in a result")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(plain(v)) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted(tuple(str(plain(row[i])) for i in order) for row in rows),
    )


def spark_rows(df):
    return canonical(df.columns, [tuple(row) for row in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return canonical([d[0] for d in cur.description], cur.fetchall())


def main(argv):
    import __spark_entry__ as entry
    from lumenads.session import local_session

    sf = argv[0] if argv else "0.01"
    parts = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for key, run in entry.queries().items():
        if parts and not any(key.startswith(p) for p in parts):
            continue
        began = time.time()
        try:
            columns, rows = spark_rows(run(spark, sf_dir))
            took = time.time() - began
            if key not in oracles:
                print(f"rows {key:34s} {len(rows):7d} {took:6.2f}s")
                continue
            ocols, orows = duck_rows(con, oracles[key])
            if columns != ocols:
                bad += 1
                print(f"COLS {key}: {columns} | {ocols}")
            elif rows != orows:
                bad += 1
                diff = [(a, b) for a, b in zip(rows, orows) if a != b][:3]
                print(f"DIFF {key}: {len(rows)} vs {len(orows)} rows {columns}")
                for a, b in diff:
                    print("   spark", a, "\n   duck ", b)
            else:
                mark = "EMPTY" if not rows else "ok"
                print(f"{mark:5s}{key:34s} {len(rows):7d} {took:6.2f}s")
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL {key}: {type(exc).__name__}: {str(exc)[:600]}")
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
