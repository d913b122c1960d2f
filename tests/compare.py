"""Run registered queries next to their checking SQL: ``python tests/compare.py [sf_dir] [query ...]``."""
from __future__ import annotations

import datetime as dt
import math
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def normal(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, normal(x)) for k, x in v.items()))
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty where both sides agree, else what differs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    mine = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(mine)}"
    cur = con.execute(sql)
    cols, theirs = [d[0] for d in cur.description], cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} against {sorted(cols)}"
    a, b = rows_of(df.columns, mine), rows_of(cols, theirs)
    if a != b:
        only_a, only_b = list((a - b).elements()), list((b - a).elements())
        return (f"ROWS {len(mine)} against {len(theirs)}; {len(only_a)}/{len(only_b)} differ\n"
                f"   spark {str(only_a[:2])[:700]}\n   check {str(only_b[:2])[:700]}")
    return "" if mine else "EMPTY on both sides"


def main() -> None:
    import __spark_entry__ as entry
    from feedloom.session import get_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                              "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name in args or entry.queries():
        start = time.time()
        try:
            out = compare(spark, con, name, sf_dir)
        except Exception:
            out = "FAILED " + traceback.format_exc()[-1800:]
        bad += bool(out) and not out.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.2f}s  {out or 'ok'}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
