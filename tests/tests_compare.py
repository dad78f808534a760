"""Run registered queries against their comparison SQL: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("AIRLENS_TESTDATA", "/root/testdata")


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def sort_key(row):
    return tuple((x is not None, str(type(x)), str(x)) for x in row)


def duck(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a query; empty when they agree."""
    cols = sorted(spark_df.columns)
    got = [tuple(normal(r[c]) for c in cols) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != cols:
        return [f"columns differ: spark {cols}, sql {sorted(names)}"]
    index = [names.index(c) for c in cols]
    want = [tuple(normal(r[i]) for i in index) for r in cur.fetchall()]
    problems = []
    spark_types = dict(spark_df.dtypes)
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    for c in cols:
        if pairs.get(spark_types[c]) != types[c]:
            problems.append(f"type of {c}: spark {spark_types[c]}, sql {types[c]}")
    if len(got) != len(want):
        problems.append(f"rows: spark {len(got)}, sql {len(want)}")
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    if got != want:
        extra = list(set(map(str, got)) - set(map(str, want)))[:3]
        missing = list(set(map(str, want)) - set(map(str, got)))[:3]
        problems.append(f"values differ {cols}\n   spark only {extra}\n   sql only {missing}")
    return problems


def main() -> int:
    from airlens.plans import catalog  # noqa: F401
    from airlens.plans.registry import ORACLES, QUERIES
    from airlens.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    folder = f"{DATA}/sf{sf}"
    spark = get_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problems = compare(df, con, ORACLES[name]) if name in ORACLES else []
            note = "" if name in ORACLES else f" (rows only: {df.count()})"
        except Exception as exc:  # noqa: BLE001 - report and go on
            problems, note = [f"{type(exc).__name__}: {str(exc)[:1500]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s{note}", *problems, sep="\n   " if problems else "", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
