"""Run registered queries next to their oracle SQL and compare the results.

python -m slatework.verify [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from slatework.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple((type(r[i]).__name__, _plain(r[i])) for i in order) for r in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when names, types and values agree, else what differs."""
    names = df.columns
    ours = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    other_names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(other_names):
        return f"columns {sorted(set(names) ^ set(other_names))}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, oracle {len(theirs)}"
    a, b = _rows(names, ours), _rows(other_names, theirs)
    if a == b:
        return None
    extra, missing = list((a - b).elements()), list((b - a).elements())
    labels = sorted(names)
    head = lambda rows: [dict(zip(labels, [v for _, v in r])) for r in sorted(rows, key=str)[:2]]
    kinds = {(x[0], y[0]) for x, y in zip(extra[0], missing[0]) if x[0] != y[0]}
    return f"{len(extra)} of {len(ours)} rows differ; type pairs {kinds}; ours {head(extra)}; oracle {head(missing)}"


def main(argv: list[str]) -> int:
    from slatework.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session("verify")
    con = oracle_connection(folder)
    failed = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            df = run(spark, folder)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state, problem = f"rows {df.count()}", None
        except Exception as error:  # noqa: BLE001 - report and go on
            state = problem = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:32s} {time.time() - begin:6.2f}s  {state}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
