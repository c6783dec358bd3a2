"""Run registered queries next to their SQL and compare: ``check_queries.py [sf] [prefix..]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else (value + 0.0,)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return (value,)


def _sorted(rows):
    return sorted((tuple(map(_cell, row)) for row in rows), key=repr)


def compare(df, connection, sql):
    """None when both sides hold the same rows under the same names, else a message."""
    names = sorted(df.columns)
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    relation = connection.sql(sql)
    if sorted(relation.columns) != names:
        return f"columns {names} against {sorted(relation.columns)}"
    theirs = relation.select(", ".join(f'"{n}"' for n in names))
    types = dict(zip(theirs.columns, map(str, theirs.types)))
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    wrong = [(n, t, types[n]) for n, t in df.dtypes if kinds.get(types[n]) != t]
    expected = theirs.fetchall()
    if len(rows) != len(expected):
        return f"{len(rows)} rows against {len(expected)}"
    mine, yours = _sorted(rows), _sorted(expected)
    if mine != yours:
        at = next(i for i, (a, b) in enumerate(zip(mine, yours)) if a != b)
        bad = sum(a != b for a, b in zip(mine, yours))
        return f"{bad} of {len(mine)} rows differ, first: {mine[at]} against {yours[at]} ({names})"
    return f"types {wrong}" if wrong else None


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def main() -> int:
    from farpoint.catalog import ORACLES, QUERIES
    from farpoint.session import build_session, ship_package

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    connection = connect(sf_dir)
    failed = 0
    for name, function in QUERIES.items():
        if not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            df = function(spark, sf_dir)
            if name in ORACLES:
                message = compare(df, connection, ORACLES[name])
            else:
                message = None if len(df.collect()) else "no rows"
        except Exception as error:  # report and go on with the next query
            message = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += message is not None
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'ok  ' if message is None else 'FAIL'} {kind} {name} {time.time() - began:.1f}s {message or ''}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
