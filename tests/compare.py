"""Run registered queries next to their SQL on DuckDB and compare rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _normal(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_normal(v) for v in value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    return int(value) if hasattr(value, "__int__") else value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    normal = [tuple(_normal(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(normal, key=repr)


def spark_rows(df):
    return _sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return _sorted_rows(columns, cursor.fetchall())


def differences(left, right, limit: int = 3):
    """Rows of one side only; empty when equal."""
    if left[0] != right[0]:
        return [("columns", left[0], right[0])]
    if left[1] == right[1]:
        return []
    a, b = set(left[1]), set(right[1])
    return [
        ("rows", len(left[1]), len(right[1])),
        ("spark only", len(a - b), sorted(a - b, key=repr)[:limit]),
        ("sql only", len(b - a), sorted(b - a, key=repr)[:limit]),
    ]


def main(argv):
    from tests.conftest import make_session

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark, con = make_session(), database(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            left = spark_rows(queries[name](spark, sf_dir))
            middle = time.time()
            if name not in sql:
                print(f"rows  {name:28s} {len(left[1]):8d} rows  spark {middle - start:6.2f}s", flush=True)
                continue
            found = differences(left, sql_rows(con, sql[name]))
            state = "ok   " if not found else "DIFF "
            print(
                f"{state} {name:28s} {len(left[1]):8d} rows  spark {middle - start:6.2f}s  sql {time.time() - middle:6.2f}s",
                flush=True,
            )
            if found:
                failed.append(name)
                for f in found:
                    print("      ", str(f)[:1500])
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
