"""Compare every registered query with its SQL statement on the test tables.

    python tests/compare.py [name-or-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def kind(value):
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def cells(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        values = []
        for i in order:
            value = row[i]
            if isinstance(value, float):
                value = None if math.isnan(value) else value + 0.0
            values.append((kind(value), value))
        out.append(tuple(values))
    return sorted(out, key=repr)


def compare(frame, connection, sql):
    """Return a list of differences; empty when both sides agree exactly."""
    left_columns = frame.columns
    left = [tuple(r) for r in frame.collect()]
    cursor = connection.execute(sql)
    right_columns = [c[0] for c in cursor.description]
    right = cursor.fetchall()
    problems = []
    if sorted(left_columns) != sorted(right_columns):
        return [f"columns {sorted(left_columns)} != {sorted(right_columns)}"]
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    a, b = cells(left, left_columns), cells(right, right_columns)
    if a != b:
        only_a = sorted(set(a) - set(b), key=repr)
        only_b = sorted(set(b) - set(a), key=repr)
        problems.append(f"columns sorted: {sorted(left_columns)}")
        problems.append(f"{len(only_a)} only in spark, {len(only_b)} only in sql")
        for x in only_a[:3]:
            problems.append(f"  spark {x}")
        for x in only_b[:3]:
            problems.append(f"  sql   {x}")
    return problems


def main(argv):
    import __spark_entry__ as entry
    from panelwright.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = []
    for name in names:
        start = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            if name in oracles:
                problems = compare(frame, connection, oracles[name])
                note = "" if connection.execute(oracles[name]).fetchmany(1) else " EMPTY"
            else:
                note = f" rows-only {frame.count()}"
                problems = []
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
            note = ""
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s{note}", flush=True)
        for problem in problems:
            print("     ", str(problem)[:1500])
        if problems:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} agree; failing: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
