"""Side-by-side run of the queries and their SQL; `python tests/oracle.py [sf] [names]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark_df, connection, sql: str) -> str | None:
    """What differs, None when both give the same rows."""
    started = time.time()
    found = [tuple(r) for r in spark_df.collect()]
    seconds = time.time() - started
    relation = connection.sql(sql)
    if sorted(spark_df.columns) != sorted(relation.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(relation.columns)}"
    wanted = relation.fetchall()
    mine, theirs = rows_of(spark_df.columns, found), rows_of(relation.columns, wanted)
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    spark_kinds = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = [f"{c}: {spark_kinds[c]} / {kinds[c]}" for c in kinds if names.get(spark_kinds[c], spark_kinds[c]) != kinds[c]]
    if types:
        return "types " + ", ".join(types)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows / {len(theirs)}"
    differing = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if differing:
        return f"{len(differing)} of {len(mine)} rows differ, first {differing[0]}"
    print(f"    {len(mine)} rows, {seconds:.1f} s", flush=True)
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from mailprism.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    names = sys.argv[2:] or list(queries())
    spark, connection = local_session(), connect(folder)
    bad = []
    for name in names:
        print(name, flush=True)
        started = time.time()
        try:
            frame = queries()[name](spark, folder)
            if name not in oracle_sql():
                print(f"    no SQL, {frame.count()} rows", flush=True)
                continue
            problem = compare(frame, connection, oracle_sql()[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:6000]}"
        print(f"    total {time.time() - started:.1f} s", flush=True)
        if problem:
            bad.append(name)
            print(f"    DIFFERS: {problem}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
