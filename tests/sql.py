"""Registered queries against their SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def held(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([held(r[i]) for i in order]) for r in rows)


def compare(spark, query, sql):
    got = query(spark, FOLDER)
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = connection.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())
