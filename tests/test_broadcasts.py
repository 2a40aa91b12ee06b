"""Tables that grow are not broadcast, however small Spark takes them for."""

from __future__ import annotations

from contextlib import contextmanager

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from sql import rows_of

from wayfare.operators import lookup, sampling
from wayfare.plans import catalogue

FOLDER = "/root/testdata/sf0.1"


@contextmanager
def broadcasts_of(spark, size):
    """Spark raises for a broadcast table of more than ``size``; it broadcasts by estimates, not by sizes measured while it runs."""
    settings = {"spark.sql.maxBroadcastTableSize": size, "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_draws_are_shuffled(spark):
    rows = spark.range(50).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("alt")).withColumn("prob", (F.col("alt") + 1) / 10.0)
    draws = spark.range(50).select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("draw_no")).withColumn("rand", (F.col("id") * 8 + F.col("draw_no")) / 400.0)
    with broadcasts_of(spark, "1b"):
        got = {(r.id, r.draw_no): r.choice for r in sampling.sample_long(rows, draws, "id", "alt", "prob").collect()}
    ends = np.cumsum([0.1, 0.2, 0.3, 0.4])
    assert got == {(i, n): int(np.searchsorted(ends, (i * 8 + n) / 400.0, side="right").clip(0, 3)) for i in range(50) for n in range(8)}


def test_trips_of_legs_are_shuffled(spark):
    trips = spark.range(50).select(F.col("id").alias("trip_id"), (F.col("id") % 5).alias("origin"), (F.col("id") % 7).alias("primary_dest"))
    sample = spark.range(50).select(F.col("id").alias("trip_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("dest"))
    with broadcasts_of(spark, "1b"):
        got = {(r.trip_id, r.dest, r.direction, r.leg_orig, r.leg_dest) for r in lookup.legs(sample, trips).collect()}
    assert got == {x for i in range(50) for d in range(4) for x in ((i, d, "od", i % 5, d), (i, d, "dp", d, i % 7))}


@pytest.mark.parametrize("name", ["destination_choice", "destination_sample", "trip_destinations"])
def test_only_dimensions_are_broadcast(spark, name):
    """120,000 draws of 15,000 customers would take more than the matrices of the nations, which are 2 MB at most."""
    got = catalogue.QUERIES[name](spark, FOLDER)
    with broadcasts_of(spark, "2m"):
        rows = got.collect()
    connection = duckdb.connect()
    for table in ("customer", "nation"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = connection.execute(catalogue.ORACLE_SQL[name])
    assert rows_of(got.columns, rows) == rows_of([x[0] for x in want.description], want.fetchall())
