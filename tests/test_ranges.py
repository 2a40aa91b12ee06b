"""Ranges of households: they cover all ids, and later stages do not exchange rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wayfare.plans.session import workspace
from wayfare.sources.ranges import Ranged, household_ranges, range_of


@pytest.mark.parametrize(("total", "most"), [(0, 5), (1, 5), (5, 5), (6, 5), (23, 4), (1000, 7), (1000, 1)])
def test_ranges_cover_all_households(spark, total, most):
    ranges = household_ranges(total, most)
    assert [i for a, b in ranges for i in range(a, b)] == list(range(total)) and all(0 < b - a <= most for a, b in ranges)
    numbers = {r.id: r.n for r in spark.range(-1, total + 1).select("id", range_of(F.col("id"), total, most).alias("n")).collect()}
    assert numbers[-1] is None and numbers[total] is None
    assert all(ranges[numbers[i]][0] <= i < ranges[numbers[i]][1] for i in range(total))


def test_what_is_no_range():
    with pytest.raises(ValueError, match="hold something"):
        household_ranges(5, 0)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0].count("Exchange")


def test_later_stages_exchange_nothing(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        place = workspace(spark, "ranges")
        people = spark.range(1000).select(F.col("id").alias("h"), (F.col("id") % 7).alias("x"))
        trips = spark.range(6000).select((F.col("id") * 37 % 1000).alias("h"), F.col("id").alias("t"))
        ranges = Ranged.of(people, "h", 60)
        a, b = ranges.write(people, "people", place), ranges.write(trips, "trips", place)
        counted = b.groupBy("part", "h").agg(F.count(F.lit(1)).alias("n"))
        both = a.join(counted, ["part", "h"]).withColumn("most", F.max("n").over(ranges.window()))
        assert exchanges(both) == 0 and exchanges(people.join(trips, "h")) == 2
        assert sorted((r.h, r.x, r.n, r.most) for r in both.collect()) == [(i, i % 7, 6, 6) for i in range(1000)]
        sizes = sorted(ranges.sizes(b).collect())
        assert [(r.start, r.stop) for r in sizes] == household_ranges(1000, 60) and all(r.rows == 6 * (r.stop - r.start) for r in sizes)
        with pytest.raises(Exception, match="no range holds household"):
            ranges.write(spark.createDataFrame([(None, 1)], "h long, t long"), "lost", place)
        with pytest.raises(Exception, match="no range holds household 1000"):
            ranges.write(spark.createDataFrame([(1000, 1)], "h long, t long"), "beyond", place)
        empty = Ranged.of(people.where("h < 0"), "h", 60)
        assert empty.write(people.where("h < 0"), "none", place).count() == 0
        with pytest.raises(ValueError, match="from 0"):
            Ranged.of(spark.createDataFrame([(-1,)], "h long"), "h", 5)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
