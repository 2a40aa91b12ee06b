"""Pairs: keys and slots beside NumPy, and evaluation once for each pair."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import pairs


def test_keys_order_like_pairs_and_come_apart(spark):
    ends = [-32768, -1, 0, 1, 32767]
    held = [(a, b) for a in ends for b in ends] + [(None, 1), (1, None)]
    rows = spark.createDataFrame(held, "a int, b int").withColumn("k", pairs.pair_key(F.col("a"), F.col("b")))
    first, second = pairs.unpaired(F.col("k"))
    got = rows.select("a", "b", "k", first.alias("x"), second.alias("y")).collect()
    assert all((r.x, r.y) == ((r.a, r.b) if r.k is not None else (None, None)) for r in got) and sum(r.k is None for r in got) == 2
    ordered = sorted((r for r in got if r.k is not None), key=lambda r: r.k)
    assert [(r.a, r.b) for r in ordered] == sorted(x for x in held if None not in x)
    for bad in (32768, -32769):
        with pytest.raises(Exception, match="16 bits"):
            spark.createDataFrame([(bad, 0)], "a int, b int").select(pairs.pair_key(F.col("a"), F.col("b"))).collect()


def test_slots_are_those_of_numpy(spark):
    rng = np.random.default_rng(3)
    start, end = rng.integers(-300, 300, 2000), rng.integers(-4, 4, 2000)
    rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(start, end, strict=True))], "i int, a int, b int")
    got = {r.i: r.slot for r in pairs.pair_slots(rows, "a", "b").collect()}
    _, inverse = np.unique(np.stack([start, end]), axis=1, return_inverse=True)
    assert [got[i] for i in range(2000)] == inverse.ravel().tolist()


def test_slot_values(spark):
    rows = spark.createDataFrame([(0, 1.5), (1, None), (1, None), (2, float("nan")), (2, float("nan")), (0, 1.5)], "slot int, v double")
    got = {r.slot: r.v for r in pairs.slot_values(rows, "slot", "v", 3).collect()}
    assert got[0] == 1.5 and got[1] is None and got[2] != got[2]
    with pytest.raises(Exception, match="no rows"):
        pairs.slot_values(rows, "slot", "v", 4).collect()
    with pytest.raises(Exception, match="out of range"):
        pairs.slot_values(rows, "slot", "v", 2).collect()
    for other in (2.5, None):
        with pytest.raises(Exception, match="differ"):
            pairs.slot_values(rows.unionByName(spark.createDataFrame([(0, other)], rows.schema)), "slot", "v", 3).collect()


def test_each_pair_is_evaluated_once(spark):
    rng = np.random.default_rng(4)
    held = [(i, None if a == 7 else int(a), int(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 40, 3000), rng.integers(0, 30, 3000), strict=True))]
    held += [(3000 + i, 100, 1) for i in range(2000)]
    rows = spark.createDataFrame(held, "i int, a int, b int").repartition(5)
    counted = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(a, b):
        counted.add(1)
        return float((a or -1) * 1000 + b)

    def kept(df, _):
        held = df.collect()
        return spark.createDataFrame(held, df.schema)

    got = pairs.on_distinct(rows, ["a", "b"], lambda df: df.withColumn("v", slow("a", "b")), kept)
    assert {r.i: (r.a, r.b, r.v) for r in got.collect()} == {i: (a, b, float((a or -1) * 1000 + b)) for i, a, b in held}
    assert got.count() == len(held) and counted.value == len({x[1:] for x in held}) < len(held) / 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2
    assert pairs.on_distinct(rows.where("i < 0"), ["a", "b"], lambda df: df.withColumn("v", F.lit(1.0))).count() == 0
