"""Guarded samples: what is proven holds for every utility within the bounds, and what is not can change."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wayfare.operators import guards


def chosen(u, z):
    w = np.exp(u - u.max())
    share = np.cumsum(w) / w.sum()
    return int(np.argmax(share > z)) if (share > z).any() else len(u) - 1


def cases(rng, n=300):
    for i in range(n):
        size = rng.integers(1, 8)
        yield i, rng.normal(size=size), rng.uniform(0, 0.05, size) * rng.integers(0, 2), rng.random(4)


def tables(spark, held):
    rows = [(i, k, float(a), float(b), "x") for i, u, e, _ in held for k, (a, b) in enumerate(zip(u, e, strict=True))]
    draws = [(i, k, float(x)) for i, _, _, z in held for k, x in enumerate(z)]
    return spark.createDataFrame(rows, "who long, alt int, u double, e double, prob string"), spark.createDataFrame(draws, "who long, draw_no int, rand double")


def test_proven_is_what_no_perturbation_changes(spark):
    rng = np.random.default_rng(28)
    held = list(cases(rng))
    rows, draws = tables(spark, held)
    got = {(r.who, r.draw_no): r for r in guards.proven(rows, draws, "who", "alt", "u", "e").collect()}
    assert len(got) == 4 * len(held)
    open_ = 0
    for i, u, e, z in held:
        for k, x in enumerate(z):
            r = got[i, k]
            assert r.choice == chosen(u, x)
            # the two ends of what the bounds allow: all up to a place low and the rest high, or the other way round
            ends = {chosen(u + np.where(np.arange(len(u)) <= r.choice, -e, e), x), chosen(u + np.where(np.arange(len(u)) < r.choice, e, -e), x)}
            assert r.proven == (ends == {r.choice})
            open_ += not r.proven
            if r.proven:
                assert all(chosen(u + e * rng.uniform(-1, 1, len(u)), x) == r.choice for _ in range(20))
    assert 5 < open_ < 400


def test_guarded_samples_are_those_of_exact_utilities(spark):
    rng = np.random.default_rng(29)
    held = [(i, u + e * rng.uniform(-1, 1, len(u)), e, z) for i, u, e, z in cases(rng)]
    exact = {i: (np.array(u), z) for i, u, _, z in held}
    rows, draws = tables(spark, [(i, u + e * rng.uniform(-1, 1, len(u)), e, z) for i, u, e, z in held])
    truth = tables(spark, held)[0].select("who", "alt", F.col("u").alias("utility"))
    asked = []

    def resolve(ids):
        asked.append(ids.count())
        assert asked[0] == ids.distinct().count()
        return truth.join(ids, "who")

    got = guards.guarded_sample(rows, draws, "who", "alt", "u", "e", resolve).collect()
    assert {(r.who, r.draw_no): r.choice for r in got} == {(i, k): chosen(u, x) for i, (u, z) in exact.items() for k, x in enumerate(z)}
    assert len({r.who for r in got if r.guarded}) == asked[0] and 0 < asked[0] < 200


def test_unavailable_null_and_empty(spark):
    rows = spark.createDataFrame([(1, 0, None, 0.0), (1, 1, 0.5, 0.0), (1, 2, float("-inf"), 0.0), (2, 0, float("nan"), 0.0), (3, 0, 1.0, 0.0)], "who long, alt int, u double, e double")
    draws = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.9999), (2, 0, 0.5), (9, 0, 0.5)], "who long, draw_no int, rand double")
    got = guards.proven(rows, draws, "who", "alt", "u", "e").collect()
    assert sorted((r.who, r.draw_no, r.choice, r.prob, r.proven) for r in got) == [(1, 0, 1, 1.0, True), (1, 1, 1, 1.0, True)]
    assert guards.proven(rows.where("who < 0"), draws, "who", "alt", "u", "e").count() == 0


def test_single_precision_stays_within_its_bound(spark):
    rng = np.random.default_rng(30)
    x, b = rng.normal(size=(400, 6)) * 10.0 ** rng.integers(-3, 4, (400, 6)), rng.normal(size=6)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, " + ", ".join(f"x{k} double" for k in range(6)))
    products = [F.col(f"x{k}") * float(b[k]) for k in range(6)]
    single = F.lit(0.0).cast("float")
    for k in range(6):
        single = (single + (F.col(f"x{k}").cast("float") * F.lit(float(b[k])).cast("float")).cast("float")).cast("float")
    got = rows.select(single.cast("double").alias("s"), sum(products[1:], products[0]).alias("d"), guards.single_bound(products).alias("e")).collect()
    assert all(abs(r.s - r.d) <= r.e for r in got) and any(abs(r.s - r.d) > r.e / 30 for r in got)
