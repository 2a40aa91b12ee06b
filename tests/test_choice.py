import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import choice, nested


def chosen(spark, rows, **columns):
    schema = "id long, u array<double>, z double" + (", open array<boolean>" if len(rows[0]) == 4 else "")
    df = spark.createDataFrame(rows, schema)
    got = choice.choose(df, "u", "z", "open" if "open" in df.columns else None).orderBy("id").collect()
    columns = choice.choose(df, "u", "z", "open" if "open" in df.columns else None, 2).orderBy("id").collect()
    assert [(r.choice, r.logsum) for r in got] == [(r.choice, r.logsum) for r in columns]
    return [(r.choice, r.logsum) for r in got]


def test_long_draws_must_be_below_one(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.5), (1, 1, 1.0, 1.5)], "id long, alt int, u double, z double")
    with pytest.raises(Exception, match="draws must lie"):
        choice.choose_long(rows, "id", "alt", "u", "z").collect()


def test_golden_choices(spark):
    got = chosen(
        spark,
        [
            (1, [0.0, 0.0], 0.25, [True, True]),
            (2, [0.0, math.log(3)], 0.80, [True, True]),
            (3, [3.0, 10.0], 0.999, [True, False]),
            (4, [float("nan"), float("inf")], 0.5, [True, True]),
            (5, [0.0, 1.0], 0.0, [False, True]),
        ],
    )
    assert [c for c, _ in got] == [0, 1, 0, -1, 0]
    assert got[0][1] == pytest.approx(math.log(2)) and got[1][1] == pytest.approx(math.log(4)) and got[2][1] == 3.0
    assert got[3][1] == float("-inf")


def test_draw_must_be_below_one(spark):
    with pytest.raises(Exception, match="draws must lie"):
        chosen(spark, [(1, [0.0, 1.0], 1.0)])


@pytest.mark.parametrize("alternatives", [6, 33, 190])
def test_array_and_long_forms_agree(spark, alternatives):
    rng = np.random.default_rng(alternatives)
    u, z = rng.normal(size=(40, alternatives)) * 3, rng.random(40)
    wide = spark.createDataFrame([(i, [float(x) for x in row], float(d)) for i, (row, d) in enumerate(zip(u, z))], "id long, u array<double>, z double")
    long = wide.select("id", "z", F.posexplode("u").alias("alt", "util"))
    a = {r.id: (r.choice, r.logsum) for r in choice.choose(wide, "u", "z").collect()}
    columns = {r.id: (r.choice, r.logsum) for r in choice.choose(wide, "u", "z", width=alternatives).collect()}
    assert {i: c for i, (c, _) in columns.items()} == {i: c for i, (c, _) in a.items()}
    assert all(s == pytest.approx(a[i][1], abs=1e-12) for i, (_, s) in columns.items())
    w = np.exp(u - u.max(axis=1, keepdims=True))
    want = (np.cumsum(w, axis=1) >= (z * w.sum(axis=1))[:, None]).argmax(axis=1)
    assert [a[i][0] for i in range(40)] == want.tolist()
    for parts in (1, 7):
        b = choice.choose_long(long.repartition(parts), "id", "alt", "util", "z").collect()
        assert {r.id: r.choice for r in b} == {i: int(x) for i, x in enumerate(want)}
        assert all(abs(r.logsum - a[r.id][1]) < 1e-9 for r in b)


def test_probabilities_and_labels(spark):
    df = spark.createDataFrame([(1, [0.2, 0.8], 0.2), (2, [0.2, 0.8], 0.21), (3, [0.1, 0.85], 0.99)], "id long, p array<double>, z double")
    held = choice.make_choices(df, "p", "z", allow_bad=True).withColumn("label", choice.labelled(F.col("choice"), [11, 42]))
    assert [r.label for r in held.orderBy("id").collect()] == [11, 42, 42]
    with pytest.raises(Exception, match="sum to 1"):
        choice.make_choices(df, "p", "z").collect()
    p, s = choice.probabilities(F.col("u"))
    row = spark.createDataFrame([([0.0, 1.0, -800.0],)], "u array<double>").select(p.alias("p"), s.alias("s")).first()
    assert row.p[2] == 0 and sum(row.p) == pytest.approx(1) and row.s == pytest.approx(math.log(1 + math.e))


def brute_nested(tree, u, scale=1.0):
    own = scale * tree.coefficient
    parts = [u[p] / own if isinstance(p, str) else brute_nested(p, u, own) for p in tree.parts]
    return tree.coefficient * math.log(sum(map(math.exp, parts)))


def test_nested_logsums_and_probabilities(spark):
    tree = nested.validated(nested.mode_tree())
    rng = np.random.default_rng(3)
    rows = [[float(x) for x in rng.normal(size=21)] for _ in range(5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["id", *[f"m{i}" for i in range(21)]])
    for options in ({}, {"shift": False}):
        got = {r.id: r.logsum for r in nested.logsum(df, tree, **options).collect()}
        for i, r in enumerate(rows):
            assert got[i] == pytest.approx(brute_nested(tree, {f"m{j}": x for j, x in enumerate(r)}), abs=1e-5)
    held = nested.probabilities(df, tree, "p").withColumn("bad", nested.guard(tree, F.col("p"))).collect()
    assert all(sum(r.p) == pytest.approx(1) and not r.bad for r in held)
    # a probability is the derivative of the log-sum
    base = {f"m{j}": x for j, x in enumerate(rows[0])}
    slope = (brute_nested(tree, base | {"m3": base["m3"] + 1e-6}) - brute_nested(tree, base)) / 1e-6
    assert next(r for r in held if r.id == 0).p[3] == pytest.approx(slope, abs=1e-5)


def test_bad_trees():
    with pytest.raises(ValueError):
        nested.validated(nested.Nest("r", 1.0, ("a", nested.Nest("n", 0.5, ("a",)))))
    with pytest.raises(ValueError):
        nested.validated(nested.Nest("r", 1.5, ("a",)))


def test_single_precision_sums(spark):
    df = spark.createDataFrame([(1e8, 1.0, -1e8, 1.0)], "a double, b double, c double, d double")
    left = choice.grouped_sum([F.col(x) for x in "abcd"])
    pairs = choice.grouped_sum([F.col(x) for x in "acbd"], 2)
    row = df.select(left.alias("left"), pairs.alias("pairs")).first()
    assert row.left == 1.0 and row.pairs == 2.0
