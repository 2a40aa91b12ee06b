"""Nested choice with trees as tables, beside a recursion over the tree and beside the form with columns."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import mode_choice, nested
from wayfare.operators.nested import Nest
from wayfare.plans.mode_queries import TREES

TREE = "purpose string, node string, parent string, coefficient double, position int"


def random_tree(rng, depth=3):
    names = iter(range(1000))

    def nest(d):
        parts = tuple(f"m{next(names)}" if d == 0 or rng.random() < 0.5 else nest(d - 1) for _ in range(rng.randint(1, 3)))
        return Nest(f"n{next(names)}", rng.choice([0.3, 0.5, 0.9, 1.0]), parts)

    return nest(depth)


def plain(tree, utilities):
    """(logsum, probabilities by alternative) of a tree, -inf and zeros where nothing is available."""

    def value(part, scale):
        if isinstance(part, str):
            u = utilities.get(part)
            return -math.inf if u is None or not math.isfinite(u) else u / scale
        below = [value(x, scale * part.coefficient) for x in part.parts]
        top = max(below)
        return -math.inf if top == -math.inf else part.coefficient * (top + math.log(sum(math.exp(x - top) for x in below)))

    shares = {}

    def down(part, scale, p):
        if isinstance(part, str):
            shares[part] = p
            return
        own = scale * part.coefficient
        below = [value(x, own) for x in part.parts]
        top = max(below)
        weights = [0.0 if top == -math.inf else math.exp(x - top) for x in below]
        for x, w in zip(part.parts, weights, strict=True):
            down(x, own, p * w / sum(weights) if sum(weights) else 0.0)

    down(tree, 1.0, 1.0)
    return value(tree, 1.0), shares


def tree_table(spark, trees):
    return spark.createDataFrame([r for p, t in trees.items() for r in mode_choice.tree_rows(t, (p,))], TREE)


def test_random_trees(spark):
    rng = random.Random(5)
    trees = {f"t{i}": random_tree(rng) for i in range(12)} | {"flat": Nest("root", 1.0, ("a", "b", "c"))}
    found = mode_choice.branches(tree_table(spark, trees), ["purpose"])
    choosers, utilities = [], []
    for i in range(120):
        purpose = rng.choice(list(trees))
        choosers.append((i, purpose, rng.random()))
        for k, _ in enumerate(trees[purpose].leaves()):
            u = rng.choice([rng.uniform(-3, 3)] * 4 + [None, float("nan"), float("-inf"), 800.0 if i % 9 == 0 else 0.0])
            utilities.append((i, k, u))
    choosers += [(200, "flat", 0.5), (201, "nowhere", 0.5)]
    utilities += [(200, 0, None), (200, 1, None), (200, 2, None)]
    given = spark.createDataFrame(utilities, "who long, position int, u double")
    rows = spark.createDataFrame(choosers, "who long, purpose string, z double").join(found.rows, "purpose").join(given, ["who", "position"])
    got = {}
    for r in mode_choice.solved(rows, found.depth, "who", "u").collect():
        got.setdefault(r.who, {})[r.alternative] = (r.probability, r.logsum)
    for i, purpose, _ in choosers[:-1]:
        held = {trees[purpose].leaves()[k]: u for j, k, u in utilities if j == i}
        logsum, shares = plain(trees[purpose], held)
        assert set(got[i]) == set(shares)
        for name, (p, s) in got[i].items():
            assert p == pytest.approx(shares[name], abs=1e-12) and s == pytest.approx(logsum, abs=1e-9)


def test_the_mode_tree_agrees_with_its_column_form(spark):
    tree = TREES["work"]
    rng = random.Random(6)
    rows = [(i, *[rng.uniform(-4, 4) for _ in range(21)]) for i in range(50)]
    wide = spark.createDataFrame(rows, "who long, " + ", ".join(f"m{i} double" for i in range(21)))
    columns = {r.who: (r.p, r.s) for r in nested.logsum(nested.probabilities(wide, tree, "p"), tree, "s").select("who", "p", "s").collect()}
    found = mode_choice.branches(tree_table(spark, {"work": tree}), ["purpose"])
    long = spark.createDataFrame([(r[0], k, u) for r in rows for k, u in enumerate(r[1:])], "who long, position int, utility double").join(found.rows, "position")
    for r in mode_choice.solved(long, found.depth, "who").collect():
        p, s = columns[r.who]
        assert r.probability == pytest.approx(p[r.position], abs=1e-13) and r.logsum == pytest.approx(s, abs=1e-12)


def test_choices_by_segment(spark):
    trees = {"a": Nest("root", 1.0, ("x", Nest("n", 0.5, ("y", "z")))), "b": Nest("root", 1.0, ("p", "q"))}
    found = mode_choice.branches(tree_table(spark, trees), ["purpose"])
    coefficients = [("a", "s", k, "one", float(k)) for k in range(3)] + [("a", "t", 0, "one", 5.0), ("a", "t", 2, "slope", -1.0), ("b", "s", 1, "slope", 2.0)]
    found = mode_choice.with_coefficients(found, spark.createDataFrame(coefficients, "purpose string, segment string, position int, term string, coefficient double"), ["segment"], ["one", "slope"])
    rng = random.Random(7)
    people = [(i, rng.choice("ab"), rng.choice("st"), rng.uniform(0, 2), rng.random(), "w") for i in range(80)]
    choosers = spark.createDataFrame(people, "who long, purpose string, segment string, x double, draw double, weight string")
    terms = {"one": F.lit(1.0), "slope": F.col("x")}
    got = {r.who: r for r in mode_choice.choose_modes(choosers, found, "who", "draw", terms, (F.col("who") + F.col("position")) % 4 != 0).collect()}
    assert set(got) == {p[0] for p in people if (p[1], p[2]) != ("b", "t")}
    for i, purpose, segment, x, z, _ in people:
        if i not in got:
            continue
        names = trees[purpose].leaves()
        beta = {(p, s, k, t): v for p, s, k, t, v in coefficients}
        utilities = {n: sum(beta.get((purpose, segment, k, t), 0.0) * v for t, v in (("one", 1.0), ("slope", x))) for k, n in enumerate(names) if (i + k) % 4}
        logsum, shares = plain(trees[purpose], utilities)
        left, want = z, None
        for k, n in enumerate(names):
            left -= shares[n]
            if want is None and left <= 0:
                want = k
        assert (got[i].choice, got[i].alternative) == (want, names[want]) and got[i].logsum == pytest.approx(logsum) and not got[i].guarded
    none = mode_choice.choose_modes(choosers.limit(5), found, "who", "draw", terms, F.lit(False)).collect()
    assert all((r.choice, r.alternative, r.logsum, r.guarded) == (-1, None, -math.inf, False) for r in none)
    far = mode_choice.choose_modes(choosers.where("purpose = 'a'").limit(5), found, "who", "draw", {"one": F.lit(1000.0), "slope": F.col("x")}).collect()
    assert all(r.guarded for r in far if r.choice > 0)
    assert mode_choice.choose_modes(choosers.where("who < 0"), found, "who", "draw", terms).count() == 0


def test_one_shuffle_solves_all_levels(spark):
    found = mode_choice.branches(tree_table(spark, TREES), ["purpose"])
    rows = spark.range(3).withColumn("utility", F.lit(0.0)).crossJoin(found.rows.where("purpose = 'work'"))
    plan = mode_choice.solved(rows, found.depth, "id")._jdf.queryExecution().sparkPlan().toString()
    physical = mode_choice.solved(rows, found.depth, "id")._jdf.queryExecution().executedPlan().toString()
    above = physical.split("Exchange hashpartitioning(id", 1)[0]
    assert above.count("Window") == 2 * found.depth == plan.count("Window")
    assert above.count("Sort [id") == 1 and "Exchange" not in above and "hashpartitioning(id" not in physical.split("hashpartitioning(id", 1)[1]


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda r: r + [("a", "x", "root", None, 7)], "occurs twice"),
        (lambda r: r + [("a", "more", "root", None, 0)], "shares its position"),
        (lambda r: r + [("a", "lost", "nowhere", None, 9)], "hangs on no nest"),
        (lambda r: r + [("a", "bare", "root", 0.5, None)], "is empty"),
        (lambda r: [(*x[:3], 1.5 if x[1] == "n" else x[3], x[4]) for x in r], "outside"),
        (lambda r: r + [("a", "second", None, 1.0, None), ("a", "w", "second", None, 9)], "no single root"),
        (lambda r: r + [("a", "c1", "c2", 1.0, None), ("a", "c2", "c1", 1.0, None), ("a", "w", "c1", None, 9)], "circle"),
    ],
)
def test_what_is_no_tree(spark, change, message):
    rows = mode_choice.tree_rows(Nest("root", 1.0, ("x", Nest("n", 0.5, ("y", "z")))), ("a",))
    with pytest.raises(ValueError, match=message):
        mode_choice.branches(spark.createDataFrame(change(rows), TREE), ["purpose"])


def test_single_precision_rounds_every_step(spark):
    rng = np.random.default_rng(17)
    tree = TREES["work"]
    names = tree.leaves()
    values = rng.normal(size=(60, len(names))).astype(np.float32) * 4
    values[::7, 9:18] = np.float32(-999.0)
    values[3, :2] = -np.inf
    values[4, 6] = np.nan
    values[5, :] = np.finfo(np.float32).min
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "who int, " + ", ".join(f"{n} float" for n in names))

    def solve(part, utilities, scale):
        if isinstance(part, str):
            return utilities[part]
        mu = np.float32(scale * part.coefficient)
        held = [solve(x, utilities, scale * part.coefficient) for x in part.parts]
        z = [np.float32(x / mu) for x in held if x > np.finfo(np.float32).min]
        if not z:
            return np.float32(-np.inf)
        top, total = max(z), np.float32(0)
        for x in z:
            total = np.float32(total + np.float32(math.exp(float(np.float32(x - top)))))
        return np.float32(np.float32(np.float32(math.log(float(total))) + top) * mu)

    got = {r.who: r.s for r in nested.single_logsum(rows, tree, "s").select("who", "s").collect()}
    for i, v in enumerate(values):
        assert got[i] == float(solve(tree, dict(zip(names, v, strict=True)), 1.0))
    assert got[5] == -math.inf
