"""Planted faults are named by term and category, and the report says so."""

from __future__ import annotations

import numpy as np
import pytest

from wayfare.operators import comparisons
from wayfare.plans.session import workspace

TERMS, ALTERNATIVES = ["a", "b", "c", "d"], ["x", "y"]
WEIGHTS = {"x": [0.1, -0.7, 0.3, 1.1], "y": [1.0, 0.0, 0.2, -0.4]}
ROW = "who long, features array<float>, utilities array<float>"


def summed(features, weights):
    total = np.float32(0)
    for x, w in zip(features, weights, strict=True):
        total = np.float32(total + np.float32(np.float32(x) * np.float32(w)))
    return total


def evaluated(features):
    return {i: (f, [summed(f, WEIGHTS[a]) for a in ALTERNATIVES]) for i, f in features.items()}


def table(spark, held):
    return spark.createDataFrame([(i, None if f is None else [float(x) for x in f], None if u is None else [float(x) for x in u]) for i, (f, u) in held.items()], ROW)


def found_in(spark, strict, other):
    got = comparisons.divergences(table(spark, strict), table(spark, other), "who", TERMS, ALTERNATIVES, WEIGHTS)
    return got, sorted((r.who, r.kind, r.name, r.first_term, r.category) for r in got.collect())


def test_planted_faults(spark):
    rng = np.random.default_rng(13)
    features = {i: rng.normal(size=4).astype(np.float32) for i in range(40)}
    features[7][2] = np.nan
    strict = evaluated(features)
    other = {i: (f.copy(), list(u)) for i, (f, u) in strict.items()}
    for i in (3, 9):
        other[i][0][1] += 1
        other[i] = (other[i][0], [summed(other[i][0], WEIGHTS[a]) for a in ALTERNATIVES])
    other[5][1][0] = np.float32(other[5][1][0] + 1)
    other[11][0][3] = np.inf
    want = [(3, "feature", "b", None, "expression"), (3, "utility", "x", "b", "inputs"), (9, "feature", "b", None, "expression"), (9, "utility", "x", "b", "inputs")]
    want += [(5, "utility", "x", None, "accumulation"), (11, "feature", "d", None, "expression")]
    other[12] = (other[12][0][:3], other[12][1])
    other[99] = other.pop(13)
    want += [(i, "row", "row", None, "row") for i in (12, 13, 99)]
    found, got = found_in(spark, strict, other)
    assert got == sorted(want)
    document = comparisons.report(table(spark, strict), found, "who", TERMS, ALTERNATIVES)
    assert document["categories"] == {"expression": 3, "inputs": 2, "accumulation": 1, "row": 3} and not document["exact"]
    assert list(document["features"]["divergent"]) == ["b", "d"] and document["features"]["exact"] == 2
    assert document["features"]["first"]["name"] == "b" and document["features"]["first"]["key"] == 3
    assert document["features"]["divergent"]["b"] == {"cells": 2, "max_abs": pytest.approx(1.0)} and document["features"]["divergent"]["d"]["max_abs"] == "inf"
    assert document["utilities"]["first"] == {"name": "x", "key": 3, "strict": pytest.approx(float(strict[3][1][0])), "other": pytest.approx(float(other[3][1][0])), "first_term": "b"}
    place = f"{workspace(spark, 'report')}/report"
    comparisons.write_report(spark, document, place)
    assert comparisons.read_report(spark, place) == document
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        comparisons.write_report(spark, document, place)


def test_equal_sides_are_exact(spark):
    rng = np.random.default_rng(14)
    strict = evaluated({i: rng.normal(size=4).astype(np.float32) for i in range(20)})
    found, got = found_in(spark, strict, strict)
    document = comparisons.report(table(spark, strict), found, "who", TERMS, ALTERNATIVES)
    assert got == [] and document["exact"] and document["features"]["first"] is None and document["rows"] == 20
    found, got = found_in(spark, {}, {})
    assert got == [] and comparisons.report(table(spark, {}), found, "who", TERMS, ALTERNATIVES)["rows"] == 0


def test_matrices_by_cell_and_total(spark):
    cell = "matrix string, orig int, dest int, value double"
    a = spark.createDataFrame([("m", 1, 1, 2.0), ("m", 1, 2, 3.0), ("m", 2, 1, 1.0), ("n", 1, 1, 5.0)], cell)
    b = spark.createDataFrame([("m", 1, 1, 1.5), ("m", 1, 1, 0.5), ("m", 1, 2, 3.25), ("m", 3, 3, 4.0), ("k", 1, 1, 1.0), ("n", 1, 1, 5.0), ("n", 9, 9, 0.0)], cell)
    cells, totals = comparisons.compare_matrices(a, b, 0.25)
    assert sorted(tuple(r) for r in cells.collect()) == [("k", 1, 1, 0.0, 1.0), ("m", 2, 1, 1.0, 0.0), ("m", 3, 3, 0.0, 4.0)]
    assert sorted(tuple(r) for r in totals.collect()) == [("k", 0.0, 1.0, 1, 1.0), ("m", 6.0, 9.25, 2, 4.0), ("n", 5.0, 5.0, 0, 0.0)]
