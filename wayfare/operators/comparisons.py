"""Reports of where two evaluations, or two sets of matrices, part."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import ieee

VERSION = 1


def _running(features: Column, weights: list[float], take) -> Column:
    """Folds the terms of one alternative in order, in single precision as ``choice.ordered_float_utility`` does."""
    terms = F.zip_with(features, F.array(*[F.lit(float(w)).cast("float") for w in weights]), lambda x, w: ieee.flushed(x.cast("float") * w))
    return take(terms)


def ordered_utility(features: Column, weights: list[float]) -> Column:
    """The single-precision sum of terms times weights, from the first on, rounded and flushed at every step."""
    zero = F.lit(0.0).cast("float")
    return _running(features, weights, lambda t: F.aggregate(t, zero, lambda a, x: ieee.flushed((a + x).cast("float"))))


def parting(strict: Column, other: Column, weights: list[float]) -> Column:
    """0-based position of the first term after which the running sums of both sides differ; -1 if none."""
    zero = F.lit(0.0).cast("float")
    start = F.struct(zero.alias("a"), zero.alias("b"), F.lit(0).alias("at"), F.lit(-1).alias("first"))

    def step(s: Column, t: Column) -> Column:
        a, b = (ieee.flushed((s[k] + t[k]).cast("float")) for k in "ab")
        first = F.when((s["first"] < 0) & ~a.eqNullSafe(b), s["at"]).otherwise(s["first"])
        return F.struct(a.alias("a"), b.alias("b"), (s["at"] + 1).alias("at"), first.alias("first"))

    sides = [_running(side, weights, lambda t: t) for side in (strict, other)]
    both = F.zip_with(*sides, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.aggregate(both, start, step, lambda s: s["first"])


def divergences(strict: DataFrame, other: DataFrame, key: str, terms: list[str], alternatives: list[str], weights: dict[str, list[float]]) -> DataFrame:
    """Every cell in which two evaluations differ: (key, kind, name, strict, other, first_term, category).

    Both sides are rows (key, features, utilities), arrays of floats in the order of ``terms`` and ``alternatives``.  A feature that
    differs is an ``expression`` fault of its term.  A utility that differs is put down to its ``inputs`` if the other side's
    features, summed strictly in order, give the other side's utility, and else to ``accumulation``; ``first_term`` is the
    term at which the running sums of both sides' features part, null where they never do.  Not-a-number equals itself.  A key on one side only is a
    ``row`` fault, as is one whose arrays are null or have another length.
    """
    a = strict.select(key, F.col("features").alias("_sf"), F.col("utilities").alias("_su"))
    b = other.select(key, F.col("features").alias("_of"), F.col("utilities").alias("_ou"))
    both = a.join(b, key, "full_outer")
    names, choices = F.array(*map(F.lit, terms)), F.array(*map(F.lit, alternatives))
    cell = "array<struct<kind:string,name:string,strict:float,other:float,first_term:string,category:string>>"

    def entry(kind: str, name: Column, x: Column, y: Column, first: Column, category: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), x.cast("float").alias("strict"), y.cast("float").alias("other"), first.cast("string").alias("first_term"), category.alias("category"))

    nothing = F.lit(None)
    sizes = (("_sf", terms), ("_of", terms), ("_su", alternatives), ("_ou", alternatives))
    whole = F.coalesce(F.forall(F.array(*[F.size(c) == len(n) for c, n in sizes]), lambda x: x), F.lit(False))
    row = F.array(entry("row", F.lit("row"), nothing, nothing, nothing, F.lit("row"))).cast(cell)
    features = F.array(*[
        F.when(~F.get("_sf", F.lit(i)).cast("float").eqNullSafe(F.get("_of", F.lit(i)).cast("float")), entry("feature", names[i], F.get("_sf", F.lit(i)), F.get("_of", F.lit(i)), nothing, F.lit("expression")))
        for i in range(len(terms))
    ]).cast(cell)
    found = []
    for i, name in enumerate(alternatives):
        x, y = (F.get(c, F.lit(i)).cast("float") for c in ("_su", "_ou"))
        part = parting(F.col("_sf"), F.col("_of"), weights[name])
        explained = ordered_utility(F.col("_of"), weights[name]).eqNullSafe(y)
        first = F.when(part >= 0, F.get(names, part))
        found.append(F.when(~x.eqNullSafe(y), entry("utility", choices[i], x, y, first, F.when(explained, "inputs").otherwise("accumulation"))))
    cells = F.concat(features, F.array(*found).cast(cell))
    return both.select(key, F.inline(F.when(whole, F.filter(cells, lambda c: c.isNotNull())).otherwise(row)))


def report(strict: DataFrame, found: DataFrame, key: str, terms: list[str], alternatives: list[str]) -> dict:
    """A JSON document of ``divergences``: counts by category, each term and alternative that differs with its largest difference, and the
    first cell of each kind, terms in order before keys in order."""
    order = {n: i for i, n in enumerate(terms)}, {n: i for i, n in enumerate(alternatives)}
    gap = F.abs(F.col("strict").cast("double") - F.col("other").cast("double"))
    rows = found.groupBy("kind", "name").agg(
        F.count(F.lit(1)).alias("cells"), F.max(F.when(~F.isnan(gap), gap)).alias("most"), F.min(F.struct(key, "strict", "other", "first_term")).alias("first")
    )
    held = {(r["kind"], r["name"]): r for r in rows.collect()}
    categories = {r["category"]: r["count"] for r in found.groupBy("category").count().collect()}

    def number(x: float | None) -> float | str | None:
        return x if x is None or abs(x) < float("inf") else str(x)

    def part(kind: str, names: list[str], place: dict[str, int]) -> dict:
        own = sorted((name for k, name in held if k == kind), key=place.__getitem__)
        first = held[kind, own[0]]["first"] if own else None
        detail = first and {"name": own[0], "key": first[key], "strict": number(first["strict"]), "other": number(first["other"]), "first_term": first["first_term"]}
        return {"exact": len(names) - len(own), "divergent": {n: {"cells": held[kind, n]["cells"], "max_abs": number(held[kind, n]["most"])} for n in own}, "first": detail}

    return {
        "version": VERSION,
        "rows": strict.count(),
        "terms": len(terms),
        "alternatives": len(alternatives),
        "exact": not held,
        "features": part("feature", terms, order[0]),
        "utilities": part("utility", alternatives, order[1]),
        "categories": {k: categories.get(k, 0) for k in ("expression", "inputs", "accumulation", "row")},
    }


def write_report(spark: SparkSession, document: dict, path: str) -> None:
    """A report as one JSON text file, its keys in order; an existing one is never overwritten."""
    text = json.dumps(document, indent=2, sort_keys=True, allow_nan=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def compare_matrices(reference: DataFrame, candidate: DataFrame, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(cells, totals) of two sets of sparse matrices (matrix, orig, dest, value), a cell that is left out being 0.

    ``cells`` has those whose values differ by more than ``tolerance``; ``totals`` a row for each matrix of either side: both totals,
    how many cells differ, and the largest difference.  A cell that occurs twice on a side counts with its sum.
    """
    both = reference.select("matrix", "orig", "dest", F.col("value").cast("double").alias("reference"), F.lit(0.0).alias("candidate")).unionByName(
        candidate.select("matrix", "orig", "dest", F.lit(0.0).alias("reference"), F.col("value").cast("double").alias("candidate"))
    )
    cells = both.groupBy("matrix", "orig", "dest").agg(F.sum("reference").alias("reference"), F.sum("candidate").alias("candidate"))
    gap = F.abs(F.col("reference") - F.col("candidate"))
    off = F.coalesce(gap > tolerance, F.lit(True)) & ~F.col("reference").eqNullSafe(F.col("candidate"))
    totals = cells.groupBy("matrix").agg(
        F.sum("reference").alias("reference"), F.sum("candidate").alias("candidate"), F.count_if(off).alias("differing"), F.max(gap).alias("largest")
    )
    return cells.where(off), totals
