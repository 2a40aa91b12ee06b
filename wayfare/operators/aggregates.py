"""Ordered sums, factorizations and stable extractions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segmented_sum(rows: DataFrame, group: str, value: str, *more: Column) -> DataFrame:
    """Sum of each group, and more aggregates beside it: partial sums before the shuffle."""
    return rows.groupBy(group).agg(F.sum(value).alias(value), *more)


def ordered_sum(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Sum of each group in a fixed order of rows, for results that do not depend on partitioning.

    A group is gathered, so it must be small by nature, as a chooser's alternatives are; ``segmented_sum`` has no such bound.
    """
    held = F.sort_array(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v"))))
    return rows.groupBy(group).agg(F.aggregate(held, F.lit(0.0), lambda a, x: a + x["v"]).alias(value))


def first_of_run(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds is_start: whether a row is its group's first in ``order``."""
    return rows.withColumn("is_start", F.row_number().over(Window.partitionBy(group).orderBy(order)) == 1)


def stable(rows: DataFrame, owner: str, columns: list[str]) -> DataFrame:
    """One row for each owner of columns that must not vary within it; variation raises."""
    kinds = dict(rows.dtypes)
    low = [F.min(c).alias(c) for c in columns]
    high = [F.max(c).alias(f"_high_{c}") for c in columns]
    found = rows.groupBy(owner).agg(*low, *high)

    def same(c: str) -> Column:
        bad = F.raise_error(F.lit(f"{c} varies within an owner")).cast(kinds[c])
        return F.when(~F.col(c).eqNullSafe(F.col(f"_high_{c}")), bad).otherwise(F.col(c)).alias(c)

    return found.select(owner, *[same(c) for c in columns])


def directional_state(legs: DataFrame, trip: str, direction: str, columns: list[str]) -> DataFrame:
    """One state row for each trip and direction."""
    keyed = legs.withColumn("_key", F.struct(trip, direction))
    return stable(keyed, "_key", columns).select(f"_key.{trip}", f"_key.{direction}", *columns)


def codes(rows: DataFrame, column: str, name: str, parts: int = 256) -> DataFrame:
    """Adds dense codes of a column's values from 0, in order of value; a null has none.

    A bounded sample of values gives limits between ``parts`` ranges; ranges are counted (a small table) and numbered
    each for itself, so no task holds all values.
    """
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    seen = sorted(r[0] for r in values.orderBy(F.xxhash64(column)).limit(16 * parts).collect())
    limits = seen[:: max(1, -(-len(seen) // parts))][1:]
    part = F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x <= F.col(column))) if limits else F.lit(0)
    dealt = values.withColumn("_part", part)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    coded = dealt.withColumn("_own", within).join(bases, "_part").select(column, (F.col("_base") + F.col("_own")).cast("int").alias(name))
    return rows.join(coded, column, "left")


def bin_labels(value: Column, edges: list[float], how: str = "mid") -> Column:
    """Label of the bin that holds a value: its left, mid or right edge, or its rank."""
    out = F.lit(None).cast("string")
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        label = {"left": f"{low:g}", "mid": f"{(low + high) / 2:g}", "right": f"{high:g}", "rank": str(i)}[how]
        out = F.when((value > low) & (value <= high), label).otherwise(out)
    return out


def in_ranges(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Adds part: consecutive ranges of ``size`` values of an integer key, from 0.

    Rows of a part then lie together after ``repartitionByRange("part")``, and no key is in two parts.
    """
    if size <= 0:
        raise ValueError("a range must hold something")
    return rows.withColumn("part", F.floor(F.col(key) / size))


def pairwise_sum(values: Column) -> Column:
    """Single-precision sum of an array as NumPy adds it, pairwise.

    Arrays of one length are summed together, as NumPy takes the same steps for each row of a table.
    """

    @F.pandas_udf("float")
    def run(arrays: pd.Series) -> pd.Series:
        sizes = arrays.map(len).to_numpy()
        out = np.zeros(len(arrays), np.float32)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            out[own] = np.stack([np.asarray(arrays.iloc[i], np.float32) for i in own]).sum(axis=1, dtype=np.float32)
        return pd.Series(out)

    return run(values)


#: Terms that NumPy adds in eight sums side by side, and what it splits longer lists into (fixed values).
LANES, BLOCK = 8, 128


def pairwise_tree(terms: list[str]) -> str:
    """SQL text of NumPy's pairwise sum of single-precision terms: under eight from the left, up to 128 in eight lanes, longer ones by halves."""
    n = len(terms)
    if n < LANES:
        return "(" + " + ".join(terms or ["CAST(0 AS FLOAT)"]) + ")"
    if n <= BLOCK:
        whole = n - n % LANES
        lanes = ["(" + " + ".join(terms[i:whole:LANES]) + ")" for i in range(LANES)]
        while len(lanes) > 1:
            lanes = [f"({a} + {b})" for a, b in zip(lanes[::2], lanes[1::2], strict=True)]
        return "(" + " + ".join([lanes[0], *terms[whole:]]) + ")"
    half = n // 2 - n // 2 % LANES
    return f"({pairwise_tree(terms[:half])} + {pairwise_tree(terms[half:])})"


def pairwise_columns(values: str, lengths: list[int]) -> Column:
    """``pairwise_sum`` of an array column of single precision as compiled code: one tree for each length; another length raises."""
    cases = " ".join(f"WHEN {n} THEN {pairwise_tree([f'`{values}`[{i}]' for i in range(n)])}" for n in lengths)
    return F.expr(f"CASE size(`{values}`) {cases} ELSE CAST(raise_error(concat('no sum of ', size(`{values}`), ' terms was made')) AS FLOAT) END")


def compare_outputs(reference: DataFrame, candidate: DataFrame, key: list[str], tolerances: dict[str, float]) -> DataFrame:
    """Differences between two outputs: (key, column, reference, candidate); none means they agree.

    Columns in ``tolerances`` may differ by so much, all others not at all.
    """
    others = [c for c in reference.columns if c not in key]
    a = reference.select(*key, F.struct(*others).alias("_a"))
    b = candidate.select(*key, F.struct(*others).alias("_b"))
    both = a.join(b, key, "full_outer")
    parts = []
    for c in others:
        x, y = F.col("_a")[c], F.col("_b")[c]
        if c in tolerances:
            near = (F.abs(x - y) <= tolerances[c]) | (F.isnan(x.cast("double")) & F.isnan(y.cast("double"))) | x.eqNullSafe(y)
            differs = ~F.coalesce(near, F.lit(False))
        else:
            differs = ~x.eqNullSafe(y)
        differs = differs | F.col("_a").isNull() | F.col("_b").isNull()
        parts.append(F.when(differs, F.struct(F.lit(c).alias("column"), x.cast("string").alias("reference"), y.cast("string").alias("candidate"))))
    return both.select(*key, F.inline(F.filter(F.array(*parts), lambda p: p.isNotNull())))
