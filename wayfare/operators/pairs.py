"""Evaluation on distinct pairs, and back to the rows that hold them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.aggregates import codes

#: Range of either part of a typed pair: 16 bits.
LOW, HIGH = -(1 << 15), (1 << 15) - 1
#: Pairs with more than 1 / HOT of all rows, of which there are fewer than HOT, are joined by broadcast.
HOT = 64


def pair_key(first: Column, second: Column) -> Column:
    """Both 16-bit parts in one long that orders like the pair; null if either is, and an error beyond 16 bits."""

    def part(x: Column) -> Column:
        value = x.cast("long")
        return F.when(value.between(LOW, HIGH) & (value == x), value - LOW).when(x.isNotNull(), F.raise_error(F.lit("a part of a pair does not fit 16 bits")).cast("long"))

    return F.shiftleft(part(first), 16).bitwiseOR(part(second))


def unpaired(key: Column) -> tuple[Column, Column]:
    """The parts of a ``pair_key``."""
    return (F.shiftright(key, 16) + LOW).cast("short"), (key.bitwiseAND(0xFFFF) + LOW).cast("short")


def pair_slots(rows: DataFrame, first: str, second: str, slot: str = "slot") -> DataFrame:
    """Adds a dense number from 0 for each distinct pair, in lexicographic order; rows with a null part have none.

    Ranges of keys are numbered each for itself (``aggregates.codes``), so that no task holds all pairs.
    """
    held = codes(rows.withColumn("_pair", pair_key(F.col(first), F.col(second))), "_pair", slot)
    return held.select(*rows.columns, slot)


def slot_values(rows: DataFrame, slot: str, value: str, count: int) -> DataFrame:
    """(slot, value) of every slot from 0 to ``count`` - 1; raises if a slot is missing or outside, or its rows differ.

    Equal is equal as it is stored: nulls equal nulls, and not-a-number itself.
    """
    kind = rows.schema[value].dataType.simpleString()
    found = rows.groupBy(slot).agg(F.min(F.struct(value)).alias("_low"), F.max(F.struct(value)).alias("_high"))
    bad = F.when(~F.coalesce(F.col(slot).between(0, count - 1), F.lit(False)), "a slot is out of range").when(~F.col("_low").eqNullSafe(F.col("_high")), "rows of a slot differ")
    if found.where(F.col(slot).between(0, count - 1)).count() != count:
        raise ValueError("a slot has no rows")
    return found.select(F.col(slot), F.when(bad.isNotNull(), F.raise_error(bad).cast(kind)).otherwise(F.col("_low")[value]).alias(value))


def on_distinct(
    rows: DataFrame, keys: list[str], evaluate: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df
) -> DataFrame:
    """``rows`` with what ``evaluate`` adds, worked out once for each distinct combination of ``keys``.

    ``evaluate`` gets one row for each combination (``keys`` and ``sharing``, how many rows hold it) and adds columns.  Its result, which
    ``keep`` writes, goes back by an equi-join that takes nulls for equal.  Combinations with over 1 / HOT of all rows cannot be
    more than HOT, so that those are broadcast, and their rows stay where they are; no key that is shuffled is hot.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("sharing"))
    done = keep(evaluate(counts), "pairs")
    added = [c for c in done.columns if c not in keys]
    total = done.agg(F.sum("sharing")).first()[0] or 0
    named = done.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *added)

    def same(k: int) -> Column:
        return F.col(keys[k]).eqNullSafe(F.col(f"_key_{k}"))

    on = same(0)
    for k in range(1, len(keys)):
        on = on & same(k)
    hot = F.broadcast(named.where(F.col("sharing") * HOT > total))
    often = rows.join(hot, on).select(*rows.columns, *added)
    seldom = rows.join(hot, on, "left_anti").join(named.where(F.col("sharing") * HOT <= total), on)
    return often.unionByName(seldom.select(*rows.columns, *added))
