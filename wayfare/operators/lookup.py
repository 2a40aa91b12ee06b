"""Keyed lookups and interaction joins that fail on what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fail(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def first_by_key(source: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in ``order``: duplicates are allowed and the earliest wins.

    Partial aggregates keep one row of a key before the shuffle, however often it occurs.
    """
    rest = [c for c in source.columns if c not in key]
    found = source.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return found.select(*[F.col(c) if c in key else F.col("_first")[c].alias(c) for c in source.columns])


def unique_by_key(source: DataFrame, key: list[str]) -> DataFrame:
    """``source``; a key that occurs twice raises when rows are read."""
    rest = [c for c in source.columns if c not in key]
    held = F.struct(*rest)
    found = source.groupBy(*key).agg(F.any_value(held).alias("_only"), F.count(F.lit(1)).alias("_rows"))
    kind = found.schema["_only"].dataType.simpleString()
    only = F.when(F.col("_rows") > 1, _fail("a key occurs twice", kind)).otherwise(F.col("_only"))
    checked = found.select(*key, only.alias("_only"))
    return checked.select(*[F.col(c) if c in key else F.col("_only")[c].alias(c) for c in source.columns])


def gather(
    target: DataFrame, source: DataFrame, key: list[str], columns: list[str], default: dict | None = None, order: str | None = None
) -> DataFrame:
    """Adds ``columns`` of ``source`` by ``key``; a missing key raises, or takes ``default``.

    Never more or fewer rows than ``target`` has: with ``order`` the first of a key's rows in the source
    counts (J1), without it a key that occurs twice there raises (J2).
    Spark broadcasts the source if it is small by its own threshold and shuffles on the key otherwise.
    """
    slim = source.select(*dict.fromkeys([*key, *columns, *([order] if order else [])]))
    held = first_by_key(slim, key, order) if order else unique_by_key(slim, key)
    held = held.select(*key, F.struct(*columns).alias("_found"))
    joined = target.join(held, key, "left")
    if default is None:
        kind = held.schema["_found"].dataType.simpleString()
        found = F.when(F.col("_found").isNull(), _fail("a key is missing", kind)).otherwise(F.col("_found"))
        values = [found[c].alias(c) for c in columns]
    else:
        values = [F.coalesce(F.col("_found")[c], F.lit(default[c])).alias(c) for c in columns]
    return joined.select(*target.columns, *values)


def interaction(alternatives: DataFrame, choosers: DataFrame, key: str, suffix: str = "_chooser") -> DataFrame:
    """Each chooser's own alternatives with the chooser's columns, suffixed where names clash."""
    clash = (set(choosers.columns) & set(alternatives.columns)) - {key}
    renamed = choosers.select(*[F.col(c).alias(c + suffix) if c in clash else F.col(c) for c in choosers.columns])
    return alternatives.join(renamed, key)


def offsets(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first, count): where each chooser's rows lie when all are sorted by key."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    bucketed = counts.withColumn("_bucket", F.floor(F.col(key) / 65536))
    sums = bucketed.groupBy("_bucket").agg(F.sum("count").alias("_sum"))
    base = sums.select("_bucket", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = before.partitionBy("_bucket")
    joined = bucketed.join(base, "_bucket")
    first = F.col("_base") + F.coalesce(F.sum("count").over(within), F.lit(0))
    return joined.select(key, first.alias("first"), "count")


def scattered(rows: DataFrame, key: str, slot: str, value: str, slots: int = 25) -> DataFrame:
    """An array of values by slot for each key; values of one slot that differ raise."""
    each = rows.groupBy(key, slot).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    agreed = F.when(F.col("low") != F.col("high"), _fail("a slot has two values", "double")).otherwise(F.col("low"))
    pairs = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(slot, agreed.alias("v")))).alias("_m"))
    values = F.array(*[F.element_at("_m", F.lit(i).cast("int")) for i in range(slots)])
    return pairs.select(key, values.alias("slots"))


def legs(sample: DataFrame, trips: DataFrame, trip: str = "trip_id") -> DataFrame:
    """Both directed legs of each sampled destination: origin to it, and it to the primary destination.

    Trips grow as the sample does, and are shuffled whatever size Spark takes their files for.
    """
    joined = interaction(sample, trips.hint("merge"), trip, "_r")
    out = joined.select(*joined.columns, F.lit("od").alias("direction"), F.col("origin").alias("leg_orig"), F.col("dest").alias("leg_dest"))
    back = joined.select(*joined.columns, F.lit("dp").alias("direction"), F.col("dest").alias("leg_orig"), F.col("primary_dest").alias("leg_dest"))
    return out.unionByName(back)
