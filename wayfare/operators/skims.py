"""Origin-destination matrices as long tables: a row for each pair (and period), a column for each matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How an accessor reads a matrix: (swap origin and destination, period column or none).
ACCESSORS = {
    "od_skims": (False, None),
    "odt_skims": (False, "out_period"),
    "dot_skims": (True, "in_period"),
    "odr_skims": (False, "in_period"),
    "dor_skims": (True, "out_period"),
}


def needed(skim_table: DataFrame, keys: list[str], period: bool) -> DataFrame:
    """Only the matrices that are read; the scan then reads only their columns."""
    return skim_table.select("orig", "dest", *(["period"] if period else []), *keys)


def lookup(
    df: DataFrame, skim_table: DataFrame, keys: list[str], orig: str, dest: str, period: str | None = None, prefix: str = ""
) -> DataFrame:
    """Adds matrix values of (orig, dest[, period]): J4-J6.

    Zone -1 reads NaN; another zone or period that the table lacks raises.
    """
    held = needed(skim_table, keys, period is not None)
    names = {"orig": "_o", "dest": "_d"} | ({"period": "_p"} if period else {})
    for old, new in names.items():
        held = held.withColumnRenamed(old, new)
    held = held.select(*names.values(), F.struct(*keys).alias("_m"))
    on = (F.col(orig) == F.col("_o")) & (F.col(dest) == F.col("_d"))
    if period:
        on = on & (F.col(period) == F.col("_p"))
    joined = df.join(held, on, "left")
    outside = (F.col(orig) == -1) | (F.col(dest) == -1)
    kind = held.schema["_m"].dataType.simpleString()
    found = F.when(F.col("_m").isNull() & ~outside, F.raise_error(F.lit("zone or period is not in the matrix")).cast(kind)).otherwise(F.col("_m"))
    values = [F.when(outside, float("nan")).otherwise(found[k].cast("double")).alias(prefix + k) for k in keys]
    return joined.select(*df.columns, *values)


def bind(df: DataFrame, cube: DataFrame, reads: list[tuple[str, str, str]], orig: str = "orig", dest: str = "dest") -> tuple[DataFrame, dict]:
    """Joins a cube once for each way that ``reads`` (accessor, key, plain | reverse | max) goes through it.

    Returns the rows and the Column of each (accessor, key, way), for an expression compiler.
    """
    wanted: dict[tuple[bool, str | None], set[str]] = {}
    for accessor, key, way in reads:
        swap, period = ACCESSORS[accessor]
        for turned in {"plain": [swap], "reverse": [not swap], "max": [swap, not swap]}[way]:
            wanted.setdefault((turned, period), set()).add(key)
    for (swap, period), keys in sorted(wanted.items(), key=str):
        ends = (dest, orig) if swap else (orig, dest)
        table = cube if period else cube.where(F.col("period") == F.lit(0))
        df = lookup(df, table, sorted(keys), *ends, period, prefix=f"_{'do' if swap else 'od'}_{period or 'any'}_")
    columns: dict[tuple[str, str, str], Column] = {}
    for accessor, key, _ in reads:
        swap, period = ACCESSORS[accessor]
        for way, turned in (("plain", swap), ("reverse", not swap)):
            if key in wanted.get((turned, period), ()):
                columns[accessor, key, way] = F.col(f"_{'do' if turned else 'od'}_{period or 'any'}_{key}")
    return df, columns


def destinations(choosers: DataFrame, skim_table: DataFrame, orig: str, keys: list[str], position: str = "alt_pos") -> DataFrame:
    """Every destination that the matrix has from each chooser's origin: an equi-join on the origin, no
    product of all pairs (J8)."""
    held = skim_table.select(F.col("orig").alias(orig), F.col("dest").alias(position), *keys)
    return choosers.join(held, orig)


def two_legs(choosers: DataFrame, skim_table: DataFrame, orig: str, primary: str, keys: list[str]) -> DataFrame:
    """Destinations with both legs: from the origin to them and from them to the primary destination."""
    first = destinations(choosers, skim_table.select("orig", "dest", *[F.col(k).alias(f"od_{k}") for k in keys]), orig, [f"od_{k}" for k in keys])
    second = skim_table.select(F.col("orig").alias("alt_pos"), F.col("dest").alias(primary), *[F.col(k).alias(f"dp_{k}") for k in keys])
    return first.join(second, ["alt_pos", primary])
