"""Dense matrix cubes: one row for each origin, read by position under a byte budget."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What joins a matrix's name and its period in the names of stored matrices (a fixed value).
JOINT = "__"
#: Bytes of a cell in memory.
CELL = 4
BLOCKS = "matrix string, orig int, cells array<float>"


@dataclass(frozen=True)
class Cube:
    """``rows`` (o, and an array of cells for each matrix), ``zones`` (zone, at), and what a lookup needs to know.

    A matrix without periods holds a cell for each destination, one with periods a cell for each destination and period.
    """

    rows: DataFrame
    zones: DataFrame
    count: int
    ranks: dict[str, int]
    periods: tuple[str, ...]
    bytes: int

    def positions(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Adds ``_at_<column>``, the place of each column's zone: -1 for zone -1, and an error for one that the cube lacks."""
        for c in columns:
            named = F.broadcast(self.zones.select(F.col("zone").alias(f"_zone_{c}"), F.col("at").alias(f"_at_{c}")))
            rows = rows.join(named, F.col(c) == F.col(f"_zone_{c}"), "left").drop(f"_zone_{c}")
            lost = F.raise_error(F.concat(F.lit("the cube has no zone "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("int")
            rows = rows.withColumn(f"_at_{c}", F.when(F.col(c) == -1, -1).when(F.col(f"_at_{c}").isNull(), lost).otherwise(F.col(f"_at_{c}")))
        return rows

    def lookup(self, df: DataFrame, reads: dict[str, tuple[str, str, str, str | None]]) -> DataFrame:
        """Adds a double for each name in ``reads``: (matrix, origin column, destination column, period column or none).

        Reads that share their first column share a join, however many matrices and periods they go to.  The cube is
        broadcast, as its size is known and within the budget; a cell is taken out of its row by position, so no row of
        the cube is copied.  Periods are positions among the cube's; one outside raises.  Zone -1 reads NaN.
        """
        for key, _, _, period in reads.values():
            if key not in self.ranks:
                raise KeyError(f"{key} was not loaded")
            if (period is None) != (self.ranks[key] == 2):
                raise ValueError(f"{key} has rank {self.ranks[key]}")
        held = self.positions(df, sorted({c for _, a, b, _ in reads.values() for c in (a, b)}))
        for first in sorted({a for _, a, _, _ in reads.values()}):
            own = {name: read for name, read in reads.items() if read[1] == first}
            keys = sorted({key for key, _, _, _ in own.values()})
            side = F.broadcast(self.rows.select(F.col("o").alias("_o"), *[F.col(k).alias(f"_m_{k}") for k in keys]))
            joined = held.join(side, F.col(f"_at_{first}") == F.col("_o"), "left")
            values = [self._cell(key, first, second, period).alias(name) for name, (key, _, second, period) in own.items()]
            held = joined.select(*held.columns, *values)
        return held.select(*df.columns, *reads)

    def _cell(self, key: str, first: str, second: str, period: str | None) -> Column:
        place = F.col(f"_at_{second}")
        if period is not None:
            inside = F.coalesce(F.col(period).between(0, len(self.periods) - 1), F.lit(False))
            at = F.when(inside, F.col(period)).otherwise(F.raise_error(F.lit("the cube has no such period")).cast("int"))
            place = place * len(self.periods) + at
        outside = (F.col(f"_at_{first}") == -1) | (F.col(f"_at_{second}") == -1)
        return F.when(outside, float("nan")).otherwise(F.get(f"_m_{key}", place.cast("int")).cast("double"))


def matrix_files(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    """Blocks (matrix, orig, cells) of the square matrices in a folder's ``.npy`` files, named after them: one row for each origin.

    Files are read by Spark's reader and only those of ``keys`` are opened; cells become single precision.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    files = files.withColumn("matrix", F.regexp_extract("path", r"([^/]+)\.npy$", 1))
    if keys is not None:
        files = files.where(F.col("matrix").isin(keys))
    return files.select("matrix", "content").mapInArrow(_blocks, BLOCKS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch["matrix"].to_pylist(), batch["content"], strict=True):
            x = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
            if x.ndim != 2 or x.shape[0] != x.shape[1]:
                raise ValueError(f"matrix {name} is not square")
            step = max(1, (1 << 20) // max(1, x.shape[1]))
            for a in range(0, len(x), step):
                part = x[a : a + step].astype(np.float32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part), dtype=np.int32)), cells], names=["matrix", "orig", "cells"])


def long_blocks(table: DataFrame, zones: DataFrame, keys: list[str], period: str | None = None, periods: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of the matrices ``keys`` of a long table (orig, dest[, period]) of zone numbers; a period is a position among ``periods``.

    A pair that the table lacks leaves its row short, which ``load_cube`` refuses; zones outside ``zones`` are left out.
    """
    at = [F.broadcast(zones.select(F.col("zone").alias(c), F.col("at").alias(f"_{c}"))) for c in ("orig", "dest")]
    held = table.join(at[0], "orig").join(at[1], "dest")
    name = F.lit("") if period is None else F.concat(F.lit(JOINT), F.element_at(F.array(*map(F.lit, periods)), (F.col(period) + 1).cast("int")))
    each = F.inline(F.array(*[F.struct(F.concat(F.lit(k), name).alias("matrix"), F.col(k).cast("float").alias("cell")) for k in keys]))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("_dest", "cell"))), lambda x: x["cell"])
    return held.select(F.col("_orig").alias("orig"), "_dest", each).groupBy("matrix", "orig").agg(cells.alias("cells"))


def zone_map(zones: DataFrame, column: str = "zone") -> DataFrame:
    """(zone, at): places from 0 in order of zone numbers; a repeated or null number raises.  Zones are few: their number is the side of a matrix."""
    numbers = [r[0] for r in zones.select(column).orderBy(column).collect()]
    if None in numbers or len(set(numbers)) != len(numbers):
        raise ValueError("zones must be numbered, each once")
    return zones.sparkSession.createDataFrame([(n, i) for i, n in enumerate(numbers)], "zone long, at int")


def load_cube(blocks: DataFrame, zones: DataFrame, keys: dict[str, int], budget: int, periods: tuple[str, ...] = ()) -> Cube:
    """The matrices of ``keys`` (name: rank 2, or 3 for one with periods) from blocks (matrix, orig, cells).

    Only these are read; one with periods is the matrices ``KEY__PERIOD``.  Raises MemoryError before anything is loaded if
    all cells, at four bytes, exceed ``budget``; KeyError if a matrix is missing; ValueError if one is not
    a full square over the zones.
    """
    count = zones.count()
    layers = {key: [key] if rank == 2 else [f"{key}{JOINT}{p}" for p in periods] for key, rank in keys.items()}
    size = CELL * count * count * sum(map(len, layers.values()))
    if size > budget:
        raise MemoryError(f"the matrices take {size} bytes of {budget}")
    names = [n for own in layers.values() for n in own]
    wanted = blocks.where(F.col("matrix").isin(names))
    full = F.count_if((F.size("cells") == count) & F.col("orig").between(0, count - 1))
    state = {r["matrix"]: r for r in wanted.groupBy("matrix").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("orig").alias("origins"), full.alias("full")).collect()}
    missing = sorted(set(names) - set(state))
    if missing and count:
        raise KeyError(f"no matrix {missing[:5]}")
    for name, r in state.items():
        if not r["rows"] == r["origins"] == r["full"] == count:
            raise ValueError(f"matrix {name} is not a full square over {count} zones")
    wide = wanted.groupBy("orig").pivot("matrix", names).agg(F.first("cells"))

    def cells(key: str) -> Column:
        own = [F.col(f"`{n}`") for n in layers[key]]
        if keys[key] == 2:
            return own[0].alias(key)
        # destination by destination, its periods side by side
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda d: F.array(*[F.get(x, d) for x in own]))).alias(key)

    return Cube(wide.select(F.col("orig").alias("o"), *[cells(k) for k in keys]), zones, count, dict(keys), tuple(periods), size)
