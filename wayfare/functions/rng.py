"""Keyed random draws: the same whatever the partitioning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import twister
from wayfare.functions.ieee import name_hash

#: Multipliers of the counter generator and of its key (fixed values).
SEED_STEP, STREAM_STEP = 0xD2B74407B1CE6E93, 0xCA5A826395121157
GAMMA, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
WORD = (1 << 64) - 1


def counter_uniforms(ids: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """A uniform in single precision for each id: 24 high bits of SplitMix64 of id, seed and stream.

    The largest value rounds to 1; it is held below, as draws must be.
    """
    key = np.uint64((seed * SEED_STEP) & WORD) ^ np.uint64((stream * STREAM_STEP) & WORD)
    z = (np.asarray(ids).astype(np.int64).view(np.uint64) ^ key) + np.uint64(GAMMA)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
    z = z ^ (z >> np.uint64(31))
    u = ((z >> np.uint64(40)).astype(np.float64) + 0.5) * 2.0**-24
    return np.minimum(u.astype(np.float32), np.nextafter(np.float32(1), np.float32(0)))


LOW = (1 << 32) - 1


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _wrapped_sum(terms: list[Column]) -> Column:
    """The sum of longs modulo 2**64, by halves, which no addition overflows."""
    low = sum((t.bitwiseAND(LOW) for t in terms[1:]), terms[0].bitwiseAND(LOW))
    high = sum((F.shiftrightunsigned(t, 32) for t in terms[1:]), F.shiftrightunsigned(terms[0], 32))
    return F.shiftleft(high + F.shiftrightunsigned(low, 32), 32).bitwiseOR(low.bitwiseAND(LOW))


def _wrapped_product(x: Column, by: int) -> Column:
    """``x * by`` modulo 2**64: halves of x times quarters of ``by`` stay below 2**48."""
    low, high = x.bitwiseAND(LOW), F.shiftrightunsigned(x, 32)
    parts = [F.lit(by >> 16 * i & 0xFFFF).cast("long") for i in range(4)]
    terms = [F.shiftleft(low * p, 16 * i) for i, p in enumerate(parts)]
    return _bound(F.array(*terms, F.shiftleft(high * parts[0], 32), F.shiftleft(high * parts[1], 48)), lambda t: _wrapped_sum([t[i] for i in range(6)]))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(x: Column, by: int) -> Column:
    return _bound(x, lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, by)))


def entity_uniform(entity: Column, seed: int, stream: int) -> Column:
    """R1 as a column: ``counter_uniforms`` in the JVM, with wrapping products in parts."""
    key = _signed((seed * SEED_STEP) & WORD ^ (stream * STREAM_STEP) & WORD)
    z = _wrapped_sum([entity.cast("long").bitwiseXOR(F.lit(key)), F.lit(_signed(GAMMA))])
    z = _bound(_folded(z, 30), lambda x: _wrapped_product(x, MIX1))
    z = _bound(_folded(z, 27), lambda x: _wrapped_product(x, MIX2))
    u = (F.shiftrightunsigned(_folded(z, 31), 40) + 0.5) * 2.0**-24
    return F.least(u.cast("float"), F.lit(float(np.nextafter(np.float32(1), np.float32(0)))).cast("float"))


def row_seed(entity: Column, base: int, channel: str, step: str) -> Column:
    """Seed of an entity in a channel and step, modulo 2**32 (R2)."""
    return (entity.cast("long") + base + name_hash(F.lit(channel)) + name_hash(F.lit(step))) % F.lit(1 << 32)


def seeded_uniforms(seed: Column, offset: Column, count: int) -> Column:
    """``count`` draws of each row's Mersenne Twister after skipping ``offset``."""

    return _drawn(twister.uniforms, seed, offset, count)


def seeded_normals(seed: Column, offset: Column, count: int) -> Column:
    """``count`` standard normals after skipping ``offset`` uniforms."""

    return _drawn(twister.normals, seed, offset, count)


def _drawn(draw: Callable[[np.ndarray, np.ndarray, int], np.ndarray], seed: Column, offset: Column, count: int) -> Column:
    """Draws for Arrow batches of rows; a fold over the state in the JVM takes some 100 times as long a row."""

    @F.pandas_udf("array<double>")
    def drawn(seeds: pd.Series, offsets: pd.Series) -> pd.Series:
        return pd.Series(list(draw(seeds.to_numpy().astype(np.uint32), offsets.to_numpy().astype(np.int64), count)))

    return drawn(seed, offset)


@dataclass(frozen=True)
class Ledger:
    """Seeds and how far each entity's stream has been used: columns seed and rng_offset.

    A reservation returns the rows with their draws and a ledger that is further on; the old one
    stays as it was, which is a snapshot.
    """

    rows: DataFrame
    entity: str

    @staticmethod
    def start(entities: DataFrame, entity: str, base: int, channel: str, step: str) -> Ledger:
        seed = row_seed(F.col(entity), base, channel, step)
        return Ledger(entities.select(entity, seed.alias("seed"), F.lit(0).alias("rng_offset")), entity)

    def reserve(self, count: int, only: DataFrame | None = None) -> tuple[DataFrame, Ledger]:
        rows = self.rows
        taking = F.lit(True)
        if only is not None:
            marked = only.select(self.entity).distinct().withColumn("_takes", F.lit(True))
            rows = rows.join(marked, self.entity, "left")
            taking = F.coalesce("_takes", F.lit(False))
        drawn = rows.where(taking).select(self.entity, seeded_uniforms(F.col("seed"), F.col("rng_offset"), count).alias("draws"))
        moved = F.when(taking, F.col("rng_offset") + count).otherwise(F.col("rng_offset"))
        return drawn, Ledger(rows.select(self.entity, "seed", moved.alias("rng_offset")), self.entity)
