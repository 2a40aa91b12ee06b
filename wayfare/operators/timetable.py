"""Timetables: the periods that a person's tours take, as integers with a bit for each period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.ieee import period_slot

#: States of a period (fixed values): empty, a tour starts, ends, starts and ends, goes on.
EMPTY, START, END, BOTH, MIDDLE = 0, 2, 4, 6, 7
MASKS = ("m2", "m4", "m6", "m7")


@dataclass(frozen=True)
class Footprints:
    """Tour alternatives (start, end) and the frame of periods that holds them, one spare at each side."""

    spans: tuple[tuple[int, int], ...]

    def __post_init__(self):
        if any(end < start for start, end in self.spans):
            raise ValueError("a tour ends before it starts")

    @property
    def first(self) -> int:
        return min(s for s, _ in self.spans) - 1

    @property
    def width(self) -> int:
        return max(e for _, e in self.spans) - self.first + 2

    def states(self, tour: int) -> list[int]:
        start, end = (x - self.first for x in self.spans[tour])
        inside = {start: START, end: END} if start < end else {start: BOTH}
        return [inside.get(i, MIDDLE if start < i < end else EMPTY) for i in range(self.width)]

    def table(self, spark: SparkSession) -> DataFrame:
        """(tdd, start, end, duration, m2, m4, m6, m7): a small table, for joins."""
        rows = []
        for i, (start, end) in enumerate(self.spans):
            masks = encoded(self.states(i))
            rows.append((i, start, end, end - start, *masks))
        return spark.createDataFrame(rows, "tdd int, start int, end int, duration int, m2 int, m4 int, m6 int, m7 int")


def encoded(states: list[int]) -> tuple[int, int, int, int]:
    """A state for each period as four masks."""
    return tuple(sum(1 << i for i, s in enumerate(states) if s == kind) for kind in (START, END, BOTH, MIDDLE))


def hourly(first: int = 5, last: int = 23) -> Footprints:
    """All (start, end) pairs of hours: 190 for 5 to 23."""
    return Footprints(tuple((s, e) for s in range(first, last + 1) for e in range(s, last + 1)))


def collides(tour: str = "", window: str = "w_") -> Column:
    """Whether a tour's masks meet a window's."""

    def both(a: str, *bs: str) -> Column:
        held = F.col(window + bs[0])
        for b in bs[1:]:
            held = held.bitwiseOR(F.col(window + b))
        return F.col(tour + a).bitwiseAND(held)

    hits = both("m2", "m2", "m7").bitwiseOR(both("m4", "m4", "m7")).bitwiseOR(both("m6", "m7"))
    return hits.bitwiseOR(both("m7", "m2", "m4", "m6", "m7")) != 0


def windows(tours: DataFrame, alternatives: DataFrame, person: str = "person_id", tdd: str = "tdd") -> DataFrame:
    """(person, w_m2, w_m4, w_m6, w_m7) from each person's scheduled tours, by bitwise or of states (T4)."""
    held = tours.join(F.broadcast(alternatives.select("tdd", *MASKS).withColumnRenamed("tdd", tdd)), tdd)
    # a state is three bits: 2 = 010, 4 = 100, 6 = 110, 7 = 111
    starts = F.bit_or(F.col("m2").bitwiseOR(F.col("m6")).bitwiseOR(F.col("m7"))).alias("s")
    ends = F.bit_or(F.col("m4").bitwiseOR(F.col("m6")).bitwiseOR(F.col("m7"))).alias("e")
    middles = F.bit_or("m7").alias("m")
    bits = held.groupBy(person).agg(starts, ends, middles)
    no = F.bitwise_not
    return bits.select(
        person,
        F.col("s").bitwiseAND(no("e")).alias("w_m2"),
        F.col("e").bitwiseAND(no("s")).alias("w_m4"),
        F.col("s").bitwiseAND(F.col("e")).bitwiseAND(no("m")).alias("w_m6"),
        F.col("m").alias("w_m7"),
    )


def feasible(choosers: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Chooser rows (with w_ masks) by every tour that does not collide: an anti-join on overlap.

    The alternatives are a fixed small table (190 for hours), so the join is broadcast.
    """
    return choosers.crossJoin(F.broadcast(alternatives)).where(~collides())


def vocabulary(rows: DataFrame, first: int, width: int) -> DataFrame:
    """Adds what utilities ask of a timetable for a (start, end) alternative.

    previous_ends, previous_begins: another tour ends where this one starts, or starts where it ends;
    adjacent_before, adjacent_after: the neighbouring period exists and is not in the middle of a tour;
    remaining: periods left when this one's middle is taken.
    """
    start, end = F.col("start") - first, F.col("end") - first

    def bit(mask: Column, at: Column) -> Column:
        return F.call_function("shiftright", mask, at.cast("int")).bitwiseAND(F.lit(1)) == 1

    ends = F.col("w_m4").bitwiseOR(F.col("w_m6"))
    begins = F.col("w_m2").bitwiseOR(F.col("w_m6"))
    inner = sum(1 << i for i in range(1, width - 1))
    free = F.lit(width - 2) - F.bit_count(F.col("w_m7").bitwiseAND(F.lit(inner)))
    return (
        rows.withColumn("previous_ends", bit(ends, start))
        .withColumn("previous_begins", bit(begins, end))
        .withColumn("adjacent_before", (start > 1) & ~bit(F.col("w_m7"), F.greatest(start - 1, F.lit(0))))
        .withColumn("adjacent_after", (end < width - 2) & ~bit(F.col("w_m7"), end + 1))
        .withColumn("remaining", free - F.greatest(F.col("end") - F.col("start") - 1, F.lit(0)))
    )


def free_runs(window: Column, at: Column, width: int, before: bool) -> Column:
    """How many periods in a row before (after) a period are not in the middle of a tour."""
    places = F.sequence(at - 1, F.lit(1), F.lit(-1)) if before else F.sequence(at + 1, F.lit(width - 2))
    usable = F.when(at > 1 if before else at < width - 2, places).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("n"))

    def step(a: Column, i: Column) -> Column:
        taken = F.call_function("shiftright", window, i).bitwiseAND(F.lit(1)) == 1
        going = a["open"] & ~taken
        return F.struct(going.alias("open"), (a["n"] + going.cast("int")).alias("n"))

    return F.aggregate(usable, start, step, lambda a: a["n"])


def first_by_slot(rows: DataFrame, chooser: str) -> DataFrame:
    """(chooser, slot, first tdd, count) over feasible rows: the representative of each pair of periods."""
    slotted = rows.withColumn("slot", period_slot(F.col("start"), F.col("end")))
    return slotted.groupBy(chooser, "slot").agg(F.min("tdd").alias("first_tdd"), F.count(F.lit(1)).cast("int").alias("feasible"))
