"""Tour scheduling in batches: each batch sees the timetable that the batches before have left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators import timetable
from wayfare.operators.choice import choose_long


def schedule_batches(
    tours: DataFrame, prints: timetable.Footprints, utility: Callable[[DataFrame], DataFrame], batches: list[int], keep: Callable[[DataFrame, str], DataFrame]
) -> DataFrame:
    """(tour_id, person_id, tour_num, tdd, logsum) of all tours: T5, T12.

    ``tours`` has person_id, tour_id, tour_num and z, its draw.  Batch n takes each person's n-th tour, joins it
    with the tours that fit what the person has so far, and chooses by ``utility`` (which adds the column
    of that name).  ``keep`` writes a batch's result, as every later batch reads it; the loop is over the few
    numbers that a tour may have, not over rows.
    """
    spark = tours.sparkSession
    alternatives = prints.table(spark)
    done: DataFrame | None = None
    for number in batches:
        own = tours.where(F.col("tour_num") == number)
        masks = [F.lit(0).alias(f"w_{m}") for m in timetable.MASKS]
        if done is None:
            held = own.select("*", *masks)
        else:
            taken = timetable.windows(done, alternatives)
            joined = own.join(taken, "person_id", "left")
            held = joined.select(*own.columns, *[F.coalesce(f"w_{m}", F.lit(0)).alias(f"w_{m}") for m in timetable.MASKS])
        rows = timetable.vocabulary(timetable.feasible(held, alternatives), prints.first, prints.width)
        found = choose_long(utility(rows), "tour_id", "tdd", "utility", "z")
        chosen = own.join(found, "tour_id").select("tour_id", "person_id", "tour_num", F.col("choice").alias("tdd"), "logsum")
        chosen = keep(chosen, f"batch-{number}")
        done = chosen if done is None else done.unionByName(chosen)
    return done
