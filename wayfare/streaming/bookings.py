"""Extension: a timetable kept by a stream of tours (the studied project is batch only)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfare.functions.ieee import period_of


def periods_by_window(events: DataFrame, time: str = "ts", late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Counts by window and skim period of the hour; rows later than ``late`` are dropped."""
    held = events.withWatermark(time, late).withColumn("period", period_of(F.hour(time)))
    return held.groupBy(F.window(time, length), "period").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def booked(tours: DataFrame) -> DataFrame:
    """Accepts each person's tours in order of arrival where their periods are free.

    A person's periods are one integer of state.  Rows: person_id, tour_id, accepted.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = state.get[0] if state.exists else 0
        for batch in batches:
            accepted = []
            for start, end in zip(batch["start"], batch["end"], strict=True):
                mask = sum(1 << i for i in range(int(start), int(end) + 1))
                free = taken & mask == 0
                accepted.append(free)
                taken |= mask if free else 0
            yield pd.DataFrame({"person_id": key[0], "tour_id": batch["tour_id"], "accepted": accepted})
        state.update((taken,))

    return tours.groupBy("person_id").applyInPandasWithState(
        run, "person_id long, tour_id long, accepted boolean", "taken long", "append", GroupStateTimeout.NoTimeout
    )
