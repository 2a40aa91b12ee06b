"""Tables kept by ranges of households, so that stages on households need no exchange."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files that a table has at least and at most; each holds whole ranges.
FEWEST, MOST = 8, 4096


def household_ranges(total: int, most: int) -> list[tuple[int, int]]:
    """Half-open ranges that cover 0 to ``total`` in order, of at most ``most`` households each and as equal as can be."""
    if most <= 0 or total < 0:
        raise ValueError("a range must hold something, and households cannot be fewer than none")
    count = -(-total // most)
    cuts = [total * i // count for i in range(count + 1)] if count else []
    return list(zip(cuts, cuts[1:], strict=False))


def range_of(household: Column, total: int, most: int) -> Column:
    """The number of a household's range; null outside 0 to ``total``."""
    count = max(1, -(-total // most))
    # the last range that begins at or before the household: begins are floor(total * i / count)
    number = F.floor(((household.cast("long") + 1) * count - 1) / F.lit(max(1, total))).cast("int")
    return F.when(household.between(0, total - 1), number)


@dataclass(frozen=True)
class Ranged:
    """Tables of households (``key``), each bucketed by its column ``part``, the number of a household's range."""

    key: str
    total: int
    most: int
    files: int

    @staticmethod
    def of(households: DataFrame, key: str, most: int) -> Ranged:
        """Ranges for the households of a table, whose ids are integers from 0."""
        # rows that lie together by range do so by (range, household); the setting stays, as plans run later
        households.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        low, high = households.agg(F.min(key), F.max(key)).first()
        if low is not None and low < 0:
            raise ValueError("household ids are numbers from 0")
        total = 0 if high is None else high + 1
        return Ranged(key, total, most, min(MOST, max(FEWEST, -(-total // most))))

    def write(self, df: DataFrame, name: str, place: str) -> DataFrame:
        """``df`` as a table of whole ranges in ``place``, each file sorted by household.

        The one exchange is here.  A household outside the ranges raises, so that no row is lost.  Returns the table as
        it is read back: grouped or joined by (part, ``key``), or by windows over them, it is not exchanged again.
        """
        outside = F.raise_error(F.concat(F.lit("no range holds household "), F.coalesce(F.col(self.key).cast("string"), F.lit("null")))).cast("int")
        held = df.withColumn("part", F.coalesce(range_of(F.col(self.key), self.total, self.most), outside))
        table = f"{name}_{uuid.uuid4().hex}"
        writer = held.repartition(self.files, "part").write.bucketBy(self.files, "part").sortBy("part", self.key)
        writer.option("path", f"{place.rstrip('/')}/{name}").saveAsTable(table)
        return df.sparkSession.table(table)

    def window(self) -> Window:
        return Window.partitionBy("part", self.key)

    def sizes(self, table: DataFrame) -> DataFrame:
        """(part, start, stop, rows) of all ranges of a table, empty ones too: what a range that is too large to hold shows by."""
        ranges = table.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(household_ranges(self.total, self.most))], "part int, start long, stop long")
        counts = table.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
        return ranges.join(counts, "part", "left").na.fill(0, ["rows"])
