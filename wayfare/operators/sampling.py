"""Destination sampling with replacement, duplicates and the final choice among samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import ieee
from wayfare.operators.choice import choose_long, first_reaching

FAINT = 1e-30


def inverse_cdf(probs: Column, draw: Column) -> Column:
    """First position whose running probability is above the draw; the last that is not faint if none is."""
    hit = first_reaching(probs, draw, strict=True)
    solid = F.transform(probs, lambda p, i: F.when(p >= FAINT, i).otherwise(0))
    return F.when(hit >= 0, hit).otherwise(F.array_max(solid))


def draws_taken(df: DataFrame, probs: str, draws: str) -> DataFrame:
    """A row for each draw of each chooser, in draw order: draw_no, rand, choice, prob (array form of A24)."""
    each = df.select("*", F.posexplode(draws).alias("draw_no", "rand"))
    each = each.withColumn("choice", inverse_cdf(F.col(probs), F.col("rand")))
    return each.withColumn("prob", F.element_at(F.col(probs), F.col("choice") + 1).cast("float"))


def sample_long(rows: DataFrame, draws: DataFrame, chooser: str, position: str, prob: str) -> DataFrame:
    """The same for many alternatives: (chooser, position, prob) rows and (chooser, draw_no, rand) draws.

    Running sums bound an interval for each alternative, [low, high); a draw takes the one that holds
    it.  The last alternative that is not faint reaches to 1, and faint ones after it to nothing.
    Draws are always shuffled: exploded from a small table, Spark takes them for as small as that and would broadcast them.
    """
    own = Window.partitionBy(chooser)
    upto = own.orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("_high", F.sum(F.col(prob).cast("double")).over(upto))
    last = F.max(F.when(F.col(prob) >= FAINT, F.col(position))).over(own)
    held = held.withColumn("_low", F.col("_high") - F.col(prob).cast("double")).withColumn("_last", last)
    held = held.withColumn("_low", F.coalesce(F.lag("_high").over(own.orderBy(position)), F.lit(0.0)))
    high = F.when(F.col(position) == F.col("_last"), F.greatest(F.col("_high"), F.lit(1.0))).otherwise(F.col("_high"))
    held = held.withColumn("_high", high).where((F.col(position) <= F.col("_last")) & (F.col("_high") > F.col("_low")))
    inside = (F.col("rand") >= F.col("_low")) & (F.col("rand") < F.col("_high"))
    return held.join(draws.hint("merge"), chooser).where(inside).select(chooser, "draw_no", "rand", F.col(position).alias("choice"), F.col(prob).cast("float").alias("prob"))


def collapsed(taken: DataFrame, chooser: str) -> DataFrame:
    """One row for each chooser and alternative: the first draw's rand, prob, and the number of picks."""
    return taken.groupBy(chooser, "choice").agg(
        F.min_by("rand", "draw_no").alias("rand"), F.min_by("prob", "draw_no").alias("prob"), F.count(F.lit(1)).cast("int").alias("pick_count")
    )


def softmax_rows(rows: DataFrame, chooser: str, utility: str) -> DataFrame:
    """Adds prob without overflow protection; choosers whose weights add up to nothing are dropped."""
    own = Window.partitionBy(chooser)
    held = rows.withColumn("_w", F.exp(utility)).withColumn("_total", F.sum("_w").over(own))
    return held.where("_total > 0").withColumn("prob", (F.col("_w") / F.col("_total")).cast("float")).drop("_w", "_total")


def final_choice(sample: DataFrame, chooser: str, utility: str, draw: str, missing: int | None = None) -> DataFrame:
    """The choice among a chooser's sampled alternatives, corrected for how they were sampled.

    Utilities get ln(pick_count / prob), 60 at most.  ``missing`` replaces the choice of choosers
    none of whose alternatives has weight.
    """
    corrected = sample.withColumn("_utility", F.col(utility) + ieee.sampling_correction(F.col("pick_count"), F.col("prob")))
    found = choose_long(corrected, chooser, "choice", "_utility", draw)
    if missing is not None:
        found = found.withColumn("choice", F.when(F.col("choice") == -1, missing).otherwise(F.col("choice")))
    return found.drop("boundary_distance")
