"""Sampling from utilities known within bounds, evaluated again only where the bounds leave a choice open."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import ieee

#: Half a unit in the last place of single precision, relative.
SINGLE = 2.0**-24


def single_bound(products: list[Column]) -> Column:
    """How far a single-precision sum of single-precision products, taken in order, may be from the exact sum.

    Each factor, product and sum is rounded once, so that a product passes through len + 2 roundings at most.
    """
    size = reduce(lambda a, p: a + F.abs(p.cast("double")), products, F.lit(0.0))
    n = (len(products) + 2) * SINGLE
    return size * (n / (1 - n))


def proven(rows: DataFrame, draws: DataFrame, chooser: str, position: str, utility: str, bound: str | None = None) -> DataFrame:
    """(chooser, draw_no, rand, choice, prob, proven): alternatives whose running share first exceeds each draw.

    ``proven`` choices stay the same whatever the utilities within ``bound`` of those given: the running share up to the choice
    exceeds the draw with all weights before and at it as low, and all after it as high, as they can be, and the share before
    it stays at or below the draw the other way round.  Utilities that are not finite are unavailable.  A draw that
    no share exceeds takes the last alternative with weight, unproven.  Choosers without one get no rows.

    One shuffle of the alternatives, on the chooser; a chooser's draws are one array beside each of them, of which a row
    keeps those that fall to it.
    """
    own = Window.partitionBy(chooser)
    upto = own.orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    error = F.lit(0.0) if bound is None else F.col(bound).cast("double")
    taken = draws.groupBy(chooser).agg(F.array_sort(F.collect_list(F.struct("draw_no", "rand"))).alias("_draws"))
    usable = F.when(ieee.finite(F.col(utility)), F.col(utility).cast("double"))
    held = rows.select(chooser, position, usable.alias("_u"), error.alias("_e")).where("_u is not null").join(taken, chooser)
    held = held.withColumn("_w", F.exp(F.col("_u") - F.max("_u").over(own)))
    weights = {"_sum": F.col("_w"), "_low": F.col("_w") * F.exp(-F.col("_e")), "_high": F.col("_w") * F.exp("_e")}
    held = held.withColumns({k: F.sum(w).over(upto) for k, w in weights.items()})
    before = own.orderBy(position)
    held = held.withColumns({f"{k}_before": F.coalesce(F.lag(k).over(before), F.lit(0.0)) for k in weights} | {f"{k}_all": F.max(k).over(own) for k in weights})
    total, last = F.col("_sum_all"), F.max(F.when(F.col("_w") > 0, F.col(position))).over(own)
    held = held.withColumn("_last", F.col(position) == last)

    def falls(d: Column) -> Column:
        below = d["rand"] < F.col("_sum") / total
        return (d["rand"] >= F.col("_sum_before") / total) & (below | F.col("_last"))

    least = F.col("_low") / (F.col("_low") + F.col("_high_all") - F.col("_high"))
    most = F.when(F.col("_high_before") == 0, 0.0).otherwise(F.col("_high_before") / (F.col("_high_before") + F.col("_low_all") - F.col("_low_before")))
    here = held.withColumns({"_least": least, "_most": most}).select(
        chooser, F.col(position).alias("choice"), (F.col("_w") / total).alias("prob"), "_least", "_most", F.explode(F.filter("_draws", falls)).alias("_d")
    )
    rand = F.col("_d.rand")
    return here.select(chooser, "_d.draw_no", "_d.rand", "choice", "prob", ((F.col("_least") > rand) & (F.col("_most") <= rand)).alias("proven"))


def guarded_sample(
    rows: DataFrame,
    draws: DataFrame,
    chooser: str,
    position: str,
    utility: str,
    bound: str,
    resolve: Callable[[DataFrame], DataFrame],
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df,
) -> DataFrame:
    """(chooser, draw_no, rand, choice, prob, guarded): samples as exact utilities would give them.

    Choosers all of whose draws are proven keep them.  The others are guarded: ``resolve`` gets their ids, each once, and returns exact
    (chooser, position, utility) rows, among which the very same draws choose again; no draw is taken twice.  ``keep``
    writes the first samples, which both parts read.
    """
    first = proven(rows, draws, chooser, position, utility, bound)
    first = keep(first.withColumn("guarded", ~F.min("proven").over(Window.partitionBy(chooser))), "samples")
    ids = first.where("guarded").select(chooser).distinct()
    again = proven(resolve(ids), draws.join(ids, chooser, "left_semi"), chooser, position, "utility")
    names = [chooser, "draw_no", "rand", "choice", "prob"]
    return first.where("not guarded").select(*names, "guarded").unionByName(again.select(*names, F.lit(True).alias("guarded")))
