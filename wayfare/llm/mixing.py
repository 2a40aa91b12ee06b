"""Mixing sources to target weights by a low-discrepancy schedule (operator 2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import WORD, finished, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives each of its words so many times at most.
EPOCHS = 3
#: The fractional part of the golden ratio in units of 1 / POINTS, to the nearest odd number.
POINTS, HALF = 1 << 40, 20
GOLDEN = 679535556991
#: Bits of a point within a cell, of which there are 4,096.
CELL = 28
#: Words of a block, the same for every source.
BLOCK = 1024
#: Slots of a schedule for each that the targets need.  Points that turn by the golden ratio leave gaps of less than 1.9 / n
#: after n of them, so that with twice as many every needed slot's share of the circle has been met.
SPAN = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS) -> DataFrame:
    """Adds weight and target to (source, source_size): a row for each source, so a small table.

    Targets share all words by weight; a target over ``most`` times its source's size
    stops there and the excess is reshared.  Sources in order of the size at which
    they stop, for their weight, make that one pass of running sums.
    """
    everything = Window.partitionBy()
    by_code_point = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    cap = (F.lit(most) * F.col("source_size")).alias("cap")
    rows = sizes.select("source", "source_size", cap, (F.row_number().over(by_code_point) - 1).alias("place"))
    options = F.array(*[F.lit(float(w)) for w in weights])
    rows = rows.withColumn("weight", F.element_at(options, (F.col("place") % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / heavy).withColumn("free", F.col("cap") / F.col("weight") >= F.col("level"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return rows.select(
        "source",
        "source_size",
        "weight",
        "place",
        F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"),
    )


def running(df: DataFrame, key: list[str], order: list[str], value: Column, name: str, spread: Column) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of ``key`` that come before, in ``order``.

    ``spread`` is a bucket that does not fall along ``order``.  Sums of buckets are added
    up first (a small table), so no task holds more than a bucket of a key.
    """
    df = df.withColumn("_bucket", spread).withColumn("_value", value)
    sums = df.groupBy(*key, "_bucket").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = F.col("_base") + F.coalesce(F.sum("_value").over(within), F.lit(0))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*key, "_bucket"]]
    on = same[0]
    for more in same[1:]:
        on = on & more
    joined = df.alias("l").join(sums.alias("r"), on).select("l.*", "r._base")
    return joined.withColumn(name, added).drop("_bucket", "_value", "_base")


def blocks_of(targets: DataFrame, block: int) -> DataFrame:
    """Adds goal and needed to sources that give anything: the words to take, and the blocks of ``block`` words that these fill.

    Blocks are as long for every source; only the last one that a source gives may be shorter.
    """
    rows = targets.withColumn("goal", F.floor("target").cast("long")).where("source_size > 0 AND goal > 0")
    return rows.withColumn("needed", F.ceil(F.col("goal") / F.lit(block)).cast("long"))


def golden(slot: Column) -> Column:
    """The point of a slot, frac(slot * phi), in units of 1 / POINTS; in two halves, so that no product overflows."""
    high, low = F.shiftright(slot, HALF), slot.bitwiseAND((1 << HALF) - 1)
    return (high * F.lit((GOLDEN << HALF) % POINTS) + low * F.lit(GOLDEN)) % F.lit(POINTS)


def schedule(sources: DataFrame, slots: int, point: Callable[[Column], Column] = golden) -> DataFrame:
    """The order in which sources give blocks: rows (slot, place, rank) of ``slots`` slots, but for those of sources that are done.

    ``point`` maps slot i to a point, and the cumulative weights (blocks ``needed``) map that to a source; the rank counts the
    source's slots so far, and names its block.  Golden-ratio points of any run of slots fall evenly, so until the first
    source has given all it needs, every prefix of the schedule keeps the weights; slots of a source that is done are passed over.
    Cells of equal width make the search for a point's source an equi-join.
    """
    total = F.sum("needed").over(Window.partitionBy())
    upto = F.sum("needed").over(Window.orderBy("place"))
    bounds = sources.select(
        "place",
        F.floor((upto - F.col("needed")) * float(POINTS) / total).alias("low"),
        F.floor(upto * float(POINTS) / total).alias("high"),
    )
    cells = bounds.withColumn("cell", F.explode(F.sequence(F.shiftright("low", CELL), F.shiftright("high", CELL))))
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.shiftright("point", CELL))
    drawn = points.join(cells, "cell").where("point >= low and point < high").select("slot", "place")
    ranked = running(drawn, ["place"], ["slot"], F.lit(1), "rank", F.shiftright("slot", 14))
    return ranked.join(sources.select("place", "needed"), "place").where("rank < needed").select("slot", "place", "rank")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = "mix",
    point: Callable[[Column], Column] = golden,
) -> DataFrame:
    """How many words the mix takes of each document.

    Returns a row for each row: doc_id, size (words), source, source_size, weight,
    target (the source's), taken (words, repeats counted), first_slot (of the schedule, that takes words of it; null if
    none does).  The documents of a source are shuffled (by a hash of id and ``seed``) and laid end to end, and that line is
    repeated ``EPOCHS`` times.  A slot of the schedule takes the next ``block`` words of its source's line, up to the target;
    slots come to sources by golden-ratio points on the cumulative weights, and what they take of a document is what the mix takes.

    Null and empty texts have no words and give none; null sources are a source; rows that repeat an id
    keep apart; an empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        word_count(docs[text_col]).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), docs[id_col].cast("string"))).alias("shuffled"),
    )
    rows = written(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights), "targets")
    sources = blocks_of(targets, block)
    slots = sources.agg(F.sum("needed")).first()[0] or 0
    given = schedule(sources, SPAN * slots, point)
    placed = running(
        rows.where("size > 0"),
        ["source"],
        ["shuffled", "doc_id", "size"],
        F.col("size"),
        "start",
        F.conv(F.substring("shuffled", 1, 3), 16, 10).cast("int"),
    )
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    known = sources.select("source", "place", "source_size", "goal").alias("t")
    placed = written(placed.alias("d").join(known, same, "left").select("d.*", "t.place", "t.source_size", "t.goal"), "placed")
    # a document's words in each repeat of its source's line, and the blocks in which they lie
    begins = F.transform(F.sequence(F.lit(0), F.lit(EPOCHS - 1)), lambda i: i * F.col("source_size") + F.col("start"))
    times = placed.select("place", "start", "size", "goal", F.explode(begins).alias("begin")).where("begin < goal")
    times = times.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("goal")))
    each = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))
    pieces = times.select("place", "start", "begin", "end", F.explode(each).alias("rank"))
    held = F.least("end", (F.col("rank") + 1) * block) - F.greatest("begin", F.col("rank") * block)
    taken = pieces.join(given, ["place", "rank"]).groupBy("place", "start")
    taken = taken.agg(F.sum(held).alias("taken"), F.min("slot").alias("first_slot"))
    found = placed.join(taken, ["place", "start"], "left").select("doc_id", "size", "source", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")
    nothing = F.lit(None).cast("long").alias("first_slot")
    none = rows.where("size = 0").select("doc_id", "size", "source", F.lit(0).cast("long").alias("taken"), nothing)
    both = found.unionByName(none).alias("d").join(targets.alias("t"), same)
    both = both.select("doc_id", "size", "d.source", "source_size", "weight", "target", "taken", "first_slot")
    return finished(both, "mix", rows, targets, placed)
