"""Nested choice whose trees and coefficients are tables, by purpose and segment, in long form."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from wayfare.functions import ieee
from wayfare.operators.choice import FAINT, NONE, checked_draw, choose_from_probabilities
from wayfare.operators.nested import Nest

#: Rows of all trees at most.
MOST = 1 << 16
#: Nests above an alternative at most; a tree that goes deeper is taken to be a circle.
DEEPEST = 12
#: A scaled utility or a sum of probabilities beyond these asks for a closer look (fixed values).
FAR, OFF = 690.0, 1e-7


def tree_rows(tree: Nest, key: tuple, positions: dict[str, int] | None = None) -> list[tuple]:
    """Rows (*key, node, parent, coefficient, position) of a tree; alternatives are numbered in order unless ``positions`` does."""
    numbers = positions or {name: i for i, name in enumerate(tree.leaves())}
    out: list[tuple] = []

    def add(part: Nest | str, parent: str | None) -> None:
        if isinstance(part, str):
            out.append((*key, part, parent, None, numbers[part]))
            return
        out.append((*key, part.name, parent, part.coefficient, None))
        for below in part.parts:
            add(below, part.name)

    add(tree, None)
    return out


def _fault(rows: list[Row], low: float, high: float) -> str | None:
    """What makes one key's rows no tree, if anything does."""
    counts, places = Counter(r["node"] for r in rows), Counter(r["position"] for r in rows if r["position"] is not None)
    nests = {r["node"]: r for r in rows if r["position"] is None}
    full = {r["parent"] for r in rows}
    for r in rows:
        faults = {
            "occurs twice": counts[r["node"]] > 1,
            "shares its position": r["position"] is not None and places[r["position"]] > 1,
            "hangs on no nest": r["parent"] is not None and r["parent"] not in nests,
            "is empty": r["position"] is None and r["node"] not in full,
            f"has a coefficient outside [{low}, {high}]": r["position"] is None and not (r["coefficient"] is not None and low <= r["coefficient"] <= high),
        }
        for fault, there in faults.items():
            if there:
                return f"{r['node']} {fault}"
    roots = [r for r in rows if r["parent"] is None]
    return None if len(roots) == 1 and roots[0]["position"] is None else f"{rows[0]['node']} has no single root above it"


@dataclass(frozen=True)
class Branches:
    """Alternatives of every key with the nests above them, root first: columns nest_i, mu_i, first_i for i up to ``depth``."""

    rows: DataFrame
    keys: list[str]
    depth: int


def branches(tree: DataFrame, keys: list[str], low: float = 0.05, high: float = 1.0) -> Branches:
    """Resolves a table of trees (keys, node, parent, coefficient, position) into one row for each alternative.

    ``scale`` is the product of coefficients from the root down, ``nest_i`` a number of the nest at level i, ``mu_i`` its coefficient,
    and ``first_i`` marks the least position in that nest.  Below its last nest an alternative is its own nest with coefficient 1.
    Raises where a tree is none.  Trees are specifications: up to MOST rows are read as other specifications are, and choosers are
    not looked at.
    """
    rows = tree.select(*keys, "node", "parent", F.col("coefficient").cast("double").alias("coefficient"), F.col("position").cast("int").alias("position")).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"trees have over {MOST} rows")
    trees: dict[tuple, list[Row]] = {}
    for r in rows:
        trees.setdefault(tuple(r[k] for k in keys), []).append(r)
    found = []
    for key, own in trees.items():
        fault = _fault(own, low, high)
        if fault is not None:
            raise ValueError(fault)
        by_node = {r["node"]: r for r in own}
        numbers = {node: i for i, node in enumerate(by_node)}
        for leaf in (r for r in own if r["position"] is not None):
            path, up = [], leaf["parent"]
            while up is not None:
                path.insert(0, (numbers[up], by_node[up]["coefficient"]))
                up = by_node[up]["parent"]
                if len(path) > DEEPEST:
                    raise ValueError(f"nests go in a circle, or deeper than {DEEPEST}")
            found.append((key, leaf, path))
    depth = max((len(path) for _, _, path in found), default=0)
    # the least position in every nest of a key
    first: dict[tuple, int] = {}
    for key, leaf, path in found:
        for nest, _ in path:
            first[key, nest] = min(first.get((key, nest), leaf["position"]), leaf["position"])
    out = []
    for key, leaf, path in found:
        place = leaf["position"]
        nests = [*path, *[(-1 - place, 1.0)] * (depth - len(path))]
        scale = reduce(lambda a, p: a * p[1], path, 1.0)
        out.append((*key, place, str(leaf["node"]), scale, *[n for n, _ in nests], *[m for _, m in nests], *[first.get((key, n), place) == place for n, _ in nests]))
    levels = range(1, depth + 1)
    types = [f"{k} {tree.schema[k].dataType.simpleString()}" for k in keys] + ["position int", "alternative string", "scale double"]
    types += [f"nest_{i} int" for i in levels] + [f"mu_{i} double" for i in levels] + [f"first_{i} boolean" for i in levels]
    return Branches(tree.sparkSession.createDataFrame(out, ", ".join(types)), keys, depth)


def with_coefficients(found: Branches, coefficients: DataFrame, segment: list[str], terms: list[str]) -> Branches:
    """Alternatives with a coefficient ``b_<term>`` for each term, from rows (keys, segment, position, term, coefficient); 0 where there is none."""
    wide = coefficients.groupBy(*found.keys, *segment, "position").pivot("term", terms).agg(F.sum("coefficient"))
    named = wide.select(*found.keys, *segment, "position", *[F.col(t).cast("double").alias(f"_b_{t}") for t in terms])
    segments = coefficients.select(*found.keys, *segment).distinct()
    rows = found.rows.join(segments, found.keys).join(named, [*found.keys, *segment, "position"], "left")
    filled = [F.coalesce(f"_b_{t}", F.lit(0.0)).alias(f"b_{t}") for t in terms]
    return Branches(rows.select(*found.rows.columns, *segment, *filled), [*found.keys, *segment], found.depth)


def solved(rows: DataFrame, depth: int, chooser: str, utility: str = "utility") -> DataFrame:
    """Adds probability and logsum to (chooser, alternative) rows that hold the columns of ``branches``.

    One shuffle, on the chooser, and one sort, in the order of nests: every level's window has a prefix of that order.  From the
    deepest level up a nest's value is its coefficient times the log-sum of its parts, each of which one row stands for;
    down the tree shares multiply.  Utilities that are not finite, null ones among them, make an alternative unavailable.
    """
    nests = [f"nest_{i}" for i in range(1, depth + 1)]
    value = F.when(ieee.finite(F.col(utility)), F.col(utility).cast("double") / F.col("scale")).otherwise(NONE)
    held = rows.repartition(chooser).sortWithinPartitions(chooser, *nests, "position").withColumn("_x", value).withColumn("_v", F.col("_x"))
    shares = []
    for level in range(depth, 0, -1):
        nest = Window.partitionBy(chooser, *nests[:level])
        stands = F.lit(True) if level == depth else F.col(f"first_{level + 1}")
        held = held.withColumn(f"_top_{level}", F.max(F.when(stands, F.col("_x"))).over(nest))
        top = F.col(f"_top_{level}")
        weight = F.when(F.col("_x") == NONE, 0.0).otherwise(F.exp(F.col("_x") - top))
        held = held.withColumn(f"_w_{level}", F.when(weight <= FAINT, 0.0).otherwise(weight))
        held = held.withColumn(f"_sum_{level}", F.sum(F.when(stands, F.col(f"_w_{level}"))).over(nest))
        total = F.col(f"_sum_{level}")
        shares.append(F.when(total > 0, F.col(f"_w_{level}") / total).otherwise(0.0))
        held = held.withColumn("_x", F.when(top == NONE, NONE).otherwise(F.col(f"mu_{level}") * (top + F.log(total))))
    probability = reduce(lambda a, b: a * b, reversed(shares), F.lit(1.0))
    return held.select(*rows.columns, probability.alias("probability"), F.col("_x").alias("logsum"), ((F.col("_v") > NONE) & (F.abs("_v") > FAR)).alias("_far"))


def choose_modes(
    choosers: DataFrame, found: Branches, chooser: str, draw: str, terms: dict[str, Column], available: Column | None = None
) -> DataFrame:
    """A row for each chooser: choice (a position), alternative, logsum and guarded.

    Choosers meet the alternatives of their keys by an equi-join; ``terms`` and ``available`` are columns over both.  Utilities are terms
    times the alternatives' coefficients, in the order of ``terms``.  The first alternative, by position, at which the draw less the
    probabilities so far is not above zero is taken; the first of largest probability, if none is.  Without an available
    alternative the choice is -1 and the logsum -inf.  ``guarded`` rows have a scaled utility beyond FAR, or probabilities
    that do not add up, so that double precision may not decide.  A chooser whose keys have no tree gets no row.
    """
    utility = reduce(lambda a, t: a + F.col(f"b_{t}") * terms[t].cast("double"), terms, F.lit(0.0))
    joined = choosers.withColumn("_draw", checked_draw(F.col(draw))).join(found.rows, found.keys)
    open_ = F.lit(True) if available is None else available
    levels = [f"{c}_{i}" for c in ("nest", "mu", "first") for i in range(1, found.depth + 1)]
    rows = joined.select(chooser, "_draw", "position", "alternative", "scale", *levels, F.when(open_, utility).alias("utility"))
    held = F.array_sort(F.collect_list(F.struct("position", "alternative", "probability")))
    far = F.max(F.col("_far") & (F.col("logsum") > NONE))
    each = solved(rows, found.depth, chooser).groupBy(chooser).agg(held.alias("_held"), F.first("_draw").alias("_draw"), F.first("logsum").alias("logsum"), far.alias("_far"))
    each = each.withColumn("_p", F.transform("_held", lambda x: x["probability"])).withColumn("_total", F.aggregate("_p", F.lit(0.0), lambda a, p: a + p))
    each = each.withColumn("_at", F.when(F.col("_total") > 0, choose_from_probabilities(F.col("_p"), F.col("_draw"))).otherwise(-1))
    taken = F.get("_held", F.col("_at"))
    return each.select(
        chooser,
        F.coalesce(taken["position"], F.lit(-1)).cast("int").alias("choice"),
        taken["alternative"].alias("alternative"),
        "logsum",
        (F.col("_far") | ((F.col("_total") > 0) & (F.abs(F.col("_total") - 1.0) > OFF))).alias("guarded"),
    )
