"""Nested logit over any tree of nests, as generated projections."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.choice import FAINT, NONE

LOWEST = "DOUBLE('-Infinity')"
#: The least float; utilities at or below it do not count in single precision.
LEAST = float(np.finfo(np.float32).min)


@dataclass(frozen=True)
class Nest:
    """A nest with its own coefficient; parts are nests or names of alternatives."""

    name: str
    coefficient: float
    parts: tuple

    @staticmethod
    def of(tree: dict) -> Nest:
        parts = tuple(x if isinstance(x, str) else Nest.of(x) for x in tree["alternatives"])
        return Nest(tree["name"], float(tree["coefficient"]), parts)

    def leaves(self) -> list[str]:
        return [y for x in self.parts for y in ([x] if isinstance(x, str) else x.leaves())]


def validated(tree: Nest, low: float = 0.05, high: float = 1.0) -> Nest:
    """The tree, if its alternatives are unique, no nest is empty and coefficients lie in [low, high]: A20."""
    leaves = tree.leaves()
    if len(set(leaves)) != len(leaves):
        raise ValueError("an alternative is in two nests")

    def check(nest: Nest) -> None:
        if not nest.parts:
            raise ValueError(f"nest {nest.name} is empty")
        if not low <= nest.coefficient <= high:
            raise ValueError(f"coefficient of {nest.name} is outside [{low}, {high}]")
        for part in nest.parts:
            if isinstance(part, Nest):
                check(part)

    check(tree)
    return tree


def _nests(tree: Nest, scale: float = 1.0, depth: int = 0) -> list[tuple[int, Nest, float]]:
    """(depth, nest, product of coefficients down to it) of all nests."""
    own = scale * tree.coefficient
    below = [y for part in tree.parts if isinstance(part, Nest) for y in _nests(part, own, depth + 1)]
    return [(depth, tree, own), *below]


def with_logsums(df: DataFrame, tree: Nest, shift: bool = True) -> DataFrame:
    """Adds ``_s_<nest>`` for every nest, from the deepest up; leaves are columns of their own names.

    A nest's value is coefficient * ln(sum of exp(part)) (A16); without ``shift`` exponentials are taken as they are (A18).  A
    level is a projection, so nothing is evaluated twice; -inf stands for a nest without an available part.  Projections are SQL
    text, which Spark parses at once.
    """
    nests = _nests(tree)
    for level in range(max(d for d, _, _ in nests), -1, -1):
        here = [(nest, scale) for depth, nest, scale in nests if depth == level]
        df = df.selectExpr("*", *[f"array({', '.join(_part(part, scale) for part in nest.parts)}) AS `_p_{nest.name}`" for nest, scale in here])
        df = df.selectExpr("*", *[f"array_max(`_p_{nest.name}`) AS `_t_{nest.name}`" for nest, _ in here])
        sums = []
        for nest, _ in here:
            top = f"`_t_{nest.name}`" if shift else "0.0D"
            total = " + ".join(f"exp(`_p_{nest.name}`[{i}] - {top})" for i in range(len(nest.parts)))
            sums.append(f"CASE WHEN `_t_{nest.name}` = {LOWEST} THEN {LOWEST} ELSE ({top} + ln({total})) * {float(nest.coefficient)!r}D END AS `_s_{nest.name}`")
        df = df.selectExpr("*", *sums)
    return df


def single_logsum(df: DataFrame, tree: Nest, name: str = "logsum") -> DataFrame:
    """Adds the root's log-sum in single precision, every quotient, exponential, sum and product of which is rounded.

    Nests hold utilities, so a part is divided by the product of coefficients down to its nest and the nest's log-sum multiplied
    by it again.  A part at or below the least float, or not a number, does not count; the largest part counts as 1,
    and the others are added in order.  Without a part that counts the value is -inf.
    """
    nests = _nests(tree)
    held = df.withColumns({f"_v_{x}": F.col(x).cast("float") for x in tree.leaves()})
    for level in range(max(d for d, _, _ in nests), -1, -1):
        here = [(nest, float(np.float32(scale))) for depth, nest, scale in nests if depth == level]
        names = {nest.name: [part if isinstance(part, str) else part.name for part in nest.parts] for nest, _ in here}

        def scaled(part: str, mu: float) -> Column:
            value = F.col(f"_v_{part}")
            return F.when((value > LEAST) & ~F.isnan(value), (value.cast("double") / mu).cast("float"))

        held = held.withColumns({f"_z_{x}": scaled(x, mu) for nest, mu in here for x in names[nest.name]})
        tops = {f"_t_{nest.name}": F.array_max(F.array(*[F.col(f"_z_{x}") for x in names[nest.name]])) for nest, _ in here}
        held = held.withColumns(tops)
        values = {}
        for nest, mu in here:
            top, total = F.col(f"_t_{nest.name}"), F.lit(0.0).cast("float")
            for x in names[nest.name]:
                weight = F.exp((F.col(f"_z_{x}") - top).cast("float").cast("double")).cast("float")
                total = (total + F.coalesce(weight, F.lit(0.0).cast("float"))).cast("float")
            logarithm = (F.log(total.cast("double")).cast("float") + top).cast("float")
            values[f"_v_{nest.name}"] = F.coalesce((logarithm * F.lit(mu).cast("float")).cast("float"), F.lit(NONE).cast("float"))
        held = held.withColumns(values)
    return held.select(*df.columns, F.col(f"_v_{tree.name}").alias(name))


def _part(part: str | Nest, scale: float) -> str:
    return f"CAST(`{part}` AS DOUBLE) / {float(scale)!r}D" if isinstance(part, str) else f"`_s_{part.name}`"


def logsum(df: DataFrame, tree: Nest, name: str = "logsum", shift: bool = True) -> DataFrame:
    """Adds the root's log-sum."""
    held = with_logsums(df, tree, shift)
    return held.select(*df.columns, F.col(f"_s_{tree.name}").alias(name))


def probabilities(df: DataFrame, tree: Nest, name: str = "probabilities") -> DataFrame:
    """Adds each alternative's probability, in the order of the tree's leaves: shares multiplied down the tree."""
    held = with_logsums(df, tree)
    nests = _nests(tree)
    held = held.selectExpr("*", f"1.0D AS `_g_{tree.name}`")
    for level in range(max(d for d, _, _ in nests) + 1):
        here = [nest for depth, nest, _ in nests if depth == level]
        weight = "transform(transform(`_p_{0}`, p -> CASE WHEN p = {1} THEN 0.0D ELSE exp(p - `_t_{0}`) END), x -> CASE WHEN x <= {2!r}D THEN 0.0D ELSE x END) AS `_w_{0}`"
        held = held.selectExpr("*", *[weight.format(n.name, LOWEST, FAINT) for n in here])
        held = held.selectExpr("*", *[f"aggregate(`_w_{n.name}`, 0.0D, (a, x) -> a + x) AS `_n_{n.name}`" for n in here])
        given = []
        for nest in here:
            for i, part in enumerate(nest.parts):
                share = f"CASE WHEN `_n_{nest.name}` > 0 THEN least(1.0D, `_w_{nest.name}`[{i}] / `_n_{nest.name}`) ELSE 0.0D END"
                given.append(f"`_g_{nest.name}` * {share} AS `_g_{part if isinstance(part, str) else part.name}`")
        held = held.selectExpr("*", *given)
    return held.select(*df.columns, F.array(*[F.col(f"_g_{x}") for x in tree.leaves()]).alias(name))


def guard(tree: Nest, probs: Column) -> Column:
    """True where double precision may not decide: a scaled utility over 690, or probabilities that do not add up."""
    far = F.lit(False)
    for _, nest, scale in _nests(tree):
        for part in nest.parts:
            if isinstance(part, str):
                far = far | (F.abs(F.col(part).cast("double") / scale) > 690)
    total = F.aggregate(probs, F.lit(0.0), lambda a, p: a + p)
    return far | (F.abs(total - 1.0) > 1e-7)


#: The 21-alternative mode tree (a fixed value): three automobile pairs, two on foot or bicycle, ten of transit, three ride-hail.
def mode_tree(auto: float = 0.72, sub: float = 0.35, other: float = 0.72, transit: float = 0.72, access: float = 0.5, hail: float = 0.36) -> Nest:
    names = [f"m{i}" for i in range(21)]
    pairs = tuple(Nest(f"auto{i}", sub, tuple(names[2 * i : 2 * i + 2])) for i in range(3))
    walks = (Nest("walk_access", access, tuple(names[8:13])), Nest("drive_access", access, tuple(names[13:18])))
    return Nest(
        "root",
        1.0,
        (
            Nest("auto", auto, pairs),
            Nest("nonmotorized", other, tuple(names[6:8])),
            Nest("transit", transit, walks),
            Nest("ridehail", hail, tuple(names[18:21])),
        ),
    )
