"""Multinomial choice: probabilities, log-sums and choices.

Two physical forms.  With a fixed, modest number of alternatives a chooser's
utilities are one ``array<double>`` and everything is a projection without a
shuffle.  Ragged or many alternatives are long: a row for each (chooser,
position), one shuffle on the chooser, running sums in a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import ieee

NONE = float("-inf")
#: Weights up to this are no probability (a fixed value).
FAINT = 1e-300
#: Alternatives that are columns at most, and products of coefficients that are written out.
COMPILED, PRODUCTS = 32, 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def masked(utilities: Column, availability: Column | None = None) -> Column:
    """Utilities with -inf where an alternative is unavailable or its utility is not finite."""
    usable = F.transform(utilities, lambda u: F.when(ieee.finite(u), u.cast("double")).otherwise(NONE))
    if availability is None:
        return usable
    return F.zip_with(usable, availability, lambda u, a: F.when(a, u).otherwise(NONE))


def weights(utilities: Column) -> Column:
    """exp(u - max u), 0 where unavailable."""

    def shifted(top: Column) -> Column:
        return F.transform(utilities, lambda u: F.when(u == NONE, 0.0).otherwise(F.exp(u - top)))

    return let(F.array_max(utilities), shifted)


def total(values: Column) -> Column:
    """Sum in order."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def first_reaching(values: Column, threshold: Column, strict: bool = False) -> Column:
    """0-based position of the first running sum of ``values`` at (above, if strict) ``threshold``; -1 if none."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("found"))

    def step(a: Column, x: Column) -> Column:
        running = a["sum"] + x.cast("double")
        hit = running > threshold if strict else running >= threshold
        found = F.when((a["found"] < 0) & hit, a["at"]).otherwise(a["found"])
        return F.struct(running.alias("sum"), (a["at"] + 1).alias("at"), found.alias("found"))

    return F.aggregate(values, start, step, lambda a: a["found"])


def largest(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def checked_draw(draw: Column) -> Column:
    return F.when(ieee.finite(draw) & (draw >= 0) & (draw < 1), draw).otherwise(
        F.raise_error(F.lit("draws must lie in [0, 1)")).cast("double")
    )


def choose(df: DataFrame, utilities: str, draw: str, availability: str | None = None, width: int | None = None) -> DataFrame:
    """Adds choice (position, -1 if nothing is available) and logsum (-inf then): A1.

    The first alternative whose running weight reaches draw * total; the first largest if none does.
    A draw of 0 takes the first position, available or not.  If all rows have ``width`` alternatives, and these are few,
    they are columns instead of array elements, and all is compiled code.
    """
    if width is not None and width <= COMPILED:
        return _choose_columns(df, utilities, draw, availability, width)
    u = masked(F.col(utilities), None if availability is None else F.col(availability))
    held = df.withColumn("_u", u).withColumn("_w", weights(F.col("_u"))).withColumn("_total", total(F.col("_w")))
    hit = first_reaching(F.col("_w"), checked_draw(F.col(draw)) * F.col("_total"))
    some = F.col("_total") > 0
    choice = F.when(~some, -1).when(hit >= 0, hit).otherwise(largest(F.col("_w")))
    logsum = F.when(some, F.array_max("_u") + F.log("_total")).otherwise(NONE)
    return held.withColumn("choice", choice).withColumn("logsum", logsum).drop("_u", "_w", "_total")


def _choose_columns(df: DataFrame, utilities: str, draw: str, availability: str | None, width: int) -> DataFrame:
    """``choose`` over ``width`` columns; each projection reads what the one before it has computed once.

    Projections are written as SQL text, which Spark parses at once, where thousands of Column objects would be made one by one.
    """
    each = range(width)
    own = [f"`{c}`" for c in df.columns]
    u, w = ([f"_{x}{i}" for i in each] for x in "uw")

    def usable(i: int) -> str:
        value = f"`{utilities}`[{i}]"
        open_ = finite_sql(value) + ("" if availability is None else f" AND `{availability}`[{i}]")
        return f"CASE WHEN {open_} THEN CAST({value} AS DOUBLE) ELSE DOUBLE('-Infinity') END AS {u[i]}"

    def most(columns: list[str]) -> str:
        return f"greatest({', '.join(columns)})" if width > 1 else columns[0]

    z = f"`{draw}`"
    checked = f"CASE WHEN {finite_sql(z)} AND {z} >= 0 AND {z} < 1 THEN {z} ELSE CAST(raise_error('draws must lie in [0, 1)') AS DOUBLE) END AS _z"
    held = df.selectExpr(*own, checked, *map(usable, each))
    held = held.selectExpr(*own, "_z", *u, f"{most(u)} AS _top")
    held = held.selectExpr(*own, "_z", "_top", *[f"CASE WHEN {x} = DOUBLE('-Infinity') THEN 0.0D ELSE exp({x} - _top) END AS {y}" for x, y in zip(u, w, strict=True)])
    held = held.selectExpr(*own, "_z", "_top", *w, f"{' + '.join(['0.0D', *w])} AS _total")
    held = held.selectExpr(*own, "_top", "_total", *w, "_z * _total AS _bar", f"{most(w)} AS _most")
    hits = " ".join(f"WHEN {' + '.join(['0.0D', *w[: i + 1]])} >= _bar THEN {i}" for i in each)
    best = " ".join(f"WHEN {w[i]} = _most THEN {i}" for i in each)
    choice = f"CASE WHEN NOT (_total > 0) THEN -1 {hits} {best} END AS choice"
    return held.selectExpr(*own, choice, "CASE WHEN _total > 0 THEN _top + ln(_total) ELSE DOUBLE('-Infinity') END AS logsum")


def finite_sql(value: str) -> str:
    """``ieee.finite`` as SQL text."""
    return f"({value} IS NOT NULL AND NOT isnan({value}) AND abs({value}) <> DOUBLE('Infinity'))"


def probabilities(utilities: Column) -> tuple[Column, Column]:
    """(probabilities, logsum) with faint weights cut: A8."""
    w = F.transform(weights(utilities), lambda x: F.when(x <= FAINT, 0.0).otherwise(x))
    probs = let(w, lambda v: let(total(v), lambda t: F.transform(v, lambda x: x / t)))
    return probs, F.log(total(w)) + F.array_max(utilities)


def choose_from_probabilities(probs: Column, draw: Column) -> Column:
    """Ordered subtraction: the first position where draw - p0 - ... <= 0; the first largest if none: A3."""
    start = F.struct(draw.cast("double").alias("left"), F.lit(0).alias("at"), F.lit(-1).alias("found"))

    def step(a: Column, p: Column) -> Column:
        left = a["left"] - p.cast("double")
        found = F.when((a["found"] < 0) & (left <= 0), a["at"]).otherwise(a["found"])
        return F.struct(left.alias("left"), (a["at"] + 1).alias("at"), found.alias("found"))

    hit = F.aggregate(probs, start, step, lambda a: a["found"])
    return F.when(hit >= 0, hit).otherwise(largest(probs))


def make_choices(df: DataFrame, probs: str, draw: str, allow_bad: bool = False, tolerance: float = 1e-3) -> DataFrame:
    """Adds choice; rows whose probabilities do not sum to 1 raise unless allowed: A5."""
    bad = F.abs(total(F.col(probs)) - 1.0) > tolerance
    p = F.col(probs)
    if not allow_bad:
        p = F.when(bad, F.raise_error(F.lit("probabilities do not sum to 1")).cast("array<double>")).otherwise(p)
    return df.withColumn("choice", choose_from_probabilities(p, F.col(draw)))


def choose_fixed(df: DataFrame, utilities: str, draw: str) -> DataFrame:
    """Adds choice and logsum of a small fixed model: probabilities cut when faint and held in [0, 1], taken by ordered
    subtraction; the first largest utility if none is reached: A9."""
    probs, logsum = probabilities(F.col(utilities))
    held = df.withColumn("_p", F.transform(probs, lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))).withColumn("logsum", logsum)
    start = F.struct(checked_draw(F.col(draw)).alias("left"), F.lit(0).alias("at"), F.lit(-1).alias("found"))

    def step(a: Column, p: Column) -> Column:
        left = a["left"] - p
        return F.struct(left.alias("left"), (a["at"] + 1).alias("at"), F.when((a["found"] < 0) & (left <= 0), a["at"]).otherwise(a["found"]).alias("found"))

    hit = F.aggregate("_p", start, step, lambda a: a["found"])
    return held.withColumn("choice", F.when(hit >= 0, hit).otherwise(largest(F.col(utilities)))).drop("_p")


def labelled(choice: Column, labels: list) -> Column:
    """Positions to labels; -1 stays: A4."""
    return F.when(choice >= 0, F.element_at(F.array(*map(F.lit, labels)), choice + 1)).otherwise(F.lit(-1))


def linear_utilities(features: str, coefficients: list[list[float]], constants: list[float]) -> Column:
    """Dot products of an array column with each alternative's coefficients, plus constants: A2, A7, A10.

    Up to PRODUCTS they are written out as SQL text, so that they are compiled and parsed at once.
    """
    if sum(map(len, coefficients)) <= PRODUCTS:
        x = [f"CAST(`{features}`[{i}] AS DOUBLE)" for i in range(len(coefficients[0]))] if coefficients else []
        sums = [f"({float(c)!r}D + ({' + '.join(['0.0D', *(f'{x[i]} * ({float(b)!r}D)' for i, b in enumerate(beta))])}))" for beta, c in zip(coefficients, constants, strict=True)]
        return F.expr(f"array({', '.join(sums)})")

    def dot(beta: list[float], constant: float) -> Column:
        b = F.array(*[F.lit(float(x)) for x in beta])
        products = F.zip_with(features, b, lambda x, y: x.cast("double") * y)
        return F.lit(float(constant)) + total(products)

    return F.array(*[dot(b, c) for b, c in zip(coefficients, constants, strict=True)])


def grouped_sum(terms: list[Column], group: int | None = None) -> Column:
    """Single-precision sum of terms, from the left, or of groups of ``group`` from the left: A14."""

    def left(parts: list[Column]) -> Column:
        out = parts[0].cast("float")
        for x in parts[1:]:
            out = (out + x.cast("float")).cast("float")
        return out

    return left(terms) if group is None else left([left(terms[i : i + group]) for i in range(0, len(terms), group)])


def ordered_float_utility(terms: list[Column], coefficients: list[float]) -> Column:
    """Source-ordered single-precision dot product; every product and sum is rounded and flushed: A11."""
    out = F.lit(0.0).cast("float")
    for term, beta in zip(terms, coefficients, strict=True):
        product = ieee.flushed(term.cast("float") * F.lit(float(beta)).cast("float"))
        out = ieee.flushed(out + product)
    return out


# long form


def long_utilities(rows: DataFrame, terms: list[str], coefficients: dict[str, float] | DataFrame, segment: str | None = None) -> DataFrame:
    """Adds utility to (chooser, position) rows from columns of terms: A21; with a table
    (segment, term, coefficient) the coefficients go by the chooser's segment: A22."""
    if isinstance(coefficients, dict):
        utility = sum((F.col(t).cast("double") * F.lit(float(coefficients[t])) for t in terms), F.lit(0.0))
        return rows.withColumn("utility", utility)
    wide = coefficients.groupBy(segment).pivot("term", terms).agg(F.first("coefficient"))
    wide = wide.select(segment, *[F.coalesce(F.col(t), F.lit(0.0)).alias(f"_b_{t}") for t in terms])
    joined = rows.join(wide, segment)
    utility = sum((F.col(t).cast("double") * F.col(f"_b_{t}") for t in terms), F.lit(0.0))
    return joined.withColumn("utility", utility).drop(*[f"_b_{t}" for t in terms])


def choose_long(rows: DataFrame, chooser: str, position: str, utility: str, draw: str, fallback: str = "last") -> DataFrame:
    """A row for each chooser: choice (a position), logsum.  One shuffle, on the chooser: A21-A23.

    ``fallback`` takes the last alternative, or the first largest, if no running weight reaches the draw.
    """
    everything = Window.partitionBy(chooser)
    upto = everything.orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    usable = F.when(ieee.finite(F.col(utility)), F.col(utility).cast("double"))
    held = rows.withColumn("_u", usable).withColumn("_top", F.max("_u").over(everything))
    held = held.withColumn("_w", F.coalesce(F.exp(F.col("_u") - F.col("_top")), F.lit(0.0)))
    held = held.withColumn("_upto", F.sum("_w").over(upto)).withColumn("_total", F.max("_upto").over(everything))
    bar = checked_draw(F.col(draw)) * F.col("_total")
    hit = F.col("_upto") >= bar
    spare = F.max(position) if fallback == "last" else F.max_by(position, F.struct("_w", -F.col(position)))
    some = F.max("_total") > 0
    return held.groupBy(chooser).agg(
        F.when(some, F.coalesce(F.min(F.when(hit, F.col(position))), spare)).otherwise(-1).alias("choice"),
        F.when(some, F.max("_top") + F.log(F.max("_total"))).otherwise(NONE).alias("logsum"),
        F.min(F.abs(F.col("_upto") - bar)).alias("boundary_distance"),
    )


def choose_long_single(rows: DataFrame, chooser: str, position: str, utility: str, draw: str) -> DataFrame:
    """(chooser, choice, boundary_distance) as schedules are chosen: utilities and probabilities in single precision, the
    draw less each probability in double; the last row if nothing is reached: A23."""
    own = Window.partitionBy(chooser)
    u = F.col(utility).cast("float").cast("double")
    held = rows.withColumn("_u", u).withColumn("_w", F.exp(F.col("_u") - F.max("_u").over(own)).cast("float").cast("double"))
    p = (F.col("_w") / F.sum("_w").over(own).cast("float").cast("double")).cast("float").cast("double")
    left = checked_draw(F.col(draw)) - F.sum("_p").over(own.orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_p", p).withColumn("_left", left)
    hit = F.min(F.when(F.col("_left") <= 0, F.col(position)))
    return held.groupBy(chooser).agg(F.coalesce(hit, F.max(position)).alias("choice"), F.min(F.abs("_left")).alias("boundary_distance"))
