"""Scalar functions with IEEE results where Spark's own raise or give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: Least normal single-precision number (a fixed value): smaller ones are flushed to zero.
TINY = 1.17549435e-38


def divide(a: Column, b: Column) -> Column:
    """a / b in double precision: x/0 is an infinity whose sign is that of x and of the zero, 0/0 and NaN/0 are NaN."""
    a, b = a.cast("double"), b.cast("double")
    negative = b.cast("string") == "-0.0"
    at_zero = F.when(F.isnan(a) | (a == 0), NAN).when((a > 0) != negative, INF).otherwise(-INF)
    return F.when(b == 0, at_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _ordered(a: Column, b: Column, outcome: Column) -> Column:
    return outcome & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))


def compare(a: Column, operator: str, b: Column) -> Column:
    """Comparisons in which NaN equals nothing and is neither above nor below."""
    if operator == "!=":
        return (a != b) | F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    outcome = {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[operator]
    return _ordered(a, b, outcome)


def clip(x: Column, lower: Column | None = None, upper: Column | None = None) -> Column:
    out = x
    if lower is not None:
        out = F.greatest(out, lower)
    if upper is not None:
        out = F.least(out, upper)
    return F.when(F.isnan(x.cast("double")), x).otherwise(out)


def maximum(a: Column, b: Column) -> Column:
    """The larger; NaN if either is (Spark's ``greatest`` ranks NaN highest)."""
    return F.greatest(a, b)


def minimum(a: Column, b: Column) -> Column:
    nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return F.when(nan, F.lit(NAN)).otherwise(F.least(a, b))


def log(x: Column) -> Column:
    """Natural logarithm: -inf at 0, NaN below."""
    x = x.cast("double")
    return F.when(x > 0, F.log(x)).when(x == 0, -INF).otherwise(NAN)


def flushed(x: Column) -> Column:
    """Single precision with subnormals flushed to zero."""
    x = x.cast("float")
    return F.when(F.abs(x) < F.lit(TINY).cast("float"), F.lit(0.0).cast("float")).otherwise(x)


def finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def sampling_correction(picks: Column, prob: Column, most: float = 60.0) -> Column:
    """min(ln(picks / prob), most): a probability of zero gives ``most``."""
    return F.when(prob > 0, F.least(log(divide(picks, prob)), F.lit(most))).otherwise(F.lit(most))


def period_of(hour: Column) -> Column:
    """Skim period 0..4 (early, morning, midday, afternoon, evening) of an hour."""
    return F.when(hour <= 5, 0).when(hour <= 9, 1).when(hour <= 14, 2).when(hour <= 18, 3).otherwise(4)


def period_slot(out_hour: Column, in_hour: Column) -> Column:
    return period_of(out_hour) * 5 + period_of(in_hour)


def label_position(label: Column, labels: tuple[str, ...] = ("EA", "AM", "MD", "PM", "EV")) -> Column:
    """Ordinal of a period's label; an unknown one raises."""
    out = F.array_position(F.array(*map(F.lit, labels)), label)
    return F.when(out > 0, (out - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown period "), label)).cast("int"))


def density_band(population: Column, employment: Column, acres: Column) -> Column:
    """Band 1 (dense) to 5 (rural) of people and jobs a square mile; missing density is band 1."""
    density = divide(population + employment, divide(acres, F.lit(640.0)))
    return F.when(density <= 500, 5).when(density <= 2000, 4).when(density <= 5000, 3).when(density <= 15000, 2).otherwise(1)


def lognormal_wait(mean: Column, sd: Column, normal: Column, least: float = 0.0, most: float = 50.0) -> Column:
    """A log-normal waiting time with this mean and deviation at a standard normal draw, clipped."""
    ratio = F.lit(1.0) + (sd * sd) / (mean * mean)
    mu, sigma = F.log(mean / F.sqrt(ratio)), F.sqrt(F.log(ratio))
    return clip(F.exp(mu + sigma * normal), F.lit(least), F.lit(most))


def name_hash(name: Column) -> Column:
    """Low 32 bits of the MD5 of a channel's or step's name."""
    return F.conv(F.substring(F.md5(name), 25, 8), 16, 10).cast("long")


def membership(mode: Column, groups: list[list[int]]) -> Column:
    """A bit for each group of modes that holds ``mode``."""
    out = F.lit(0)
    for bit, members in enumerate(groups):
        out = out + F.when(mode.isin(members), 1 << bit).otherwise(0)
    return out


def spline(x: Column, knots: list[float]) -> list[Column]:
    """Piecewise-linear parts of ``x`` between knots: clip(x - low, 0, high - low), the last open."""
    parts = []
    for low, high in zip(knots, [*knots[1:], None], strict=True):
        parts.append(clip(x - low, F.lit(0.0), None if high is None else F.lit(high - low)))
    return parts
