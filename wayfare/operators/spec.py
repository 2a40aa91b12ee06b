"""Specifications: expressions by alternatives, resolved to numbers, as documents and as utilities."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.expressions import Compiler, is_stateful, names, skims
from wayfare.operators.choice import linear_utilities

FORMAT = "wayfare-specification-2"


@dataclass(frozen=True)
class Spec:
    """Terms (label, expression) and a coefficient for each term and alternative."""

    name: str
    alternatives: tuple[str, ...]
    labels: tuple[str, ...]
    expressions: tuple[str, ...]
    coefficients: tuple[tuple[float, ...], ...]

    def __post_init__(self):
        if len(set(self.alternatives)) != len(self.alternatives):
            raise ValueError("an alternative is named twice")
        if not len(self.labels) == len(self.expressions) == len(self.coefficients):
            raise ValueError("labels, expressions and coefficients differ in number")
        values = [x for row in self.coefficients for x in row]
        if any(x != x or x in (float("inf"), float("-inf")) for x in values):
            raise ValueError("a coefficient is not finite")

    @property
    def locals(self) -> list[tuple[str, str]]:
        """Rows of the form _name@expression: reusable values, no terms."""
        return [tuple(e.split("@", 1)) for e in self.expressions if is_local(e)]

    def terms(self) -> list[tuple[str, str, tuple[float, ...]]]:
        rows = zip(self.labels, self.expressions, self.coefficients, strict=True)
        return [(label, e, row) for label, e, row in rows if not is_local(e)]

    def document(self) -> dict:
        """The specification as a JSON document: each row with what it reads and its weights by alternative."""
        rows = []
        for label, expression, weights in zip(self.labels, self.expressions, self.coefficients, strict=True):
            held = {a: w for a, w in zip(self.alternatives, weights, strict=True) if w}
            rows.append({"name": label, "text": expression, "reads": sorted(names(_value(expression))), "matrices": [".".join(x) for x in skims(_value(expression))], "weights": held})
        return {"format": FORMAT, "specification": self.name, "choices": list(self.alternatives), "rows": rows, "digest": self.digest()}

    def digest(self) -> str:
        """A hash of what decides results: alternatives, rows and weights, in order."""
        out = hashlib.blake2b(FORMAT.encode(), digest_size=20)
        for part in (*self.alternatives, *(f"{n}\t{e}\t{[float(x).hex() for x in w]}" for n, e, w in zip(self.labels, self.expressions, self.coefficients, strict=True))):
            out.update(part.encode() + b"\n")
        return out.hexdigest()

    @staticmethod
    def of_document(document: dict) -> Spec:
        """The specification that a document holds; another format, or a digest that differs, raises."""
        if document.get("format") != FORMAT:
            raise ValueError(f"not a document of format {FORMAT}")
        choices, rows = tuple(document["choices"]), document["rows"]
        weights = tuple(tuple(float(r["weights"].get(c, 0.0)) for c in choices) for r in rows)
        spec = Spec(document["specification"], choices, tuple(r["name"] for r in rows), tuple(r["text"] for r in rows), weights)
        if spec.digest() != document.get("digest"):
            raise ValueError("the document was changed after it was written")
        return spec

    def skims(self) -> list[tuple[str, str, str]]:
        """Matrix reads of all rows, once each."""
        return list(dict.fromkeys(x for e in self.expressions for x in skims(_value(e))))


def is_local(expression: str) -> bool:
    head = expression.split("@", 1)[0].strip()
    return "@" in expression and head.startswith("_") and head.isidentifier()


def _value(expression: str) -> str:
    """What is computed: a local's expression without its name."""
    return expression.split("@", 1)[1] if is_local(expression) else expression


def split_stateful(spec: Spec) -> tuple[Spec, Spec]:
    """(rows that any batch can compute beforehand, rows that need the timetable of the moment): E15.

    A row is stateful if it asks the timetable, or reads a local that does; such locals go with it.
    """
    asking: set[str] = set()
    for name, expression in spec.locals:
        if is_stateful(expression) or names(expression) & asking:
            asking.add(name)
    rows = list(zip(spec.labels, spec.expressions, spec.coefficients, strict=True))

    def late(expression: str) -> bool:
        return is_stateful(_value(expression)) or bool(names(_value(expression)) & asking)

    def part(stateful: bool) -> Spec:
        own = [r for r in rows if late(r[1]) is stateful]
        return Spec(f"{spec.name}-{'stateful' if stateful else 'plain'}", spec.alternatives, *(tuple(x) for x in zip(*own, strict=True))) if own else Spec(spec.name, spec.alternatives, (), (), ())

    return part(False), part(True)


def write_document(spark: SparkSession, spec: Spec, path: str) -> None:
    """A specification's document as one JSON text file, where Spark writes; an existing one is never overwritten."""
    text = json.dumps(spec.document(), indent=1, sort_keys=True, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def read_document(spark: SparkSession, path: str) -> Spec:
    """The specification of a written document; one that was changed since raises."""
    return Spec.of_document(json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())))


def resolved(rows: list[dict], coefficients: dict[str, float], name: str = "") -> Spec:
    """A specification from rows of Expression, Label and alternatives (numbers, blanks or symbols): S1.

    Rows without an expression go, symbols become numbers, values are rounded to single precision, and rows whose
    coefficients are all zero go (but locals stay).
    """
    alternatives = [c for c in rows[0] if c not in ("Label", "Description", "Expression")]
    kept = []
    for i, row in enumerate(rows):
        expression = (row.get("Expression") or "").strip()
        if not expression:
            continue
        values = tuple(_number(row.get(a), coefficients) for a in alternatives)
        if any(values) or is_local(expression):
            kept.append((row.get("Label") or f"term{i}", expression, values))
    return Spec(name, tuple(alternatives), *(tuple(x) for x in zip(*kept, strict=True)))


def _number(cell, coefficients: dict[str, float]) -> float:
    import numpy as np

    text = "" if cell is None else str(cell).strip()
    if not text:
        return 0.0
    try:
        value = float(text)
    except ValueError:
        if text not in coefficients:
            raise ValueError(f"no coefficient {text}") from None
        value = coefficients[text]
    return float(np.float32(value))


def features(df: DataFrame, spec: Spec, compiler: Compiler | None = None, **options) -> DataFrame:
    """Adds ``features``, a double for each term; locals are compiled first and read by name."""
    columns = {c: F.col(c) for c in df.columns}
    booleans = {c for c, kind in df.dtypes if kind == "boolean"}
    for name, expression in spec.locals:
        own = compiler or Compiler(columns, booleans=booleans, **options)
        df = df.withColumn(name, own.number(expression))
        columns[name] = F.col(name)
    own = compiler or Compiler(columns, booleans=booleans, **options)
    return df.withColumn("features", F.array(*[own.number(e) for _, e, _ in spec.terms()]))


def utilities(df: DataFrame, spec: Spec, **options) -> DataFrame:
    """Adds ``utilities``, an array in the order of alternatives: A7, A10, C5.

    Terms are evaluated once for all alternatives, in a projection of their own.
    """
    held = features(df, spec, **options)
    rows = [row for _, _, row in spec.terms()]
    by_alternative = [list(x) for x in zip(*rows, strict=True)]
    value: Column = linear_utilities("features", by_alternative, [0.0] * len(spec.alternatives))
    return held.withColumn("utilities", value).drop("features")
