"""Specification expressions: a whitelisted part of Python's grammar compiled to Columns."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.functions import ieee

Lookup = Callable[[str, str, str], Column]
_ARITHMETIC = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}
_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


class UnsupportedExpression(ValueError):
    """The expression is outside the grammar."""


#: Marks that specifications put before expressions of Python, outside quoted text.
_MARK = re.compile(r"""('[^']*'|"[^"]*")|@""")


def parsed(text: str) -> ast.expr:
    """The tree of an expression, without marks; text that is no expression raises."""
    plain = _MARK.sub(lambda m: m[1] or " ", text)
    try:
        return ast.parse(f"(\n{plain}\n)", "<specification>", "eval").body
    except (SyntaxError, ValueError) as error:
        raise UnsupportedExpression(f"no expression: {text}") from error


def names(text: str) -> set[str]:
    """Bare and ``df.`` names that an expression reads."""
    found = set()
    for node in ast.walk(parsed(text)):
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "df":
            found.add(node.attr)
        elif isinstance(node, ast.Name) and node.id not in ("df", "np"):
            found.add(node.id)
    return found


def skims(text: str) -> list[tuple[str, str, str]]:
    """Matrix reads: (accessor, key, plain | reverse | max), in order of appearance."""
    found = []
    for node in ast.walk(parsed(text)):
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and isinstance(node.slice, ast.Constant):
            found.append((node.value.id, node.slice.value, "plain"))
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("reverse", "max"):
            if isinstance(node.func.value, ast.Name) and node.args and isinstance(node.args[0], ast.Constant):
                found.append((node.func.value.id, node.args[0].value, node.func.attr))
    return found


def is_stateful(text: str) -> bool:
    """Whether an expression asks the timetable."""
    return any(isinstance(node, ast.Name) and node.id == "tt" for node in ast.walk(parsed(text)))


class Compiler:
    """Compiles trees over named Columns; ``booleans`` tells which names are true or false.

    ``restricted`` leaves names, constants, arithmetic, comparisons and logic, without calls, attributes, subscripts
    and text, as utilities of schedules are written (E12).  ``timetable`` names what ``tt.`` calls stand for; their
    arguments are the row's own person and hours, so they are not compiled (E15).
    """

    def __init__(
        self,
        columns: Mapping[str, Column],
        constants: Mapping[str, float] | None = None,
        booleans: set[str] | frozenset[str] = frozenset(),
        lookup: Lookup | None = None,
        restricted: bool = False,
        timetable: Mapping[str, Column] | None = None,
    ):
        self.columns, self.constants, self.booleans, self.lookup = columns, constants or {}, set(booleans), lookup
        self.restricted, self.timetable = restricted, timetable or {}

    def compile(self, text: str) -> Column:
        return self._visit(parsed(text))[0]

    def number(self, text: str) -> Column:
        """As double precision: true is 1."""
        return self.compile(text).cast("double")

    def _visit(self, node: ast.AST) -> tuple[Column, bool]:
        method = getattr(self, f"_{type(node).__name__.lower()}", None)
        if method is None or self.restricted and isinstance(node, (ast.Attribute, ast.Call, ast.Subscript)):
            raise UnsupportedExpression(ast.unparse(node))
        return method(node)

    def _constant(self, node: ast.Constant):
        if isinstance(node.value, bool):
            return F.lit(node.value), True
        if isinstance(node.value, (int, float)):
            return F.lit(float(node.value)), False
        if isinstance(node.value, str) and not self.restricted:
            return F.lit(node.value), False
        raise UnsupportedExpression(repr(node.value))

    def _name(self, node: ast.Name):
        if node.id in self.columns:
            return self.columns[node.id], node.id in self.booleans
        if node.id in self.constants:
            return F.lit(float(self.constants[node.id])), False
        raise UnsupportedExpression(f"unknown name {node.id}")

    def _attribute(self, node: ast.Attribute):
        if isinstance(node.value, ast.Name) and node.value.id == "df":
            return self._name(ast.Name(node.attr))
        raise UnsupportedExpression(ast.unparse(node))

    def _binop(self, node: ast.BinOp):
        (a, a_bool), (b, b_bool) = self._visit(node.left), self._visit(node.right)
        if isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            if a_bool and b_bool:
                return (a & b if isinstance(node.op, ast.BitAnd) else a | b), True
            a, b = a.cast("long"), b.cast("long")
            return (a.bitwiseAND(b) if isinstance(node.op, ast.BitAnd) else a.bitwiseOR(b)), False
        kind = _ARITHMETIC.get(type(node.op))
        if kind is None:
            raise UnsupportedExpression(ast.unparse(node))
        a, b = a.cast("double"), b.cast("double")
        if kind == "/":
            return ieee.divide(a, b), False
        return (a + b if kind == "+" else a - b if kind == "-" else a * b), False

    def _boolop(self, node: ast.BoolOp):
        out = self._truth(node.values[0])
        for more in node.values[1:]:
            out = out & self._truth(more) if isinstance(node.op, ast.And) else out | self._truth(more)
        return out, True

    def _truth(self, node: ast.AST) -> Column:
        value, boolean = self._visit(node)
        return value if boolean else value != 0

    def _unaryop(self, node: ast.UnaryOp):
        value, boolean = self._visit(node.operand)
        if isinstance(node.op, ast.USub):
            return -value.cast("double"), False
        if isinstance(node.op, ast.UAdd):
            return value.cast("double"), False
        if isinstance(node.op, ast.Not):
            return ~self._truth(node.operand), True
        return (~value, True) if boolean else (F.bitwise_not(value.cast("long")), False)

    def _compare(self, node: ast.Compare):
        out = None
        left = self._visit(node.left)[0]
        for operator, part in zip(node.ops, node.comparators, strict=True):
            if type(operator) not in _COMPARE:
                raise UnsupportedExpression(ast.unparse(node))
            right = self._visit(part)[0]
            text = any(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in (node.left, part))
            kind = _COMPARE[type(operator)]
            if text:
                if kind not in ("==", "!="):
                    raise UnsupportedExpression(ast.unparse(node))
                one = left == right if kind == "==" else left != right
            else:
                one = ieee.compare(left.cast("double"), kind, right.cast("double"))
            out = one if out is None else out & one
            left = right
        return out, True

    def _subscript(self, node: ast.Subscript):
        if self.lookup and isinstance(node.value, ast.Name) and isinstance(node.slice, ast.Constant):
            return self.lookup(node.value.id, node.slice.value, "plain"), False
        raise UnsupportedExpression(ast.unparse(node))

    def _call(self, node: ast.Call):
        if not isinstance(node.func, ast.Attribute):
            raise UnsupportedExpression(ast.unparse(node))
        name, owner = node.func.attr, node.func.value
        if isinstance(owner, ast.Name) and owner.id == "tt" and name in self.timetable:
            return self.timetable[name], False
        if isinstance(owner, ast.Name) and owner.id == "np":
            values = [self._visit(x) for x in node.args]
            numbers = [v.cast("double") for v, _ in values]
            if name == "maximum":
                return ieee.maximum(*numbers), False
            if name == "minimum":
                return ieee.minimum(*numbers), False
            if name == "where":
                return F.when(self._truth(node.args[0]), numbers[1]).otherwise(numbers[2]), False
            if name == "log":
                return ieee.log(numbers[0]), False
            if name == "log1p":
                return F.log1p(numbers[0]), False
            if name == "exp":
                return F.exp(numbers[0]), False
            raise UnsupportedExpression(ast.unparse(node))
        if name == "clip":
            bounds = {k: self._visit(x)[0].cast("double") for k, x in zip(("lower", "upper"), node.args, strict=False)}
            bounds |= {k.arg: self._visit(k.value)[0].cast("double") for k in node.keywords}
            if set(bounds) - {"lower", "upper"}:
                raise UnsupportedExpression(ast.unparse(node))
            return ieee.clip(self._visit(owner)[0].cast("double"), bounds.get("lower"), bounds.get("upper")), False
        if name in ("reverse", "max") and self.lookup and isinstance(owner, ast.Name) and isinstance(node.args[0], ast.Constant):
            if name == "reverse":
                return self.lookup(owner.id, node.args[0].value, "reverse"), False
            both = [self.lookup(owner.id, node.args[0].value, x) for x in ("plain", "reverse")]
            return ieee.maximum(*both), False
        raise UnsupportedExpression(ast.unparse(node))
