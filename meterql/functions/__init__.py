"""The dialect's scalar operators and aggregates as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterql.front import nodes as n

Typed = tuple[Column, str]
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
#: What a NULL literal is cast to where the place asks for a type.
NULL_AS = {"INT64": "bigint", "FLOAT64": "double", "BOOL": "boolean", "STRING": "string"}


def literal(expr: n.Literal) -> Typed:
    if expr.kind == "INT64":
        return F.lit(expr.value).cast("bigint"), "INT64"
    return F.lit(expr.value), expr.kind


def _as(typed: Typed, kind: str) -> Column:
    return typed[0].cast(NULL_AS[kind]) if typed[1] == "NULL" else typed[0]


def boolean(typed: Typed) -> Column:
    return _as(typed, "BOOL")


def binary(op: str, left: Typed, right: Typed) -> Typed:
    """Three-valued logic; whole numbers divide by truncation; a division by zero is NULL."""
    if op in ("AND", "OR"):
        a, b = boolean(left), boolean(right)
        return (a & b if op == "AND" else a | b), "BOOL"
    if op in _COMPARE:
        return _COMPARE[op](left[0], right[0]), "BOOL"
    kind = "FLOAT64" if "FLOAT64" in (left[1], right[1]) else "INT64"
    a, b = _as(left, kind), _as(right, kind)
    if op == "/":
        if kind == "INT64":
            return F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint"))), kind
        return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), kind
    return {"+": a + b, "-": a - b, "*": a * b}[op], kind


def unary(op: str, operand: Typed) -> Typed:
    if op == "NOT":
        return ~boolean(operand), "BOOL"
    return -_as(operand, "INT64"), operand[1]


def aggregate(call: n.Call, argument: str | None, kind: str) -> Column:
    """argument: the column's name, None for COUNT(*); kind: its type."""
    if argument is None:
        return F.count(F.lit(1))
    column = F.col(argument)
    if call.name == "COUNT":
        return F.count_distinct(column) if call.distinct else F.count(column)
    if call.name == "SUM":
        column = column.cast("bigint") if kind == "NULL" else column
        return F.sum_distinct(column) if call.distinct else F.sum(column)
    if call.name == "AVG":
        return F.expr(f"avg({'distinct ' if call.distinct else ''}cast(`{argument}` as double))")
    return F.min(column) if call.name == "MIN" else F.max(column)
