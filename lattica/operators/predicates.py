"""Criteria as predicates, and row filters on results."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.errors import ReportError

LIST_ALL = {"not like"}
OPS = ("=", "!=", ">", ">=", "<", "<=", "in", "not in", "between", "not between", "like", "not like")
REPORT_OPS = ("in report", "not in report")
ROW_OPS = (">", ">=", "<", "<=", "=", "!=")


def literal(value: object, kind: T.DataType | None = None) -> Column:
    """A value as a literal of the column's type; NULL where a text is no such value."""
    if isinstance(value, str) and kind is not None and not isinstance(kind, T.StringType):
        return F.lit(value).try_cast(kind)
    if kind is not None and isinstance(kind, T.StringType) and not isinstance(value, str):
        return F.lit(str(value))
    return F.lit(value)


def check_criterion(c: object) -> tuple:
    if not isinstance(c, list | tuple) or len(c) != 3 or not isinstance(c[1], str):
        raise ReportError(f"a criterion is (field, operation, value), not {c!r}")
    op = " ".join(c[1].lower().split())
    if op not in OPS + REPORT_OPS:
        raise ReportError(f"unknown operation {c[1]!r}")
    if op in ("between", "not between") and not (isinstance(c[2], list | tuple) and len(c[2]) == 2):
        raise ReportError(f"{op} takes two values")
    return c[0], op, c[2]


def predicate(c: Column, op: str, value: object, kind: T.DataType | None = None) -> Column:
    """The predicate of one criterion on a column or expression."""
    if op in ("in", "not in"):
        values = list(value) if isinstance(value, list | tuple | set) else [value]
        known = [literal(v, kind) for v in values if v is not None]
        none = len(known) < len(values)
        if op == "in":
            out = c.isin(known) if known else F.lit(False)
            return out | c.isNull() if none else out
        out = ~c.isin(known) if known else F.lit(True)
        return out & c.isNotNull() if none else out
    if op in ("between", "not between"):
        out = c.between(literal(value[0], kind), literal(value[1], kind))
        return out if op == "between" else ~out
    if isinstance(value, list | tuple | set):
        each = [predicate(c, op, v, kind) for v in value]
        return functools.reduce(operator.and_ if op in LIST_ALL else operator.or_, each, F.lit(op in LIST_ALL)) if not each else functools.reduce(operator.and_ if op in LIST_ALL else operator.or_, each)
    if value is None:
        if op not in ("=", "!="):
            raise ReportError(f"{op} takes no null")
        return c.isNull() if op == "=" else c.isNotNull()
    if op in ("like", "not like"):
        out = c.cast("string").like(str(value))
        return out if op == "like" else ~out
    v = literal(value, kind)
    return {"=": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]


def row_filter(c: Column, op: str, value: object, kind: T.DataType) -> Column:
    """A filter on finished rows; unlike a criterion, != keeps nulls."""
    if op not in ROW_OPS:
        raise ReportError(f"unknown row filter operation {op!r}")
    v = literal(value, kind)
    if op == "!=":
        return ~c.eqNullSafe(v)
    return {"=": c == v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
