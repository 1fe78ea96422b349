"""Type names of configurations as Spark types, and what a column's type says about its field."""

from __future__ import annotations

import ast
import re

from pyspark.sql import types as T

from lattica.errors import ConfigError

#: Accepted type names, lower case.
NAMES = {
    "smallinteger": T.IntegerType(), "smallint": T.IntegerType(), "integer": T.IntegerType(), "int": T.IntegerType(),
    "biginteger": T.LongType(), "bigint": T.LongType(), "int64": T.LongType(),
    "numeric": T.DoubleType(), "decimal": T.DoubleType(), "float": T.DoubleType(), "float64": T.DoubleType(), "real": T.DoubleType(), "double": T.DoubleType(),
    "string": T.StringType(), "object": T.StringType(), "text": T.StringType(), "unicode": T.StringType(), "varchar": T.StringType(), "char": T.StringType(),
    "boolean": T.BooleanType(), "bool": T.BooleanType(),
    "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampNTZType(), "datetime64": T.TimestampNTZType(),
}
_FORM = re.compile(r"^\s*([A-Za-z_]\w*)\s*(\(.*\))?\s*$")


def spark_type(name: str) -> T.DataType:
    """The Spark type that values of a declared type are computed with; lengths and scales are not enforced."""
    m = _FORM.match(name or "")
    if not m or m[1].lower() not in NAMES:
        raise ConfigError(f"unknown type {name!r}")
    if m[2]:
        try:
            ast.literal_eval(m[2] if "," in m[2] else m[2][:-1] + ",)")
        except (ValueError, SyntaxError):
            raise ConfigError(f"bad type arguments in {name!r}") from None
    return NAMES[m[1].lower()]


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType)


def declared_name(t: T.DataType) -> str:
    """The name under which a reflected column's type is declared."""
    if isinstance(t, T.DecimalType):
        return f"numeric({t.precision},{t.scale})"
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return "datetime"
    return {T.LongType: "biginteger", T.IntegerType: "integer", T.ShortType: "smallinteger", T.ByteType: "smallinteger", T.DoubleType: "float", T.FloatType: "float", T.BooleanType: "boolean", T.DateType: "date"}.get(type(t), "string")


def looks_like_metric(name: str, t: T.DataType, in_key: bool, formula_aggregates: bool = False) -> bool:
    """Whether an undeclared column makes a metric: an aggregating formula does, keys and ids don't, other numbers do."""
    if formula_aggregates:
        return True
    if in_key or re.search(r"(^id$|_id$|[a-z]Id$)", name):
        return False
    return is_numeric(t)


def default_aggregation(t: T.DataType) -> tuple[str, int | None]:
    """Aggregation and rounding of an undeclared metric: whole numbers are summed, rates of at most one whole digit averaged."""
    if isinstance(t, T.IntegralType):
        return "sum", 0
    if isinstance(t, T.DecimalType):
        return ("mean" if t.precision - t.scale <= 1 else "sum"), t.scale
    return "sum", None
