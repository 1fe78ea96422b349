"""One query: left joins from the base table, criteria, and one aggregation by the dimensions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import dates, formulas, types
from lattica.model import ColumnSpec, Dimension, FieldUse, Metric, TableSpec
from lattica.operators.predicates import predicate
from lattica.plans.graph import TableSet
from lattica.plans.planner import Query, Request

HINTS = {"broadcast", "broadcastjoin", "mapjoin", "merge", "shuffle_hash", "shuffle_replicate_nl", "coalesce", "rebalance"}


def raw_column(t: TableSpec, c: ColumnSpec) -> Column:
    return F.col(f"`{t.alias}`.`{c.name}`")


def expression(t: TableSpec, c: ColumnSpec, use: FieldUse) -> Column:
    """What a column gives for a field, without aggregation."""
    if use.ds_formula:
        return F.expr(f"({formulas.null_for_zero(formulas.check(use.ds_formula))})")
    return dates.PARTS[use.part].make(raw_column(t, c)) if use.part else raw_column(t, c)


def joined(s: TableSet, semi: list[tuple[str, str, DataFrame]] = ()) -> DataFrame:
    """The base table with its joins."""
    tables = s.datasource.tables

    def frame(t: TableSpec) -> DataFrame:
        return t.frame.alias(t.alias)

    hint = next((h for h in [*(tables[n].prefix_with for n in s.tables), s.datasource.prefix_with] if h), None)
    df = frame(s.base)
    for step in s.steps:
        left, right = tables[step.left], tables[step.right]
        pairs = [(left.uses()[f], right.uses()[f]) for f in step.fields]
        on = functools.reduce(operator.and_, [expression(left, *a) == expression(right, *b) for a, b in pairs])
        other = frame(right)
        if hint and hint.strip().lower() in HINTS:
            other = other.hint(hint.strip().lower())
        df = df.join(other, on, "left")
    return df


def criterion(s: TableSet, df: DataFrame, name: str, op: str, value: object) -> Column:
    """The predicate for a criterion, on the raw column where its field has a conversion."""
    t, c, use = s.use(name)
    if use.conversions and op in use.conversions:
        rules = use.conversions[op]
        from lattica.config import imported

        raw = raw_column(t, c)
        values = list(value) if isinstance(value, list | tuple) else [value]
        if isinstance(rules, str):
            rules = imported(rules)
        found = rules(values) if callable(rules) else rules
        out = []
        for rule_op, v in found:
            given = v if isinstance(v, list) else [v]
            put = [_bound(x, values) for x in given]
            out.append(_compare(raw, rule_op, put if isinstance(v, list) else put[0]))
        return functools.reduce(operator.and_, out)
    if use.part in dates.FORMATS:
        found = dates.range_predicate(raw_column(t, c), use.part, op, value)
        if found is not None:
            return found
    x = expression(t, c, use)
    return predicate(x, op, value, df.select(x.alias("x")).schema["x"].dataType)


def _bound(x: object, values: list) -> object:
    """A conversion's value: "{}" and ":0" stand for the request's values, other texts with them are expressions."""
    if not isinstance(x, str):
        return x
    if x in ("{}", ":0"):
        return values[0]
    if ":" in x and any(f":{i}" in x for i in range(len(values))):
        for i, v in reversed(list(enumerate(values))):
            quoted = "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
            x = x.replace(f":{i}", quoted)
        return F.expr(x)
    return x


def _compare(c: Column, op: str, v: object) -> Column:
    if isinstance(v, Column):
        return {"=": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
    if op in ("between", "not between") and any(isinstance(x, Column) for x in v):
        out = c.between(*v)
        return out if op == "between" else ~out
    return predicate(c, op, v)


def aggregated(m: Metric, s: TableSet) -> Column:
    """The aggregate of a raw metric in its query."""
    t, c, use = s.use(m.name)
    x = expression(t, c, use)
    if use.ds_formula and formulas.aggregates(use.ds_formula):
        return x
    if m.weighting_metric and m.aggregation == "mean":
        wt, wc, wuse = s.use(m.weighting_metric)
        w = expression(wt, wc, wuse).cast("double")
        return F.try_divide(F.sum(x.cast("double") * w), F.sum(w))
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.countDistinct}[m.aggregation](x)


def as_declared(c: Column, kind: T.DataType, declared: str | None) -> Column:
    """A dimension in its declared type, so that sources agree; metrics of exact decimals become doubles."""
    want = types.spark_type(declared) if declared else None
    if want is None or want == kind or isinstance(want, T.IntegralType) and isinstance(kind, T.IntegralType):
        return c
    if isinstance(kind, T.TimestampType) and isinstance(want, T.TimestampNTZType):
        return c
    return c.try_cast(want)


def run_query(q: Query, request: Request, semi: list[tuple]) -> DataFrame:
    """The aggregated rows of one query: raw dimensions and metrics by name. semi: (field, anti, frame) of sub-reports."""
    s = q.table_set
    df = joined(s)
    for name, op, value in request.criteria:
        if not op.endswith("report"):
            df = df.where(criterion(s, df, name, op, value))
    for i, (name, anti, keys) in enumerate(semi):
        x = expression(*s.use(name))
        key = keys.toDF(f"sub_report_key_{i}").alias(f"sub_report_{i}")
        if anti:
            df = df.where(x.isNotNull())
        df = df.join(key, x == F.col(f"sub_report_{i}.sub_report_key_{i}"), "left_anti" if anti else "left_semi")
    dims: list[Column] = []
    for d in request.raw_dimensions:
        x = expression(*s.use(d))
        f: Dimension = request.field(d)
        dims.append(as_declared(x, df.select(x.alias("x")).schema["x"].dataType, f.type).alias(d))
    if not q.metrics:
        return df.select(*dims).distinct()
    out = df.groupBy(*dims).agg(*[aggregated(request.field(m), s).alias(m) for m in q.metrics])
    exact = [f.name for f in out.schema.fields if f.name in q.metrics and isinstance(f.dataType, T.DecimalType | T.FloatType)]
    return out.withColumns({m: F.col(m).cast("double") for m in exact}) if exact else out
