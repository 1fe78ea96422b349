"""The combined layer: rows of all queries merged by dimension, then formulas, and a second grouping where dimensions need one."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import formulas
from lattica.model import Metric
from lattica.plans.planner import Request


def merged(frames: list[DataFrame], dims: list[str], metrics: list[str]) -> DataFrame:
    """A null-safe full outer merge on the dimensions: a union grouped once, first non-null value of each metric."""
    if len(frames) == 1:
        return frames[0]
    out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    firsts = [F.first(m, ignorenulls=True).alias(m) for m in metrics]
    return out.groupBy(*dims).agg(*firsts)


def bound(request: Request, name: str) -> Column:
    """A field's expression over the merged columns."""
    f = request.field(name)
    text, _ = request.expansion(name)
    if f.formula is None:
        c = F.col(f"`{name}`")
        return F.coalesce(c, F.lit(f.ifnull)) if isinstance(f, Metric) and f.ifnull is not None else c

    def column(raw: str) -> str:
        return raw

    for raw in formulas.references(text):
        r = request.field(raw)
        if isinstance(r, Metric) and r.ifnull is not None:
            text = text.replace(f"{{{raw}}}", f"ifnull({{{raw}}}, {r.ifnull!r})")
    return F.expr(formulas.bound(text, column))


def _number(df: DataFrame, c: Column) -> Column:
    """Truth values as 0 and 1, exact decimals as doubles."""
    kind = df.select(c.alias("x")).schema["x"].dataType
    if isinstance(kind, T.BooleanType):
        return c.cast("int")
    if isinstance(kind, T.DecimalType | T.FloatType):
        return c.cast("double")
    return c


def final_rows(df: DataFrame, request: Request, metrics: list[str]) -> DataFrame:
    """Requested dimensions and metrics (with hidden weights) from merged rows."""
    dims = list(request.dimensions)
    lossless = set(request.raw_dimensions) <= set(dims)
    d_cols = {d: _number(df, bound(request, d)) for d in dims}
    m_cols = {m: bound(request, m) for m in metrics}
    weights = {m: bound(request, request.field(m).weighting_metric) for m in metrics if request.field(m).weighting_metric}
    if lossless:
        # each group is one row: aggregates are the values themselves
        out = {}
        for m, c in m_cols.items():
            f = request.field(m)
            if f.aggregation == "mean" and m in weights:
                c = F.try_divide(c.cast("double") * weights[m], weights[m])
            elif f.aggregation == "mean":
                c = c.cast("double")
            out[m] = _number(df, c)
        return df.select(*[c.alias(d) for d, c in d_cols.items()], *[c.alias(m) for m, c in out.items()])
    aggs = []
    for m, c in m_cols.items():
        f, c = request.field(m), _number(df, c)
        if f.aggregation == "mean" and m in weights:
            w = _number(df, weights[m])
            a = F.try_divide(F.sum(c.cast("double") * w), F.sum(w))
        else:
            a = {"mean": lambda c: F.avg(c.cast("double")), "min": F.min, "max": F.max}.get(f.aggregation, F.sum)(c)
        aggs.append(a.alias(m))
    named = [c.alias(d) for d, c in d_cols.items()]
    return df.groupBy(*named).agg(*aggs) if aggs else df.select(*named).distinct()
