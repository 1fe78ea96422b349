"""The last steps of a report: rounding, order, row filters, limit, pivot, display names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.errors import ReportError
from lattica.model import Dimension, Metric
from lattica.operators.predicates import row_filter
from lattica.operators.rollup import LEVEL, MARK
from lattica.operators.technicals import output_columns


def rounded(df: DataFrame, metrics: dict[str, Metric]) -> DataFrame:
    """Metrics at their number of digits, halves to even."""
    put = {}
    for m, f in metrics.items():
        if f.rounding is None:
            continue
        for c in output_columns(m, f.technical) if f.technical else [m]:
            if isinstance(df.schema[c].dataType, T.DoubleType):
                put[c] = F.bround(F.col(f"`{c}`"), f.rounding)
    return df.withColumns(put) if put else df


def rolled_up(df: DataFrame, dims: list[str], d: str) -> Column:
    """Whether a dimension is rolled up in a row."""
    return F.col(LEVEL) >= len(dims) - dims.index(d) if LEVEL in df.columns else F.lit(False)


def value_order(c: Column, values: list) -> Column:
    """The place of a value in a list; unknown ones come after."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(c.isNull(), F.lit(None)).when(at == 0, F.lit(len(values) + 1)).otherwise(at)


def sort_key(d: Dimension, values: list | None) -> Callable[[Column], Column]:
    from lattica.config import imported

    s = d.sorter
    if s is None:
        return lambda c: c
    if isinstance(s, str):
        if s == "values" or s.endswith("sort_by_value_order"):
            if not values:
                raise ReportError(f"dimension {d.name} is sorted by values but has none")
            return lambda c: value_order(c, values)
        s = imported(s)
    return lambda c: s(d.name, c)


def order_columns(df: DataFrame, order_by: list[tuple[str, str]], dims: list[str], keys: dict[str, Callable[[Column], Column]]) -> list[Column]:
    """Sort columns of a request, all dimensions after them so that no order is left to chance."""
    out: list[Column] = []
    for name, way in [*order_by, *((d, "asc") for d in dims if d not in [o[0] for o in order_by])]:
        down = way == "desc"
        if name in dims:
            if LEVEL in df.columns:
                flag = rolled_up(df, dims, name)
                out.append(flag.desc() if down else flag.asc())
            c = keys.get(name, lambda c: c)(F.col(f"`{name}`"))
        else:
            c = F.col(f"`{name}`")
        out.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return out


def filtered(df: DataFrame, row_filters: list[tuple], warnings: list[str]) -> DataFrame:
    for name, op, value in row_filters:
        if name not in df.columns:
            warnings.append(f"row filter on {name!r} is left out: no such field in the result")
            continue
        df = df.where(row_filter(F.col(f"`{name}`"), op, value, df.schema[name].dataType))
    return df


def pivoted(df: DataFrame, pivot: list[str], dims: list[str], metrics: list[str], values: dict[str, list | None]) -> DataFrame:
    """Dimensions as columns: <metric>_<value>, of several dimensions <value>|<value>."""
    text = [F.when(rolled_up(df, dims, d), F.lit(MARK)).otherwise(F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("null"))) for d in pivot]
    key = "pivot_key"
    while key in df.columns:
        key += "_"
    rest = [d for d in dims if d not in pivot] + ([LEVEL] if LEVEL in df.columns and len(pivot) < len(dims) else [])
    known = [str(v) for v in values[pivot[0]]] if len(pivot) == 1 and values.get(pivot[0]) and LEVEL not in df.columns else None
    grouped = df.withColumn(key, F.concat_ws("|", *text)).groupBy(*rest).pivot(key, known)
    out = grouped.agg(*[F.first(f"`{m}`", ignorenulls=True).alias(m) for m in metrics])
    if len(metrics) == 1:
        return out.toDF(*[c if c in rest else f"{metrics[0]}_{c}" for c in out.columns])
    names = []
    for c in out.columns:
        m = next((m for m in sorted(metrics, key=len, reverse=True) if c.endswith(f"_{m}")), None)
        names.append(c if c in rest or m is None else f"{m}_{c[: -len(m) - 1]}")
    return out.toDF(*names)


def displayed(df: DataFrame, dims: list[str], names: dict[str, str]) -> DataFrame:
    """Columns under display names; rolled-up dimensions show the mark."""
    out = []
    for c in df.columns:
        if c == LEVEL:
            continue
        x = F.col(f"`{c}`")
        if c in dims and LEVEL in df.columns:
            x = F.when(rolled_up(df, dims, c), F.lit(MARK)).otherwise(x.cast("string"))
        out.append(x.alias(names.get(c, c)))
    return df.select(*out)
