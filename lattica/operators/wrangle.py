"""Combining the results of several reports, and small steps on a result."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.errors import QuestionError

STRATEGIES = ("auto", "separate", "concat_rows", "merge", "join_on_index")
FILTERS = ("=", "!=", ">", ">=", "<", "<=", "in", "not in")


def _outer(left: DataFrame, right: DataFrame, on: list[str], i: int) -> DataFrame:
    """Null-safe full outer join on columns; other columns that both have get the report's number on the right."""
    right = right.withColumnsRenamed({c: f"report_{i}_{c}" for c in right.columns if c not in on and c in left.columns})
    keys = {c: f"right_key_{c}" for c in on}
    right = right.withColumnsRenamed(keys)
    both = left.join(right, functools.reduce(operator.and_, [left[c].eqNullSafe(right[k]) for c, k in keys.items()]), "full")
    return both.select(*[F.coalesce(left[c], right[keys[c]]).alias(c) for c in on], *[left[c] for c in left.columns if c not in on], *[right[c] for c in right.columns if c not in keys.values()])


def merge(frames: list[DataFrame], on: list[str]) -> DataFrame:
    if not on or any(c not in f.columns for f in frames for c in on):
        raise QuestionError(f"not all results have columns {on}")
    out = frames[0]
    for i, f in enumerate(frames[1:], 2):
        out = _outer(out, f, on, i)
    return out


def join_on_index(frames: list[DataFrame], dims: list[list[str]]) -> DataFrame:
    if any(d != dims[0] for d in dims):
        raise QuestionError("the results differ in dimensions")
    return merge(frames, dims[0])


def concat_rows(frames: list[DataFrame]) -> DataFrame:
    marked = [f.select(F.lit(i).alias("report_index"), *f.columns) for i, f in enumerate(frames, 1)]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def combine(frames: list[DataFrame], dims: list[list[str]], strategy: str = "auto", on: list[str] | None = None) -> DataFrame | dict[str, DataFrame]:
    if strategy not in STRATEGIES:
        raise QuestionError(f"unknown strategy {strategy!r}")
    if len(frames) == 1:
        return frames[0]
    if strategy == "separate":
        return {f"report_{i}": f for i, f in enumerate(frames, 1)}
    if strategy == "concat_rows":
        return concat_rows(frames)
    if strategy == "join_on_index":
        return join_on_index(frames, dims)
    keys = on or [c for c in dims[0] if all(c in d for d in dims)]
    if strategy == "merge" or keys:
        return merge(frames, keys)
    return join_on_index(frames, dims) if all(d == dims[0] and d for d in dims) else concat_rows(frames)


def apply(df: DataFrame, steps: list[dict]) -> DataFrame:
    """select_columns, rename_columns, sort_values, fillna and filter_rows, one after another."""
    for s in steps:
        op = s.get("op")
        if op == "select_columns":
            df = df.select(*[F.col(f"`{c}`") for c in s["columns"]])
        elif op == "rename_columns":
            df = df.withColumnsRenamed(s["columns"])
        elif op == "sort_values":
            up = s.get("ascending", True)
            ups = up if isinstance(up, list) else [up] * len(s["by"])
            df = df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() if u else F.col(f"`{c}`").desc_nulls_last() for c, u in zip(s["by"], ups, strict=True)])
        elif op == "fillna":
            df = df.fillna(s["value"], subset=s.get("columns"))
        elif op == "filter_rows":
            df = df.where(_filter(F.col(f"`{s['column']}`"), s["operator"], s["value"]))
        else:
            raise QuestionError(f"unknown step {op!r}")
    return df


def _filter(c, op: str, v: object):
    if op not in FILTERS:
        raise QuestionError(f"unknown filter {op!r}")
    if op == "in":
        return c.isin(list(v))
    if op == "not in":
        return ~F.coalesce(c.isin(list(v)), F.lit(False))
    if op == "!=":
        return ~c.eqNullSafe(F.lit(v))
    return {"=": c == v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
