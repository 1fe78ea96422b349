"""Reports: a request for metrics by dimensions, planned into one lazy DataFrame."""

from __future__ import annotations

import json
import time
from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.errors import InvalidDimensionValue, InvalidField, MaxReportDepth, ReportError
from lattica.operators import aggregate, combine, present, rollup
from lattica.operators.predicates import REPORT_OPS, check_criterion
from lattica.operators.technicals import apply_technical, output_columns
from lattica.plans import planner
from lattica.runtime import Execution

if TYPE_CHECKING:
    from lattica.warehouse import Warehouse

MAX_DEPTH = 3
VALUE_OPS = ("=", "!=", "in", "not in")
PARAMS = ("metrics", "dimensions", "criteria", "row_filters", "rollup", "pivot", "order_by", "limit", "limit_first", "allow_partial", "disabled_tables")


class Report:
    """One request. ``frame()`` is its lazy result, ``execute()`` wraps it with what was found on the way."""

    def __init__(
        self, warehouse: Warehouse, metrics: list | None = None, dimensions: list | None = None, criteria: list | None = None, row_filters: list | None = None,
        rollup: str | int | None = None, pivot: list[str] | None = None, order_by: list | None = None, limit: int | None = None, limit_first: bool = False,
        adhoc_datasources: list | None = None, allow_partial: bool = False, disabled_tables: list[str] | None = None, depth: int = 0,
    ):
        if depth > MAX_DEPTH:
            raise MaxReportDepth(f"more than {MAX_DEPTH} reports within each other")
        if not metrics and not dimensions:
            raise ReportError("a report needs metrics or dimensions")
        self.warehouse, self.spec_id, self.depth = warehouse, None, depth
        self.params = {
            "metrics": list(metrics or []), "dimensions": list(dimensions or []), "criteria": [list(c) for c in criteria or []], "row_filters": [list(f) for f in row_filters or []],
            "rollup": rollup, "pivot": pivot, "order_by": order_by, "limit": limit, "limit_first": limit_first, "allow_partial": allow_partial, "disabled_tables": disabled_tables,
        }
        self.sources = dict(warehouse.datasources) | {d.name: d for d in adhoc_datasources or []}
        fields = warehouse.field_scope(adhoc_datasources or [])
        self.warnings: list[str] = []

        chosen_m = [fields.get_metric(m) for m in metrics or []]
        chosen_d = [fields.get_dimension(d) for d in dimensions or []]
        names = [f.name for f in [*chosen_d, *chosen_m]]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ReportError(f"fields {twice} are requested twice")
        self.request = planner.Request({m.name: m for m in chosen_m}, {d.name: d for d in chosen_d}, [], fields.get_metrics(), fields.get_dimensions())
        self.sub_reports: list[tuple[str, bool, Report]] = []
        for c in criteria or []:
            self._add_criterion(fields, *check_criterion(c))
        self.dims = list(self.request.dimensions)
        self.rollup = rollup_checked = self._rollup(rollup)
        self.pivot = list(pivot or [])
        if bad := [p for p in self.pivot if p not in self.dims]:
            raise ReportError(f"pivot of {bad}, which are no dimensions of the report")
        self.order_by = [(o, "asc") if isinstance(o, str) else (o[0], str(o[1]).lower()) for o in order_by or []]
        for name, way in self.order_by:
            if name not in names or way not in ("asc", "desc"):
                raise ReportError(f"can't order by {name!r} {way}")
        if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or limit < 1):
            raise ReportError("limit is a positive number")
        if limit_first and not (limit or row_filters):
            raise ReportError("limit_first needs a limit or row filters")
        self.row_filters = [tuple(f) for f in row_filters or []]
        for f in self.row_filters:
            if len(f) != 3 or f[1] not in present_ops():
                raise ReportError(f"invalid row filter {f!r}")
        self.limit, self.limit_first = limit, limit_first
        self.request.expand()
        planner.check_required_grain(self.request)
        self.queries, self.lost = planner.plan(warehouse, self.sources, self.request, allow_partial, set(disabled_tables or ()))
        self.is_partial = bool(self.lost)
        self.warnings += [f"metric {m} is left out: {why}" for m, why in self.lost.items()]
        self._note_inexact()
        self.execution = Execution(warehouse.spark)
        assert rollup_checked == self.rollup

    def _note_inexact(self) -> None:
        """Warnings on values that are not what their aggregation says."""
        regrouped = not set(self.request.raw_dimensions) <= set(self.dims)
        for m, f in self.request.metrics.items():
            if f.aggregation == "count_distinct" and (regrouped or self.rollup is not None):
                self.warnings.append(f"distinct counts of {m} are summed over groups")
            if f.weighting_metric and f.formula and self.rollup is not None:
                self.warnings.append(f"rollups of {m} weigh the report's rows; rows without a value count in the weights only")

    def _rollup(self, value):
        return rollup.check_rollup(value, len(self.dims))

    def _add_criterion(self, fields, name: str, op: str, value: object) -> None:
        if isinstance(name, dict):
            raise ReportError("criteria take no ad hoc fields")
        try:
            f = fields.get_dimension(name)
        except InvalidField as e:
            raise ReportError(f"criteria: {e}") from None
        if f.formula:
            raise ReportError(f"criteria take no formula fields such as {name}")
        if op in REPORT_OPS:
            if isinstance(value, Report):
                sub = Report(self.warehouse, **{k: v for k, v in value.params.items()}, depth=self.depth + 1)
            elif isinstance(value, dict):
                sub = Report(self.warehouse, **value, depth=self.depth + 1)
            else:
                sub = Report(self.warehouse, **self.warehouse.report_params(value), depth=self.depth + 1)
            if name not in sub.request.dimensions:
                raise ReportError(f"the sub-report has no dimension {name}")
            self.sub_reports.append((name, op == "not in report", sub))
            self.request.criteria.append((name, op, None))
            return
        values = self.warehouse.allowed_values(f)
        if values is not None and op in VALUE_OPS:
            bad = [v for v in (value if isinstance(value, list | tuple | set) else [value]) if v is not None and v not in values]
            if bad:
                raise InvalidDimensionValue(f"{name} has no values {bad}")
        self.request.criteria.append((name, op, value))

    # Result

    @cached_property
    def _metrics(self) -> list[str]:
        gone = set(self.lost)
        return [m for m in [*self.request.metrics, *self.request.hidden] if not gone & set(self.request.expansion(m)[1])]

    def frame(self) -> DataFrame:
        """The lazy result: dimensions, metrics, and rollup_level if there are rollups."""
        r = self.request
        self._messages = list(self.warnings)
        semi = [(name, anti, self._keys(sub, name)) for name, anti, sub in self.sub_reports]
        frames = [aggregate.run_query(q, r, semi) for q in self.queries]
        raw = [m for q in self.queries for m in q.metrics]
        df = combine.final_rows(combine.merged(frames, r.raw_dimensions, raw), r, self._metrics)
        fields = {m: r.field(m) for m in self._metrics}
        for m, f in fields.items():
            if f.technical:
                df = apply_technical(df, m, f.technical, self.dims)
        keys = {d: present.sort_key(f, self.warehouse.allowed_values(f)) for d, f in r.dimensions.items() if f.sorter}
        if self.limit_first:
            df = present.filtered(df, self.row_filters, self._messages)
            if self.limit:
                df = df.orderBy(*present.order_columns(df, [], self.dims, {})).limit(self.limit) if self.dims else df.limit(self.limit)
        if self.rollup is not None:
            df = rollup.with_rollups(df, self.rollup, self.dims, fields)
        hidden = [m for m in r.hidden if m in df.columns and m not in r.metrics]
        df = df.drop(*hidden)
        shown = {m: f for m, f in fields.items() if m not in hidden}
        df = present.rounded(df, shown)
        columns = [*self.dims, *[c for m, f in shown.items() for c in (output_columns(m, f.technical) if f.technical else [m])]]
        df = df.select(*[f"`{c}`" for c in columns], *([rollup.LEVEL] if self.rollup is not None else []))
        if not self.limit_first:
            df = present.filtered(df, self.row_filters, self._messages)
        if self.limit and not self.limit_first:
            df = self._ordered(df, keys).limit(self.limit)
        if self.pivot:
            metrics = [c for c in columns if c not in self.dims]
            return present.pivoted(df, self.pivot, self.dims, metrics, {d: self.warehouse.allowed_values(f) for d, f in r.dimensions.items()})
        return self._ordered(df, keys)

    def _ordered(self, df: DataFrame, keys: dict) -> DataFrame:
        columns = present.order_columns(df, self.order_by, self.dims, keys)
        return df.orderBy(*columns) if columns else df

    @staticmethod
    def _keys(sub: Report, name: str) -> DataFrame:
        df = sub.unordered()
        if rollup.LEVEL in df.columns:
            df = df.where(~present.rolled_up(df, sub.dims, name))
        return df.select(F.col(f"`{name}`")).where(F.col(f"`{name}`").isNotNull()).distinct()

    def unordered(self) -> DataFrame:
        """The result without its last sort, for use within another plan; a limit keeps its order."""
        df = self.frame()
        return df

    def execute(self, timeout: float | None = None) -> ReportResult:
        """The result, still lazy: jobs run when its rows are asked for, each within timeout seconds."""
        start = time.time()
        df = self.frame()
        return ReportResult(self, df, time.time() - start, timeout if timeout is not None else self.warehouse.timeout)

    def kill(self) -> bool:
        return self.execution.kill()

    # Parameters

    def get_params(self) -> dict:
        return {k: v for k, v in self.params.items() if v not in (None, [], False)}

    def get_json(self) -> str:
        return json.dumps(self.get_params())

    def get_grain(self) -> list[str]:
        return self.request.grain

    def get_dimension_grain(self) -> list[str]:
        return self.request.raw_dimensions

    def save(self, meta: dict | None = None) -> int:
        self.spec_id = self.warehouse.save_report(meta=meta, **self.get_params())
        return self.spec_id


def present_ops() -> tuple[str, ...]:
    from lattica.operators.predicates import ROW_OPS

    return ROW_OPS


class ReportResult:
    """A report's rows and what is known about them. ``df`` is lazy; other methods run jobs that can be killed or time out."""

    def __init__(self, report: Report, df: DataFrame, duration: float, timeout: float | None):
        self.report, self.df, self.duration, self.timeout = report, df, duration, timeout
        self.is_partial, self.unsupported_metrics, self.warnings = report.is_partial, dict(report.lost), list(report._messages)
        self.query_summaries = [f"{q.table_set.datasource.name}: {' + '.join(q.table_set.tables)} for {', '.join(q.metrics) or 'dimensions'}" for q in report.queries]

    @property
    def plan(self) -> str:
        """The physical plan, as of now."""
        return self.df._jdf.queryExecution().executedPlan().toString()

    def _run(self, action):
        return self.report.execution.run(action, self.timeout, f"Report: {', '.join(self.report.request.metrics) or 'dimensions'} | queries: {len(self.report.queries)}")

    @cached_property
    def rows(self) -> list:
        return self._run(self.df.collect)

    def to_pandas(self):
        return self._run(self.df.toPandas)

    @property
    def rowcount(self) -> int:
        return self._run(self.df.count)

    @property
    def display_name_map(self) -> dict[str, str]:
        out = {}
        for c in self.df.columns:
            base = next((b for b in (c, c.removesuffix("_lower"), c.removesuffix("_upper")) if self.report.request.field(b)), None)
            if base:
                out[c] = self.report.request.field(base).shown_as + {"_lower": " Lower", "_upper": " Upper"}.get(c[len(base) :], "")
        return out

    @property
    def df_display(self) -> DataFrame:
        return present.displayed(self.df, self.report.dims, self.display_name_map)

    @property
    def rollup_mask(self):
        return F.col(rollup.LEVEL) > 0 if rollup.LEVEL in self.df.columns else F.lit(False)

    @property
    def rollup_rows(self) -> DataFrame:
        return self.df.where(self.rollup_mask)

    @property
    def non_rollup_rows(self) -> DataFrame:
        return self.df.where(~self.rollup_mask)
