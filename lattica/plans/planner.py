"""From a request's fields to queries: which table set answers which metrics."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from lattica.errors import ReportError, UnsupportedGrain
from lattica.functions import formulas
from lattica.model import Dimension, Metric
from lattica.plans.graph import TableSet
from lattica.plans.limits import limits_met

if TYPE_CHECKING:
    from lattica.warehouse import Warehouse


@dataclass
class Query:
    """One aggregation over one table set."""

    table_set: TableSet
    metrics: list[str] = field(default_factory=list)

    def covers(self, metric: str, request: Request) -> bool:
        """Whether its base table has the metric, in a column that the request's dimensions suffice for."""
        uses = self.table_set.base.uses()
        return metric in uses and set(uses[metric][0].required_grain or []) <= set(request.raw_dimensions)


@dataclass
class Request:
    """All fields of a report by name, ad hoc ones included, and what is needed of the sources."""

    metrics: dict[str, Metric]
    dimensions: dict[str, Dimension]
    criteria: list[tuple]
    known_metrics: dict[str, Metric]
    known_dimensions: dict[str, Dimension]
    raw_metrics: list[str] = field(default_factory=list)
    raw_dimensions: list[str] = field(default_factory=list)
    hidden: list[str] = field(default_factory=list)

    def field(self, name: str) -> Metric | Dimension | None:
        return self.metrics.get(name) or self.dimensions.get(name) or self.known_metrics.get(name) or self.known_dimensions.get(name)

    def formula_of(self, name: str) -> str | None:
        f = self.field(name)
        if f is None:
            raise ReportError(f"formula refers to unknown field {name!r}")
        return f.formula

    def expansion(self, name: str) -> tuple[str, list[str]]:
        return formulas.expanded(name, self.formula_of)

    def is_metric(self, name: str) -> bool:
        return isinstance(self.field(name), Metric)

    def expand(self) -> None:
        """Find the raw fields that the request needs, weights included."""
        raw_m: dict[str, None] = {}
        raw_d: dict[str, None] = {}

        def visit(name: str, of_dimension: bool) -> None:
            for raw in self.expansion(name)[1]:
                if self.is_metric(raw):
                    if of_dimension:
                        raise ReportError(f"dimension {name} has metric {raw} in its formula")
                    if self.field(raw).technical and raw != name:
                        raise ReportError(f"formula of {name} refers to {raw}, which has a technical")
                    raw_m[raw] = None
                else:
                    raw_d[raw] = None
            weight = getattr(self.field(name), "weighting_metric", None)
            if weight:
                if weight not in self.metrics and weight not in self.hidden:
                    self.hidden.append(weight)
                visit(weight, False)

        for d in self.dimensions:
            visit(d, True)
        for m in self.metrics:
            visit(m, False)
        self.raw_metrics, self.raw_dimensions = list(raw_m), list(raw_d)

    @property
    def grain(self) -> list[str]:
        """Raw dimensions of dimensions, formulas and criteria."""
        return list(dict.fromkeys([*self.raw_dimensions, *(c[0] for c in self.criteria)]))


def check_required_grain(request: Request) -> None:
    have = set(request.raw_dimensions) | set(request.dimensions)
    needed: dict[str, list[str]] = {}
    for m in [*request.metrics, *request.raw_metrics]:
        if (g := getattr(request.field(m), "required_grain", None)) and (lack := [d for d in g if d not in have]):
            needed[m] = lack
    if needed:
        raise UnsupportedGrain("; ".join(f"metric {m} requires dimensions {d}" for m, d in needed.items()))


def candidates(warehouse: Warehouse, datasource, name: str, request: Request, table_type: str | None, disabled: set[str]) -> list[TableSet]:
    """Table sets of a datasource with a base table that provides the field and isn't disabled; joins may use disabled tables."""
    out = []
    for t in datasource.get_tables_with_field(name, table_type):
        if disabled & {t.name, f"{datasource.name}.{t.name}"}:
            continue
        required = t.uses()[name][0].required_grain
        if required and not set(required) <= set(request.raw_dimensions):
            continue
        found = datasource.join_for(t, request.grain, warehouse.max_join_candidates, warehouse.max_joins)
        if found and limits_met(found, request.criteria):
            out.append(found)
    return out


def best(warehouse: Warehouse, found: dict[str, list[TableSet]]) -> TableSet | None:
    """The first datasource by priority, then the lowest table priority, then the fewest tables."""
    for ds in warehouse.datasource_order(found):
        if found[ds]:
            return min(found[ds], key=lambda s: (s.base.priority, len(s)))
    return None


def metric_table_set(warehouse: Warehouse, sources: dict, name: str, request: Request, disabled: set[str]) -> TableSet:
    found = {n: candidates(warehouse, ds, name, request, "metric", disabled) + ([] if ds.get_tables_with_field(name, "metric") else candidates(warehouse, ds, name, request, "dimension", disabled)) for n, ds in sources.items()}
    out = best(warehouse, found)
    if out is None:
        raise UnsupportedGrain(f"metric {name} can't meet grain {request.grain or '(none)'}")
    return out


def dimension_table_set(warehouse: Warehouse, sources: dict, request: Request, disabled: set[str]) -> TableSet:
    """A table set for dimensions alone: over a dimension table, or else over a metric table."""
    grain = request.grain
    for kind in ("dimension", "metric"):
        found: dict[str, list[TableSet]] = {}
        for n, ds in sources.items():
            sets = [s for d in grain for s in candidates(warehouse, ds, d, request, kind, disabled)]
            found[n] = sorted(sets, key=len)
        if out := best(warehouse, found):
            return out
    raise UnsupportedGrain(f"no tables provide dimensions {grain}")


def plan(warehouse: Warehouse, sources: dict, request: Request, allow_partial: bool = False, disabled: set[str] | None = None) -> tuple[list[Query], dict[str, str]]:
    """Queries for all raw metrics; metrics that can't be had, and why, if partial reports are allowed."""
    disabled = disabled or set()
    queries: list[Query] = []
    lost: dict[str, str] = {}
    if not request.raw_metrics:
        return [Query(dimension_table_set(warehouse, sources, request, disabled))], lost
    for m in request.raw_metrics:
        if q := next((q for q in queries if q.covers(m, request)), None):
            q.metrics.append(m)
            continue
        try:
            queries.append(Query(metric_table_set(warehouse, sources, m, request, disabled), [m]))
        except UnsupportedGrain as e:
            lost[m] = str(e)
    if lost and (not allow_partial or not queries):
        raise UnsupportedGrain("; ".join(lost.values()))
    return queries, lost
