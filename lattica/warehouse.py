"""Warehouses: datasources with shared fields, and the entry point of requests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from lattica.config import imported, load_warehouse_config, settings
from lattica.datasource import AdHocTable, DataSource, FieldManager
from lattica.errors import InvalidField, LatticaError, ReportError, WarehouseError
from lattica.functions import formulas
from lattica.model import Dimension, Metric
from lattica.plans import planner
from lattica.plans.graph import TableSet
from lattica.report import Report, ReportResult
from lattica.store import Store


class _Scope(FieldManager):
    """The fields of a warehouse and of datasources given with one request."""

    def __init__(self, warehouse: Warehouse, extra: Iterable[DataSource]):
        self.metrics, self.dimensions, self.parts = {}, {}, [warehouse, *extra]

    def _children(self) -> list[FieldManager]:
        return self.parts


class Warehouse(FieldManager):
    """Datasources in order of declaration; ``ds_priority`` names them in order of preference."""

    def __init__(self, spark: SparkSession, config: dict | str | None = None, datasources: list[DataSource] | None = None, ds_priority: list[str] | None = None, frames: dict[str, dict] | None = None, store: str | None = None, check: bool = True):
        self.spark, self.settings = spark, settings()
        self.config_source = config
        config = load_warehouse_config(config or {})
        self.meta, self.ds_priority, self.id = config.get("meta"), list(ds_priority or []), None
        self._declare(config["metrics"], config.get("dimensions") or [])
        self.datasources: dict[str, DataSource] = {d.name: d for d in datasources or []}
        self.frames = frames or {}
        for name, c in config["datasources"].items():
            self.datasources[name] = self._made(name, c)
        if unknown := set(self.ds_priority) - set(self.datasources):
            raise WarehouseError(f"ds_priority names unknown datasources {sorted(unknown)}")
        self.max_joins, self.max_join_candidates = self.settings["MAX_JOINS"], self.settings["MAX_JOIN_CANDIDATES"]
        self.timeout = self.settings["QUERY_TIMEOUT"]
        self.store = Store(store or self.settings["STORE_DIRECTORY"])
        self._supported: dict = {}
        if check:
            self.run_integrity_checks()

    def _made(self, name: str, config: dict) -> DataSource:
        return DataSource(self.spark, name, config, self.frames.get(name), self.settings["DATASOURCE_CONTEXTS"], self.settings["ADHOC_DIRECTORY"], [*self.metrics, *self.dimensions])

    def _children(self) -> list[FieldManager]:
        return list(self.datasources.values())

    def field_scope(self, extra: list[DataSource]) -> FieldManager:
        return _Scope(self, extra) if extra else self

    def apply_config(self, config: dict | str) -> None:
        """Add the fields and datasources of another configuration."""
        config = load_warehouse_config(config)
        from lattica.config import make_dimension, make_metric

        for m in config["metrics"]:
            self.add_metric(make_metric(m))
        for d in config.get("dimensions") or []:
            self.add_dimension(make_dimension(d))
        for name, c in config["datasources"].items():
            self.add_datasource(self._made(name, c))

    def add_datasource(self, ds: DataSource, check: bool = True) -> None:
        if ds.name in self.datasources:
            raise WarehouseError(f"datasource {ds.name} exists")
        self.datasources[ds.name] = ds
        self._supported = {}
        if check:
            self.run_integrity_checks()

    def remove_datasource(self, name: str) -> None:
        del self.datasources[name]
        self._supported = {}

    def get_datasource(self, name: str) -> DataSource:
        if name not in self.datasources:
            raise WarehouseError(f"no datasource {name!r}")
        return self.datasources[name]

    def datasource_order(self, names: Iterable[str]) -> list[str]:
        names = list(names)
        return [*(n for n in names if n not in self.ds_priority and n not in self.datasources), *(n for n in self.ds_priority if n in names), *(n for n in names if n in self.datasources and n not in self.ds_priority)]

    def allowed_values(self, d: Dimension) -> list | None:
        v = d.values
        if isinstance(v, str):
            v = imported(v)
        if callable(v):
            v = v(self.id, d)
        if v is None and (stored := self.store.values(self.id, d.name)):
            v = stored
        return None if v is None else list(v)

    # Requests

    def report(self, **params) -> Report:
        return Report(self, **params)

    def execute(self, metrics: list | None = None, dimensions: list | None = None, timeout: float | None = None, **params) -> ReportResult:
        return Report(self, metrics, dimensions, **params).execute(timeout)

    def execute_id(self, spec_id: int, timeout: float | None = None) -> ReportResult:
        return self.load_report(spec_id).execute(timeout)

    def report_params(self, spec_id: int) -> dict:
        return self.store.load_report(spec_id)["params"]

    def save_report(self, meta: dict | None = None, **params) -> int:
        Report(self, **params)
        sources = sorted({q.table_set.datasource.name for q in Report(self, **params).queries})
        return self.store.save_report(self.id, params, (meta or {}) | {"datasources": sources})

    def load_report(self, spec_id: int) -> Report:
        spec = self.store.load_report(spec_id)
        if lack := set((spec.get("meta") or {}).get("datasources", [])) - set(self.datasources):
            raise ReportError(f"report {spec_id} needs datasources {sorted(lack)}")
        out = Report(self, **spec["params"])
        out.spec_id = spec_id
        return out

    def delete_report(self, spec_id: int) -> None:
        self.store.delete_report(spec_id)

    # Storage

    def save(self, name: str, config_url: str | None = None, meta: dict | None = None) -> int:
        source = config_url or (self.config_source if isinstance(self.config_source, str) else None)
        if not source:
            raise WarehouseError("a warehouse is saved by the path or URL of its configuration")
        self.id = self.store.save_warehouse(name, {"config": source, "ds_priority": self.ds_priority}, meta)
        return self.id

    @classmethod
    def load(cls, spark: SparkSession, warehouse_id: int, store: str | None = None) -> Warehouse:
        record = Store(store or settings()["STORE_DIRECTORY"]).load_warehouse(warehouse_id)
        out = cls(spark, record["params"]["config"], ds_priority=record["params"]["ds_priority"], store=store)
        out.id = warehouse_id
        return out

    @classmethod
    def delete(cls, warehouse_id: int, store: str | None = None) -> None:
        Store(store or settings()["STORE_DIRECTORY"]).delete_warehouse(warehouse_id)

    @classmethod
    def load_warehouse_for_report(cls, spark: SparkSession, spec_id: int, store: str | None = None) -> Warehouse:
        return cls.load(spark, Store(store or settings()["STORE_DIRECTORY"]).load_report(spec_id)["warehouse_id"], store)

    @classmethod
    def load_report_and_warehouse(cls, spark: SparkSession, spec_id: int, store: str | None = None) -> tuple[Report, Warehouse]:
        w = cls.load_warehouse_for_report(spark, spec_id, store)
        return w.load_report(spec_id), w

    @classmethod
    def from_data_file(cls, spark: SparkSession, url: str, primary_key: list[str], ds_name: str = "data", **kw) -> Warehouse:
        return cls(spark, datasources=[DataSource.from_data_file(spark, ds_name, url, primary_key, **kw)])

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: list[AdHocTable], ds_name: str = "data", config: dict | None = None) -> Warehouse:
        declared = [f["name"] for key in ("metrics", "dimensions") for f in load_warehouse_config(config or {}).get(key) or []]
        return cls(spark, config, datasources=[DataSource.from_tables(spark, ds_name, tables, declared=declared)])

    @classmethod
    def from_db_file(cls, spark: SparkSession, path: str, config: dict | None = None, ds_name: str = "data") -> Warehouse:
        return cls(spark, datasources=[DataSource.from_db_file(spark, ds_name, path, config)])

    # Planning

    def _request(self, metrics: list[str], dimensions: list[str], criteria: list) -> planner.Request:
        r = planner.Request({m: self.get_metric(m) for m in metrics}, {d: self.get_dimension(d) for d in dimensions}, [tuple(c) for c in criteria], self.get_metrics(), self.get_dimensions())
        r.expand()
        return r

    def get_metric_table_set(self, metric: str, dimensions: list[str], criteria: list = (), disabled_tables: list[str] = ()) -> TableSet:
        return planner.metric_table_set(self, self.datasources, metric, self._request([metric], list(dimensions), list(criteria)), set(disabled_tables))

    def get_dimension_table_set(self, dimensions: list[str], criteria: list = (), disabled_tables: list[str] = ()) -> TableSet:
        return planner.dimension_table_set(self, self.datasources, self._request([], list(dimensions), list(criteria)), set(disabled_tables))

    def supported_dimensions(self, metrics: list[str]) -> set[str]:
        """Raw dimensions that every metric can be asked by."""
        out: set[str] | None = None
        for m in self._request(metrics, [], []).raw_metrics:
            if m not in self._supported:
                found: set[str] = set()
                for ds in self.datasources.values():
                    for t in ds.get_tables_with_field(m):
                        for name in planner_reach(ds, t.name):
                            found |= {f for f in ds.tables[name].uses() if self.has_dimension(f)}
                self._supported[m] = found
            out = self._supported[m] if out is None else out & self._supported[m]
        return out or set()

    # Checks

    def run_integrity_checks(self) -> None:
        """All findings in one WarehouseError."""
        bad: list[str] = []
        metrics, dimensions = self.get_metrics(), self.get_dimensions()
        for n in set(metrics) & set(dimensions):
            bad.append(f"{n} is both metric and dimension")
        fields = dimensions | metrics
        lower: dict[str, str] = {}
        for n in fields:
            if lower.setdefault(n.lower(), n) != n:
                bad.append(f"fields {lower[n.lower()]} and {n} differ by case only")
        for n, f in fields.items():
            if f.formula:
                try:
                    _, raw = formulas.expanded(n, lambda x: self._formula(fields, x))
                    if isinstance(f, Dimension) and (m := [x for x in raw if x in metrics]):
                        bad.append(f"dimension {n} has metrics {m} in its formula")
                    for x in raw:
                        if x != n and getattr(fields[x], "technical", None):
                            bad.append(f"formula of {n} refers to {x}, which has a technical")
                except LatticaError as e:
                    bad.append(f"{n}: {e}")
            for x in [*(getattr(f, "required_grain", None) or [])]:
                if x not in dimensions:
                    bad.append(f"{n} requires unknown dimension {x}")
            w = getattr(f, "weighting_metric", None)
            if w and w not in metrics:
                bad.append(f"{n} is weighted by unknown metric {w}")
        for ds in self.datasources.values():
            for t in ds.tables.values():
                bad += self._table_problems(ds, t, metrics, dimensions)
        if bad:
            raise WarehouseError("; ".join(bad), bad)

    @staticmethod
    def _formula(fields: dict, name: str) -> str | None:
        if name not in fields:
            raise InvalidField(f"no field {name!r}")
        return fields[name].formula

    def _table_problems(self, ds: DataSource, t, metrics: dict[str, Metric], dimensions: dict[str, Dimension]) -> list[str]:
        bad, where, uses = [], f"table {ds.name}.{t.name}", t.uses()
        seen: dict[str, str] = {}
        for c in t.columns.values():
            for u in c.fields if c.active else []:
                if seen.setdefault(u.name, c.name) != c.name:
                    bad.append(f"{where}: {u.name} is provided by two columns")
                if u.name not in metrics and u.name not in dimensions:
                    bad.append(f"{where}: column {c.name} has undeclared field {u.name}")
                if u.ds_formula:
                    try:
                        formulas.check(u.ds_formula)
                    except LatticaError as e:
                        bad.append(f"{where}: {e}")
        for k in t.primary_key:
            if k not in uses:
                bad.append(f"{where} lacks its key field {k}")
            elif k not in dimensions:
                bad.append(f"{where}: key field {k} is no dimension")
        if t.parent and t.parent in ds.tables and ds.tables[t.parent].type != t.type:
            bad.append(f"{where} and its parent differ in type")
        if t.type == "dimension":
            bad += [f"{where}: dimension tables have no metrics, but {n}" for n in uses if n in metrics and n not in dimensions]
        for n, (c, u) in uses.items():
            m = metrics.get(n)
            if m and m.weighting_metric and m.aggregation == "mean" and not (u.ds_formula and formulas.aggregates(u.ds_formula)) and m.weighting_metric not in uses:
                bad.append(f"{where} has {n} but not its weight {m.weighting_metric}")
            if u.ds_formula and n in dimensions and n not in metrics and formulas.aggregates(u.ds_formula):
                bad.append(f"{where}: dimension {n} is aggregated")
            bad += [f"{where}: {c.name} requires unknown dimension {g}" for g in c.required_grain or [] if g not in dimensions]
        for limit in t.criteria_limits or []:
            if limit[0] not in dimensions:
                bad.append(f"{where}: criteria limit on unknown dimension {limit[0]}")
        return bad

    def print_info(self) -> None:
        for ds in self.datasources.values():
            print(f"datasource {ds.name}")
            for t in ds.tables.values():
                print(f"  {t.type} table {t.name} (key {', '.join(t.primary_key)}): {', '.join(sorted(t.uses()))}")
        print(f"metrics: {', '.join(sorted(self.get_metrics()))}")
        print(f"dimensions: {', '.join(sorted(self.get_dimensions()))}")

    # Questions

    def plan_question(self, question: str, planner=None):
        from lattica.questions import plan_question

        return plan_question(self, question, planner)

    def execute_question_plan(self, plan, progress=None):
        from lattica.questions import execute_plan

        return execute_plan(self, plan, progress)

    def answer_question(self, question: str, planner=None, summarizer=None, progress=None):
        from lattica.questions import answer

        return answer(self, question, planner, summarizer, progress)

    def execute_text(self, question: str, planner=None):
        return self.answer_question(question, planner).result


def planner_reach(ds: DataSource, table: str) -> list[str]:
    from lattica.plans.graph import reachable

    return reachable(ds.edges, table)


