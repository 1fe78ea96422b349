"""Datasources: tables with declared fields, over a connection or given frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from lattica.config import check_table, load_datasource_config, make_columns, make_dimension, make_metric
from lattica.errors import ConfigError, InvalidField, WarehouseError
from lattica.functions import dates, formulas, types
from lattica.model import ColumnSpec, Dimension, FieldUse, Metric, TableSpec, safe_name
from lattica.plans import graph
from lattica.sources import readers


class FieldManager:
    """Metrics and dimensions by name."""

    metrics: dict[str, Metric]
    dimensions: dict[str, Dimension]

    def _declare(self, metrics: Iterable[dict], dimensions: Iterable[dict]) -> None:
        self.metrics, self.dimensions = {}, {}
        for m in metrics:
            self.add_metric(make_metric(m))
        for d in dimensions:
            self.add_dimension(make_dimension(d))

    def add_metric(self, m: Metric, force: bool = False) -> None:
        if not force and (m.name in self.metrics or m.name in self.dimensions):
            raise InvalidField(f"field {m.name} is declared twice")
        self.metrics[m.name] = m

    def add_dimension(self, d: Dimension, force: bool = False) -> None:
        if not force and (d.name in self.metrics or d.name in self.dimensions):
            raise InvalidField(f"field {d.name} is declared twice")
        self.dimensions[d.name] = d

    def _children(self) -> list[FieldManager]:
        return []

    def get_metrics(self) -> dict[str, Metric]:
        out: dict[str, Metric] = {}
        for c in reversed(self._children()):
            out |= c.get_metrics()
        return out | self.metrics

    def get_dimensions(self) -> dict[str, Dimension]:
        out: dict[str, Dimension] = {}
        for c in reversed(self._children()):
            out |= c.get_dimensions()
        return out | self.dimensions

    def get_fields(self) -> dict[str, Metric | Dimension]:
        return self.get_dimensions() | self.get_metrics()

    def has_metric(self, name: str) -> bool:
        return name in self.get_metrics()

    def has_dimension(self, name: str) -> bool:
        return name in self.get_dimensions()

    def has_field(self, name: str) -> bool:
        return self.has_metric(name) or self.has_dimension(name)

    def get_metric(self, name: str | dict) -> Metric:
        if isinstance(name, dict):
            m = make_metric(name, adhoc=True)
            if self.has_field(m.name):
                raise InvalidField(f"ad hoc metric {m.name} has the name of a field")
            return m
        found = self.get_metrics().get(name)
        if found is None:
            raise InvalidField(f"no metric {name!r}")
        return found

    def get_dimension(self, name: str | dict) -> Dimension:
        if isinstance(name, dict):
            d = make_dimension(name, adhoc=True)
            if self.has_field(d.name):
                raise InvalidField(f"ad hoc dimension {d.name} has the name of a field")
            return d
        found = self.get_dimensions().get(name)
        if found is None:
            raise InvalidField(f"no dimension {name!r}")
        return found

    def get_field(self, name: str) -> Metric | Dimension:
        return self.get_metric(name) if self.has_metric(name) else self.get_dimension(name)

    def display_names(self) -> dict[str, str]:
        return {n: f.shown_as for n, f in self.get_fields().items()}


class AdHocTable:
    """A table from rows, frames or a file, for a datasource made in code."""

    def __init__(
        self, name: str, data: object, table_type: str, primary_key: list[str], columns: dict | None = None, parent: str | None = None, if_exists: str = "replace",
        drop_dupes: bool = False, convert_types: dict | None = None, fillna_value: object = None, use_full_column_names: bool = False, schema: str | None = None, **options,
    ):
        self.name, self.data, self.columns, self.schema, self.options = name, data, columns, schema, options
        self.drop_dupes, self.convert_types, self.fillna_value, self.if_exists = drop_dupes, convert_types, fillna_value, if_exists
        self.config = {"type": table_type, "primary_key": primary_key, "parent": parent, "columns": columns or {}, "create_fields": True, "use_full_column_names": use_full_column_names}

    def frame(self, spark: SparkSession) -> DataFrame:
        data = readers.read_file(spark, self.data, if_exists=self.if_exists, **self.options) if isinstance(self.data, str) else self.data
        keys = [next((c for c, v in (self.columns or {}).items() if any((f if isinstance(f, str) else f["name"]) == k for f in (v or {}).get("fields", []))), k) for k in self.config["primary_key"]]
        return readers.adhoc_frame(spark, data, list(self.columns or {}) or None, keys, self.convert_types, self.drop_dupes, self.fillna_value, self.schema)


class DataSource(FieldManager):
    """Tables of one source and the fields they provide."""

    def __init__(self, spark: SparkSession, name: str, config: dict | str | None = None, frames: dict[str, DataFrame | Callable[[], DataFrame]] | None = None, contexts: dict | None = None, adhoc_directory: str = "lattica-adhoc", declared: Iterable[str] = ()):
        self.spark, self.name = spark, safe_name(name)
        if self.name != name:
            raise ConfigError(f"invalid datasource name {name!r}")
        config = load_datasource_config(config or {})
        self.declared_above = set(declared)
        self.prefix_with, self.meta = config.get("prefix_with"), config.get("meta")
        self._declare(config["metrics"], config.get("dimensions") or [])
        connection = readers.connect(spark, name, config["connect"], contexts) if config.get("connect") else None
        self.tables: dict[str, TableSpec] = {}
        for table, c in config["tables"].items():
            if not c.get("active", True):
                continue
            own = {k: v for k, v in c.items() if k not in ("columns", "data_url", "if_exists", "drop_dupes", "convert_types", "adhoc_table_options", "fillna_value")}
            own["siblings"], own["incomplete_dimensions"] = own.get("siblings") or [], own.get("incomplete_dimensions") or []
            self.tables[table] = TableSpec(name=table, columns=make_columns(c.get("columns")), load=self._loader(table, c, frames or {}, connection, adhoc_directory), **own)
        self.skip_conversion_fields = bool(config.get("skip_conversion_fields"))
        for t in self.tables.values():
            self._complete(t)
        self.edges = graph.neighbours(self.tables)

    def _loader(self, name: str, c: dict, frames: dict, connection: readers.Connection | None, folder: str):
        def load() -> DataFrame:
            if name in frames or name.rpartition(".")[2] in frames:
                df = frames.get(name, frames.get(name.rpartition(".")[2]))
                df = df() if callable(df) else df
            elif c.get("data_url"):
                df = readers.read_file(self.spark, c["data_url"], folder, c.get("if_exists", "replace"), **(c.get("adhoc_table_options") or {}))
            elif connection:
                df = connection.load(name)
            else:
                raise WarehouseError(f"table {name} of {self.name} has no source")
            if c.get("convert_types") or c.get("drop_dupes") or c.get("fillna_value") is not None:
                keys = [col for col, v in (c.get("columns") or {}).items() if any((f if isinstance(f, str) else f["name"]) in c["primary_key"] for f in (v or {}).get("fields", []))]
                df = readers.adhoc_frame(self.spark, df, None, keys, c.get("convert_types"), c.get("drop_dupes", False), c.get("fillna_value"))
            return df

        return load

    def is_temporal(self, table: str, column: str) -> bool:
        return types.is_temporal(self.tables[table].frame.schema[column].dataType)

    def _complete(self, t: TableSpec) -> None:
        """Fields of undeclared columns and date parts."""
        if t.create_fields:
            for f in t.frame.schema.fields:
                c = t.columns.setdefault(f.name, ColumnSpec(f.name))
                if not c.fields and c.active:
                    c.fields.append(FieldUse(safe_name(f"{t.name}.{f.name}" if t.use_full_column_names else f.name)))
        kinds = {f.name: f.dataType for f in t.frame.schema.fields} if t.create_fields or any(c.allow_type_conversions for c in t.columns.values()) else {}
        done: set = set()
        for c in t.columns.values():
            if c.allow_type_conversions and c.active and not self.skip_conversion_fields:
                kind = kinds.get(c.name)
                if kind is None or not types.is_temporal(kind):
                    continue
                if (type(kind), c.type_conversion_prefix) in done:
                    raise WarehouseError(f"table {t.name}: two columns of one type are converted under one prefix")
                done.add((type(kind), c.type_conversion_prefix))
                for part, spec in dates.PARTS.items():
                    if (spec.for_dates or type(kind).__name__ != "DateType") and part not in (c.disabled_type_conversions or []):
                        name = f"{c.type_conversion_prefix or ''}{part}"
                        if any(u.name == name for u in c.fields):
                            continue
                        c.fields.append(FieldUse(name, part=part))
                        if name not in self.dimensions and name not in self.metrics and name not in self.declared_above:
                            self.add_dimension(Dimension(name, spec.type, description=spec.description, values=list(spec.values) if spec.values else None, sorter="values" if spec.values else None))
        if t.create_fields:
            for c in t.columns.values():
                for u in c.fields if c.active else []:
                    if u.part or u.name in self.metrics or u.name in self.dimensions or u.name in self.declared_above:
                        continue
                    kind = kinds[c.name]
                    if t.type == "metric" and types.looks_like_metric(c.name, kind, u.name in t.primary_key, bool(u.ds_formula) and formulas.aggregates(u.ds_formula)):
                        aggregation, rounding = types.default_aggregation(kind)
                        self._pending(u.name, Metric(u.name, types.declared_name(kind), aggregation=aggregation, rounding=rounding))
                    else:
                        self._pending(u.name, Dimension(u.name, types.declared_name(kind)))

    def _pending(self, name: str, field: Metric | Dimension) -> None:
        # a warehouse that declares the field itself goes first, see FieldManager.get_metrics
        (self.add_metric if isinstance(field, Metric) else self.add_dimension)(field)

    @property
    def metric_tables(self) -> dict[str, TableSpec]:
        return {n: t for n, t in self.tables.items() if t.type == "metric"}

    @property
    def dimension_tables(self) -> dict[str, TableSpec]:
        return {n: t for n, t in self.tables.items() if t.type == "dimension"}

    def has_table(self, name: str) -> bool:
        return name in self.tables

    def get_table(self, name: str) -> TableSpec:
        if name not in self.tables:
            raise WarehouseError(f"no table {name!r} in {self.name}")
        return self.tables[name]

    def get_tables_with_field(self, name: str, table_type: str | None = None) -> list[TableSpec]:
        return [t for t in self.tables.values() if name in t.uses() and (table_type is None or t.type == table_type)]

    def get_columns_with_field(self, name: str) -> list[tuple[TableSpec, ColumnSpec]]:
        return [(t, t.uses()[name][0]) for t in self.get_tables_with_field(name)]

    def join_for(self, t: TableSpec, grain: list[str], max_candidates: int | None = 100, max_joins: int | None = None) -> graph.TableSet | None:
        """The smallest table set over t that provides the grain."""
        found = graph.smallest_join(self.edges, self.tables, t, grain, max_candidates, max_joins)
        return graph.TableSet(self, t, *found) if found else None

    @classmethod
    def from_data_file(cls, spark: SparkSession, name: str, url: str, primary_key: list[str], table_type: str = "metric", **kw) -> DataSource:
        """A datasource with the one table of a file."""
        return cls.from_tables(spark, name, [AdHocTable(safe_name(kw.pop("table", None) or url.rpartition("/")[2].partition(".")[0]), url, table_type, primary_key, **kw)])

    @classmethod
    def from_tables(cls, spark: SparkSession, name: str, tables: list[AdHocTable], config: dict | None = None, declared: Iterable[str] = ()) -> DataSource:
        config = load_datasource_config(config or {})
        config["tables"] |= {t.name: check_table(t.name, t.config) for t in tables}
        return cls(spark, name, config, {t.name: t.frame(spark) for t in tables}, declared=declared)

    @classmethod
    def from_db_file(cls, spark: SparkSession, name: str, path: str, config: dict | None = None) -> DataSource:
        return cls(spark, name, (config or {}) | {"connect": f"sqlite:///{readers.fetched(path, 'lattica-adhoc')}"})


