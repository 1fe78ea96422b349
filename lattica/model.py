"""What a configuration declares: fields, columns, tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lattica.errors import ConfigError

AGGREGATIONS = ("sum", "mean", "min", "max", "count", "count_distinct")
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
#: Names that results use for themselves.
RESERVED = {"rollup_level"}


def check_name(name: object) -> str:
    if not isinstance(name, str) or not _NAME.match(name) or name.lower() in RESERVED:
        raise ConfigError(f"invalid field name {name!r}")
    return name


def safe_name(text: str) -> str:
    out = re.sub(r"\W", "_", text)
    return f"_{out}" if out[:1].isdigit() else out


def default_display(name: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in name.split("_") if w)


@dataclass
class Field:
    name: str
    type: str | None = None
    display_name: str | None = None
    description: str | None = None
    meta: dict | None = None
    formula: str | None = None
    adhoc: bool = False

    @property
    def shown_as(self) -> str:
        return self.display_name or default_display(self.name)


@dataclass
class Metric(Field):
    aggregation: str = "sum"
    rounding: int | None = None
    weighting_metric: str | None = None
    technical: object = None
    required_grain: list[str] | None = None
    ifnull: float | None = None


@dataclass
class Dimension(Field):
    values: list | str | Callable | None = None
    sorter: str | Callable | None = None


@dataclass
class FieldUse:
    """How a column provides a field."""

    name: str
    ds_formula: str | None = None
    conversions: dict | None = None
    #: The derived date dimension this is, if any.
    part: str | None = None


@dataclass
class ColumnSpec:
    name: str
    fields: list[FieldUse] = field(default_factory=list)
    allow_type_conversions: bool = False
    type_conversion_prefix: str | None = None
    disabled_type_conversions: list[str] | None = None
    active: bool = True
    required_grain: list[str] | None = None


@dataclass
class TableSpec:
    name: str
    type: str
    primary_key: list[str]
    load: Callable[[], DataFrame]
    columns: dict[str, ColumnSpec] = field(default_factory=dict)
    active: bool = True
    parent: str | None = None
    siblings: list[str] = field(default_factory=list)
    create_fields: bool = False
    use_full_column_names: bool = True
    incomplete_dimensions: list[str] = field(default_factory=list)
    priority: int = 1
    prefix_with: str | None = None
    criteria_limits: list | None = None
    _frame: DataFrame | None = None

    @property
    def alias(self) -> str:
        """The bare table name, by which formulas refer to it."""
        return self.name.rpartition(".")[2]

    @property
    def frame(self) -> DataFrame:
        if self._frame is None:
            self._frame = self.load()
        return self._frame

    def uses(self) -> dict[str, tuple[ColumnSpec, FieldUse]]:
        """The fields this table provides."""
        return {u.name: (c, u) for c in self.columns.values() if c.active for u in c.fields}
