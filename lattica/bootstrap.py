"""A first configuration for a datasource, from the schemas of its tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession

from lattica.functions import types
from lattica.model import safe_name
from lattica.sources import readers


def bootstrap(spark: SparkSession, connect: str | dict, tables: list[str] | None = None, metric_tables: list[str] = (), full_names: bool = False) -> dict:
    """{connect, metrics, dimensions, tables}: a table with numbers besides keys is a metric table unless metric_tables says which are."""
    connection = readers.connect(spark, "bootstrap", connect)
    out: dict = {"connect": connect, "metrics": [], "dimensions": [], "tables": {}}
    declared: dict[str, str] = {}
    for name in tables or connection.names():
        schema = connection.load(name).schema
        ids = [f.name for f in schema.fields if types.looks_like_metric(f.name, f.dataType, False) is False and types.is_numeric(f.dataType)]
        key = next((c for c in ("id", f"{name.rstrip('s')}_id") if c in schema.names), ids[0] if ids else schema.names[0])
        numbers = [f.name for f in schema.fields if f.name != key and types.looks_like_metric(f.name, f.dataType, False)]
        is_metric = name in metric_tables if metric_tables else bool(numbers)
        columns: dict = {}
        for f in schema.fields:
            field = f"{safe_name(name.rstrip('s'))}_id" if f.name == "id" else safe_name(f"{name}_{f.name}" if full_names else f.name)
            metric = is_metric and f.name in numbers
            kind = "metric" if metric else "dimension"
            if declared.get(field, kind) != kind:
                field = safe_name(f"{name}_{f.name}")
            if field not in declared:
                declared[field] = kind
                entry = {"name": field, "type": types.declared_name(f.dataType)}
                if metric:
                    aggregation, rounding = types.default_aggregation(f.dataType)
                    entry |= {"aggregation": aggregation} | ({"rounding": rounding} if rounding is not None else {})
                out["metrics" if metric else "dimensions"].append(entry)
            columns[f.name] = {"fields": [field]}
            if types.is_temporal(f.dataType):
                columns[f.name] |= {"allow_type_conversions": True, "type_conversion_prefix": f"{field}_"}
        out["tables"][name] = {"type": "metric" if is_metric else "dimension", "primary_key": [columns[key]["fields"][0]], "columns": columns}
    return out


def write_config(config: dict, path: str) -> None:
    """As JSON or YAML, by suffix."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = yaml.safe_dump(config, sort_keys=False)
    else:
        text = json.dumps(config, indent=2)
    Path(path).write_text(text + "\n")
