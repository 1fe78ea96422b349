"""Configurations: files, references between them, macros, and their checked form."""

from __future__ import annotations

import json
import os
import re
import urllib.request
from copy import deepcopy
from importlib import import_module
from pathlib import Path
from typing import Any

from lattica.errors import ConfigError
from lattica.functions import types
from lattica.model import AGGREGATIONS, ColumnSpec, Dimension, FieldUse, Metric, check_name
from lattica.operators.technicals import parse_technical

#: Default settings; each may be set by a file named in LATTICA_CONFIG or as LATTICA_<KEY>.
DEFAULTS: dict[str, Any] = {
    "DEBUG": False, "LOG_LEVEL": "WARNING", "STORE_DIRECTORY": "lattica-store", "ADHOC_DIRECTORY": "lattica-adhoc", "QUERY_TIMEOUT": None, "MAX_JOINS": None,
    "MAX_JOIN_CANDIDATES": 100, "DATASOURCE_CONTEXTS": {}, "QUESTION_PLANNER": None,
}


def settings(environ: dict[str, str] | None = None) -> dict[str, Any]:
    env = os.environ if environ is None else environ
    out = DEFAULTS | (read_config(env["LATTICA_CONFIG"]) if env.get("LATTICA_CONFIG") else {})
    for key, default in DEFAULTS.items():
        if (value := env.get(f"LATTICA_{key}")) is not None:
            out[key] = value if isinstance(default, str) else json.loads(value) if value else None
    return out


def imported(name: str) -> Any:
    """The object that a dotted name stands for."""
    module, _, attribute = name.rpartition(".")
    if not module:
        raise ConfigError(f"{name!r} is no dotted name")
    return getattr(import_module(module), attribute)


def parse_text(text: str) -> Any:
    """JSON, or else YAML."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def read_config(source: str | dict, base: str | None = None) -> dict:
    """A configuration from a dict, a path, a URL or a text; ${NAME} in files stands for environment variables."""
    if isinstance(source, dict):
        return deepcopy(source)
    if "\n" in source or source.lstrip()[:1] == "{":
        text = source
    elif re.match(r"^[a-z]+://", source):
        with urllib.request.urlopen(source, timeout=30) as f:
            text = f.read().decode()
    else:
        path = Path(os.path.expandvars(source))
        text = (path if path.is_absolute() or not base or path.exists() else Path(base) / path).read_text()
    out = parse_text(re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), text))
    if not isinstance(out, dict):
        raise ConfigError("a configuration is a mapping")
    return out


def _base(source: Any, base: str | None) -> str | None:
    return str(Path(source).parent) if isinstance(source, str) and "\n" not in source and os.path.exists(source) else base


def merged(a: dict, b: dict) -> dict:
    """b laid over a: mappings by key, lists of named things by name, other lists one after another."""
    out = dict(a)
    for k, v in b.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            named = {x["name"]: x for x in [*out[k], *v] if isinstance(x, dict) and "name" in x}
            out[k] = [*named.values(), *(x for x in [*out[k], *v] if not (isinstance(x, dict) and "name" in x))]
        else:
            out[k] = v
    return out


def load_warehouse_config(source: str | dict) -> dict:
    """A warehouse's configuration with includes merged, references read and macros made into metrics."""
    base = _base(source, None)
    config = read_config(source)
    for name in config.pop("includes", None) or []:
        config = merged(load_warehouse_config(str(Path(base) / name) if base and not os.path.isabs(name) and "://" not in name else name), config)
    _known("warehouse", config, {"metrics", "dimensions", "datasources", "meta"})
    config["metrics"] = metric_macros(config.get("metrics") or [])
    config["datasources"] = {n: load_datasource_config(c, base) for n, c in (config.get("datasources") or {}).items()}
    return config


def load_datasource_config(source: str | dict, base: str | None = None) -> dict:
    config, base = read_config(source, base), _base(source, base)
    _known("datasource", config, {"connect", "skip_conversion_fields", "prefix_with", "metrics", "dimensions", "tables", "meta"})
    config["metrics"] = metric_macros(config.get("metrics") or [])
    config["tables"] = {n: check_table(n, read_config(t, base)) for n, t in (config.get("tables") or {}).items()}
    return config


def _known(what: str, config: dict, keys: set[str]) -> None:
    if extra := set(config) - keys:
        raise ConfigError(f"{what}: unknown keys {sorted(extra)}")


DIVISOR_FORMULA = "1.0*IFNULL({metric},0)/{divisor}"


def metric_macros(metrics: list[dict]) -> list[dict]:
    """Variants by aggregation and metrics per divisor, as metrics of their own."""
    plain: list[dict] = []
    for m in metrics:
        m = dict(m)
        variants, divisors = m.get("aggregation"), m.pop("divisors", None)
        own = [m]
        if isinstance(variants, dict):
            own = [{k: v for k, v in m.items() if k != "aggregation"} | {"name": f"{m['name']}_{a}", "aggregation": a, "display_name": None} | (x or {}) for a, x in variants.items()]
        plain += own
        if divisors:
            _known("divisors", divisors, {"metrics", "rounding", "name", "formula"})
            for x in own:
                for d in divisors["metrics"]:
                    name = (divisors.get("name") or "{metric}_per_{divisor}").format(metric=x["name"], divisor=d[:-1] if d.endswith("s") else d)
                    formula = (divisors.get("formula") or DIVISOR_FORMULA).format(metric=f"{{{x['name']}}}", divisor=f"{{{d}}}")
                    plain.append({"name": name, "aggregation": "mean", "formula": formula, "weighting_metric": d, "rounding": divisors.get("rounding")})
    return plain


_FIELD = {"name", "type", "display_name", "description", "meta", "formula"}


def make_metric(config: dict, adhoc: bool = False) -> Metric:
    _known("metric", config, _FIELD | {"aggregation", "rounding", "weighting_metric", "technical", "required_grain", "ifnull"})
    name, formula = check_name(config.get("name")), config.get("formula")
    if adhoc and not formula:
        raise ConfigError(f"ad hoc metric {name} has no formula")
    if formula and (config.get("type") or config.get("ifnull") is not None) and not adhoc:
        raise ConfigError(f"formula metric {name} takes neither type nor ifnull")
    if not formula and not config.get("type"):
        raise ConfigError(f"metric {name} has no type")
    if config.get("type"):
        types.spark_type(config["type"])
    aggregation = config.get("aggregation") or "sum"
    if aggregation not in AGGREGATIONS:
        raise ConfigError(f"metric {name}: unknown aggregation {aggregation!r}")
    if config.get("weighting_metric") and aggregation != "mean" and not formula:
        raise ConfigError(f"metric {name}: only a mean can be weighted")
    technical = parse_technical(config["technical"]) if config.get("technical") else None
    return Metric(**{k: v for k, v in config.items() if k not in ("aggregation", "technical")}, aggregation=aggregation, technical=technical, adhoc=adhoc)


def make_dimension(config: dict, adhoc: bool = False) -> Dimension:
    _known("dimension", config, _FIELD | {"values", "sorter"})
    name, formula = check_name(config.get("name")), config.get("formula")
    if adhoc and not formula:
        raise ConfigError(f"ad hoc dimension {name} has no formula")
    if not formula:
        if not config.get("type"):
            raise ConfigError(f"dimension {name} has no type")
        types.spark_type(config["type"])
    return Dimension(**config, adhoc=adhoc)


_TABLE = {"type", "active", "parent", "siblings", "create_fields", "use_full_column_names", "primary_key", "incomplete_dimensions", "priority", "prefix_with", "criteria_limits"}
_LOAD = {"columns", "data_url", "if_exists", "drop_dupes", "convert_types", "adhoc_table_options", "fillna_value"}
OPERATIONS = ("=", "!=", ">", ">=", "<", "<=", "in", "not in", "between", "not between", "like", "not like")


def check_table(name: str, config: dict) -> dict:
    _known(f"table {name}", config, _TABLE | _LOAD)
    if not re.match(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$", name):
        raise ConfigError(f"invalid table name {name!r}")
    if config.get("type") not in ("metric", "dimension"):
        raise ConfigError(f"table {name}: type is metric or dimension")
    if not isinstance(config.get("primary_key"), list) or not config["primary_key"]:
        raise ConfigError(f"table {name}: primary_key is a list of fields")
    for limit in config.get("criteria_limits") or []:
        if not isinstance(limit, list | tuple) or len(limit) != 3 or limit[1] not in OPERATIONS:
            raise ConfigError(f"table {name}: a criteria limit is [field, operation, value]")
        if limit[1] in ("between", "not between") and not (isinstance(limit[2], list | tuple) and len(limit[2]) == 2):
            raise ConfigError(f"table {name}: {limit[1]} takes two values")
    return config


def make_columns(config: dict[str, dict] | None) -> dict[str, ColumnSpec]:
    out = {}
    for name, c in (config or {}).items():
        c = c or {}
        _known(f"column {name}", c, {"fields", "allow_type_conversions", "type_conversion_prefix", "disabled_type_conversions", "active", "required_grain"})
        uses = []
        for f in c.get("fields") or []:
            if isinstance(f, str):
                uses.append(FieldUse(check_name(f)))
            else:
                _known(f"field of column {name}", f, {"name", "ds_formula", "ds_criteria_conversions"})
                uses.append(FieldUse(check_name(f["name"]), f.get("ds_formula"), f.get("ds_criteria_conversions")))
        out[name] = ColumnSpec(name, uses, **{k: v for k, v in c.items() if k != "fields"})
    return out
