"""Command line: run a report, check a configuration, bootstrap one, turn YAML to JSON and back.

    python -m lattica.cli report warehouse.json -m revenue -d partner_name -c "partner_name = Partner A" --rollup totals
    python -m lattica.cli check warehouse.json
    python -m lattica.cli bootstrap parquet:/data out.yaml
    python -m lattica.cli convert in.yaml out.json
"""

from __future__ import annotations

import argparse
import json
import re

from lattica.bootstrap import bootstrap, write_config
from lattica.config import load_warehouse_config, read_config

_CRITERION = re.compile(r"^\s*(\w+)\s*(not in report|in report|not between|between|not like|not in|like|in|!=|>=|<=|=|>|<)\s*(.*)$", re.I)


def value(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return text


def criterion(text: str) -> tuple:
    """"field op value"; values of in and between are JSON lists or parted by commas."""
    m = _CRITERION.match(text)
    if not m:
        raise SystemExit(f"invalid criterion {text!r}")
    v = value(m[3].strip())
    if m[2].lower() in ("in", "not in", "between", "not between") and not isinstance(v, list):
        v = [value(x.strip()) for x in str(v).split(",")]
    return m[1], m[2].lower(), v


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lattica").getOrCreate()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lattica", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("report", help="run a report")
    r.add_argument("config")
    r.add_argument("-m", "--metrics", nargs="*", default=[])
    r.add_argument("-d", "--dimensions", nargs="*", default=[])
    r.add_argument("-c", "--criteria", nargs="*", default=[])
    r.add_argument("-f", "--row-filters", nargs="*", default=[])
    r.add_argument("--rollup", type=value)
    r.add_argument("--pivot", nargs="*")
    r.add_argument("--order-by", nargs="*", help="field or field:desc")
    r.add_argument("--limit", type=int)
    r.add_argument("--limit-first", action="store_true")
    r.add_argument("--timeout", type=float)
    c = sub.add_parser("check", help="load a configuration and check it")
    c.add_argument("config")
    b = sub.add_parser("bootstrap", help="write a configuration for a source")
    b.add_argument("connect")
    b.add_argument("output")
    b.add_argument("--tables", nargs="*")
    b.add_argument("--metric-tables", nargs="*", default=[])
    v = sub.add_parser("convert", help="write a configuration in the other format")
    v.add_argument("input")
    v.add_argument("output")
    a = p.parse_args(args)
    if a.command == "convert":
        write_config(read_config(a.input), a.output)
        return 0
    if a.command == "bootstrap":
        write_config(bootstrap(session(), a.connect, a.tables, a.metric_tables), a.output)
        return 0
    from lattica.warehouse import Warehouse

    if a.command == "check":
        load_warehouse_config(a.config)
        Warehouse(session(), a.config).print_info()
        return 0
    result = Warehouse(session(), a.config).execute(
        a.metrics, a.dimensions, criteria=[criterion(x) for x in a.criteria], row_filters=[criterion(x) for x in a.row_filters], rollup=a.rollup, pivot=a.pivot,
        order_by=[tuple(x.split(":")) if ":" in x else (x, "asc") for x in a.order_by or []], limit=a.limit, limit_first=a.limit_first, timeout=a.timeout,
    )
    for w in result.warnings:
        print(f"warning: {w}")
    names = result.display_name_map
    print("\t".join(names.get(c, c) for c in result.df.columns))
    for row in result.rows:
        print("\t".join("" if x is None else str(x) for x in row))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
