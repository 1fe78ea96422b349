"""A harbour: quays with berths, calls of ships, boxes landed, and another source with sums by berth. Rows are made by rule."""

import datetime as dt
import random
from copy import deepcopy
from decimal import Decimal

import pandas as pd

from lattica.warehouse import Warehouse

QUAYS = ["North", "South", "West"]


def make_rows() -> dict[str, list[tuple]]:
    rng = random.Random(17)
    berths = [(10 * q + k, f"{name[0]}{k}", q, dt.datetime(2021, q, 3 * k, 7, 5, 9)) for q, name in enumerate(QUAYS, 1) for k in (1, 2, 3)]
    calls = [(i, f"ship {i % 9}" if i % 8 else None, rng.choice(berths[:-1])[0], dt.datetime(2022 + i % 3, 1 + i * 5 % 12, 1 + i * 7 % 28, i * 11 % 24, i * 13 % 60, i)) for i in range(1, 41)]
    boxes = []
    for i in range(1, 151):
        call = calls[rng.randrange(36)]
        fee = None if i % 29 == 0 else Decimal(rng.randrange(100, 9000)) / 100
        boxes.append((i, rng.choice(["tea", "salt", "wool", "iron"]), rng.randrange(1, 30), fee, call[0], call[3] + dt.timedelta(hours=i)))
    return {"quays": list(enumerate(QUAYS, 1)), "cranes": [(1, "tall"), (3, "broad")], "berths": berths, "calls": calls, "boxes": boxes}


ROWS = make_rows()
SCHEMAS = {
    "quays": "id int, label string", "cranes": "quay int, crane string", "berths": "id int, label string, quay int, opened timestamp_ntz",
    "calls": "id int, ship string, berth int, arrived timestamp_ntz", "boxes": "id int, goods string, tonnes int, fee decimal(10,2), call int, landed timestamp_ntz",
    "tallies": "quay int, berth int, boxes int, fee decimal(12,2)",
}


def flat(table: str) -> pd.DataFrame:
    """Calls or boxes with all that belongs to them, for brute force."""
    frames = {n: pd.DataFrame(ROWS[n], columns=[c.split()[0] for c in SCHEMAS[n].replace("(10,2)", "").split(", ")]) for n in ROWS}
    berths = frames["berths"].merge(frames["quays"], left_on="quay", right_on="id", suffixes=("", "_q")).merge(frames["cranes"], on="quay", how="left")
    berths = berths.rename(columns={"id": "berth_id", "label": "berth_label", "label_q": "quay_label", "quay": "quay_id", "opened": "berth_opened"}).drop(columns="id_q")
    calls = frames["calls"].rename(columns={"id": "call_id", "berth": "berth_id"}).merge(berths, on="berth_id")
    if table == "calls":
        return calls
    return frames["boxes"].rename(columns={"id": "box_id", "call": "call_id"}).merge(calls, on="call_id")


def tallies() -> list[tuple]:
    b = flat("boxes")
    return [(int(q), int(k), len(g), sum(x for x in g.fee if x is not None)) for (q, k), g in b.groupby(["quay_id", "berth_id"])]


def column(*fields, **more):
    return {"fields": list(fields)} | more


def numbered(name: str, of: str) -> dict:
    return {"name": name, "ds_formula": f"COUNT(DISTINCT {of}.id)"}


CONFIG = {
    "metrics": [
        {"name": "fee", "type": "numeric(12,2)", "rounding": 2, "divisors": {"metrics": ["calls"], "rounding": 3}},
        *({"name": n, "type": "integer"} for n in ("calls", "boxes", "tonnes", "seen")),
        {"name": "fee_by_weight", "type": "numeric(12,4)", "aggregation": "mean", "weighting_metric": "tonnes", "rounding": 4},
        {"name": "fee_smooth", "type": "numeric(12,4)", "technical": "mean(3)", "rounding": 4},
        {"name": "fee_range", "type": "numeric(12,4)", "technical": "boll(4)", "rounding": 4},
        {"name": "fee_at_berth", "type": "numeric(12,2)", "required_grain": ["berth_label"]},
        {"name": "fee_each", "formula": "{fee}/{calls}", "aggregation": "mean", "rounding": 3},
        {"name": "fee_each_more", "formula": "3*{fee_each}", "aggregation": "mean", "rounding": 3},
        {"name": "no_number", "formula": "{fee}/({calls}-{calls})", "aggregation": "mean"},
    ],
    "dimensions": [
        {"name": "quay_label", "type": "string(20)", "values": ["West", "South", "North"], "sorter": "values"},
        *({"name": n, "type": "string(20)"} for n in ("berth_label", "ship", "goods", "crane")),
        *({"name": n, "type": "integer"} for n in ("quay_id", "berth_id", "call_id", "box_id", "weight_class")),
        {"name": "quay_or_none", "formula": "IFNULL({quay_label}, 'none')"},
    ],
    "datasources": {
        "port": {
            "tables": {
                "port.quays": {"type": "dimension", "primary_key": ["quay_id"], "siblings": ["port.cranes"], "columns": {"id": column("quay_id"), "label": column("quay_label")}},
                "port.cranes": {"type": "dimension", "primary_key": ["quay_id"], "columns": {"quay": column("quay_id"), "crane": column("crane")}},
                "port.berths": {
                    "type": "dimension", "primary_key": ["berth_id"], "parent": "port.quays",
                    "columns": {"id": column("berth_id"), "label": column("berth_label"), "quay": column("quay_id"), "opened": {"allow_type_conversions": True, "type_conversion_prefix": "opened_"}},
                },
                "port.calls": {
                    "type": "metric", "primary_key": ["call_id"],
                    "columns": {"id": column("call_id", numbered("calls", "calls"), numbered("seen", "calls")), "ship": column("ship"), "berth": column("berth_id"), "arrived": {"allow_type_conversions": True}},
                },
                "port.boxes": {
                    "type": "metric", "primary_key": ["box_id"], "parent": "port.calls", "priority": 2,
                    "columns": {
                        "id": column("box_id", numbered("boxes", "boxes"), numbered("seen", "boxes")), "goods": column("goods"), "call": column("call_id"),
                        "tonnes": column("tonnes", {"name": "weight_class", "ds_formula": "CAST(FLOOR(boxes.tonnes / 10) AS INT)"}),
                        "fee": column("fee", "fee_by_weight", "fee_smooth", "fee_range", "fee_at_berth"),
                        "landed": {"allow_type_conversions": True, "type_conversion_prefix": "landed_"},
                    },
                },
            }
        },
        "books": {
            "tables": {
                "tallies": {
                    "type": "metric", "primary_key": ["quay_id", "berth_id"],
                    "columns": {"quay": column("quay_id"), "berth": column("berth_id"), "boxes": column("boxes"), "fee": column("fee", required_grain=["quay_id"])},
                }
            }
        },
    },
}


def make(spark, change=None, **kw):
    """The harbour's warehouse; change(config) alters its configuration first."""
    config = deepcopy(CONFIG)
    if change:
        change(config)
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in {**ROWS, "tallies": tallies()}.items()}
    return Warehouse(spark, config, frames={"port": {n: f for n, f in frames.items() if n != "tallies"}, "books": {"tallies": frames["tallies"]}}, **kw)
