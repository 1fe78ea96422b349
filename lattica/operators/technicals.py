"""Window statistics ("technicals") over a report's rows.

They run on aggregated rows only. In mode ``group`` a window covers rows that agree in all dimensions
but the last; in mode ``all``, and with fewer than two dimensions, it covers all rows. Rows are in order of
the dimensions, nulls first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import InvalidTechnical

ROLLING = ("mean", "sum", "median", "std", "var", "min", "max", "boll")
LAGGED = ("diff", "pct_change")
RUNNING = ("cumsum", "cummin", "cummax")
RANKED = ("rank", "pct_rank")
_TEXT = re.compile(r"^(\w+)(?:\(([^)]*)\))?(?::(\w+))?$")


@dataclass
class Technical:
    type: str
    params: dict = field(default_factory=dict)
    mode: str = "group"

    def __post_init__(self):
        allowed = {"window", "min_periods", "center"} if self.type in ROLLING else {"periods"} if self.type in LAGGED else set()
        if self.type not in ROLLING + LAGGED + RUNNING + RANKED:
            raise InvalidTechnical(f"unknown technical {self.type!r}")
        if self.mode not in ("group", "all"):
            raise InvalidTechnical(f"unknown mode {self.mode!r}")
        if extra := set(self.params) - allowed:
            raise InvalidTechnical(f"{self.type} takes no {sorted(extra)}")
        if self.type in ROLLING and not (isinstance(self.params.get("window"), int) and self.params["window"] > 0):
            raise InvalidTechnical(f"{self.type} needs a window of at least 1")


def parse_technical(text: str | dict | Technical) -> Technical:
    """"type(arguments):mode" or {type, params, mode}."""
    if isinstance(text, Technical):
        return text
    if isinstance(text, dict):
        if extra := set(text) - {"type", "params", "mode"}:
            raise InvalidTechnical(f"unknown keys {sorted(extra)}")
        return Technical(text.get("type"), dict(text.get("params") or {}), text.get("mode") or "group")
    m = _TEXT.match(text.replace(" ", ""))
    if not m:
        raise InvalidTechnical(f"invalid technical {text!r}")
    try:
        args = [int(a) for a in m[2].split(",")] if m[2] else []
    except ValueError:
        raise InvalidTechnical(f"invalid arguments in {text!r}") from None
    names = ["window", "min_periods"] if m[1] in ROLLING else ["periods"] if m[1] in LAGGED else []
    if len(args) > len(names):
        raise InvalidTechnical(f"too many arguments in {text!r}")
    params = dict(zip(names, args, strict=False))
    if m[1] in ROLLING and "window" in params:
        params.setdefault("min_periods", 1)
    return Technical(m[1], params, m[3] or "group")


def output_columns(name: str, t: Technical) -> list[str]:
    return [name, f"{name}_lower", f"{name}_upper"] if t.type == "boll" else [name]


def _median(x: Column, frame) -> Column:
    """No framed median exists: the middle of the sorted values of the frame."""
    values = F.array_sort(F.collect_list(x).over(frame))
    n = F.size(values)
    low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def apply_technical(df: DataFrame, name: str, t: Technical, dims: list[str]) -> DataFrame:
    """df with the metric's column replaced by its technical, and Bollinger bands beside it."""
    x = F.col(name).cast("double")
    part = [F.col(d) for d in dims[:-1]] if t.mode == "group" and len(dims) > 1 else []
    base = Window.partitionBy(*part)
    order = base.orderBy(*[F.col(d).asc_nulls_first() for d in dims] or [F.lit(1)])
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    if t.type in ROLLING:
        n = t.params["window"]
        least = t.params.get("min_periods", n)
        frame = order.rowsBetween(-(n // 2), (n - 1) // 2) if t.params.get("center") else order.rowsBetween(-(n - 1), 0)
        enough = lambda c: F.when(F.count(x).over(frame) >= max(least, 1), c)
        if t.type == "boll":
            mean, sd = enough(F.avg(x).over(frame)), enough(F.stddev_samp(x).over(frame))
            return df.withColumns({name: mean, f"{name}_lower": mean - 2 * sd, f"{name}_upper": mean + 2 * sd})
        make = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max}
        return df.withColumn(name, enough(_median(x, frame) if t.type == "median" else make[t.type](x).over(frame)))
    if t.type in LAGGED:
        p = t.params.get("periods", 1)
        if t.type == "diff":
            return df.withColumn(name, x - F.lag(x, p).over(order))
        filled = fresh_name(df, "filled")
        df = df.withColumn(filled, F.last(x, ignorenulls=True).over(running))
        before, now = F.lag(filled, p).over(order), F.col(filled)
        none = F.when(now == 0, F.lit(float("nan"))).when(now > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return df.withColumn(name, F.when(before == 0, F.when(now.isNotNull(), none)).otherwise(now / F.nullif(before, F.lit(0.0)) - 1)).drop(filled)
    if t.type in RUNNING:
        make = {"cumsum": F.sum, "cummin": F.min, "cummax": F.max}[t.type]
        return df.withColumn(name, F.when(x.isNotNull(), make(x).over(running)))
    ties = Window.partitionBy(*part, x)
    place = F.rank().over(base.orderBy(x.asc_nulls_last())) + (F.count(x).over(ties) - 1) / 2
    return df.withColumn(name, F.when(x.isNotNull(), place if t.type == "rank" else place / F.nullif(F.count(x).over(base), F.lit(0))))


def fresh_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
