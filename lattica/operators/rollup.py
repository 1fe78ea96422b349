"""Rollup rows over a report's aggregated rows, by one grouping-sets aggregation.

Rollup rows aggregate the rows of the report, not base data: sums of sums, means of means, weighted means by the
weights of the rows. Technicals have no rollup value. ``rollup_level`` is the number of dimensions rolled up (0: a row of the
report); rolled-up dimensions are null, which the level tells from nulls of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.errors import ReportError
from lattica.model import Metric
from lattica.operators.technicals import output_columns

LEVEL = "rollup_level"
MARK = "::"


def check_rollup(rollup: object, n_dims: int) -> int | str | None:
    if rollup is None:
        return None
    if not n_dims:
        raise ReportError("a rollup needs dimensions")
    if rollup == "totals":
        return rollup
    if rollup == "all":
        return n_dims
    if not isinstance(rollup, int) or isinstance(rollup, bool) or not 0 < rollup <= n_dims:
        raise ReportError(f"rollup is totals, all, or 1 to {n_dims}, not {rollup!r}")
    return rollup


def prefixes(rollup: int | str, dims: list[str]) -> list[list[str]]:
    """The grouping sets besides the report's own rows."""
    if rollup == "totals":
        return [[]]
    out = [dims[:k] for k in range(1, min(rollup, len(dims) - 1) + 1)]
    return [*out, []] if rollup == len(dims) else out


def with_rollups(df: DataFrame, rollup: int | str, dims: list[str], metrics: dict[str, Metric]) -> DataFrame:
    sets = [dims, *prefixes(rollup, dims)]
    gid = F.grouping_id()
    detail = gid == 0
    aggs = [sum((F.grouping(d).cast("int") for d in dims), F.lit(0)).alias(LEVEL)]
    for m, f in metrics.items():
        if f.technical:
            aggs += [F.when(detail, F.first(c)).alias(c) for c in output_columns(m, f.technical) if c in df.columns]
            continue
        c = F.col(f"`{m}`")
        if f.weighting_metric and f.weighting_metric in df.columns:
            rolled = F.try_divide(F.sum(c * F.col(f"`{f.weighting_metric}`")), F.sum(F.col(f"`{f.weighting_metric}`")))
        elif f.aggregation in ("mean", "min", "max"):
            rolled = {"mean": F.avg, "min": F.min, "max": F.max}[f.aggregation](c)
        else:
            rolled = F.coalesce(F.sum(c), F.lit(0))
        aggs.append(F.when(detail, F.first(c)).otherwise(rolled).alias(m))
    cols = [F.col(f"`{d}`") for d in dims]
    return df.groupingSets([[F.col(f"`{d}`") for d in s] for s in sets], *cols).agg(*aggs)
