"""A warehouse over the driver's tables, and the catalogue of queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.datasource import AdHocTable
from lattica.operators import wrangle
from lattica.warehouse import Warehouse


def _geo(prefix: str, of: str) -> dict:
    return {
        f"{prefix}_nation": {
            "type": "dimension", "primary_key": [f"{prefix}_nation_id"], "parent": f"{prefix}_region",
            "columns": {"n_nationkey": {"fields": [f"{prefix}_nation_id"]}, "n_name": {"fields": [f"{of}nation_name"]}, "n_regionkey": {"fields": [f"{prefix}_region_id"]}},
        },
        f"{prefix}_region": {
            "type": "dimension", "primary_key": [f"{prefix}_region_id"],
            "columns": {"r_regionkey": {"fields": [f"{prefix}_region_id"]}, "r_name": {"fields": [f"{of}region_name"]}},
        },
    }


REVENUE = "CAST(lineitem.l_extendedprice * (1 - lineitem.l_discount) AS DECIMAL(18,4))"

CONFIG = {
    "metrics": [
        {"name": "revenue", "type": "numeric(18,4)", "rounding": 2, "divisors": {"metrics": ["line_count"], "rounding": 4}},
        {"name": "quantity", "type": "float"},
        {"name": "line_count", "type": "biginteger", "aggregation": "count"},
        {"name": "order_count", "type": "biginteger", "aggregation": "count"},
        {"name": "order_total", "type": "numeric(18,4)", "rounding": 2},
        {"name": "order_mean", "type": "numeric(18,4)", "aggregation": "mean", "rounding": 4},
        {"name": "order_min", "type": "numeric(18,4)", "aggregation": "min"},
        {"name": "order_max", "type": "numeric(18,4)", "aggregation": "max"},
        {"name": "customers", "type": "biginteger", "aggregation": "count_distinct"},
        {"name": "price", "type": "numeric(18,4)", "aggregation": {"min": {}, "max": {"name": "highest_price"}}},
        {"name": "discount_w", "type": "float", "aggregation": "mean", "weighting_metric": "quantity", "rounding": 6},
        {"name": "discount_price_w", "type": "float", "aggregation": "mean", "rounding": 6},
        {"name": "order_total_ifnull", "type": "numeric(18,4)", "ifnull": 0, "rounding": 2},
        {"name": "grain_total", "type": "numeric(18,4)", "required_grain": ["segment"], "rounding": 2},
        {"name": "event_count", "type": "biginteger", "aggregation": "count"},
        {"name": "event_value", "type": "numeric(18,4)", "rounding": 2},
        {"name": "balance", "type": "numeric(18,4)", "rounding": 2},
        {"name": "revenue_per_order", "formula": "{revenue}/{order_count}", "aggregation": "mean", "rounding": 4},
        {"name": "revenue_per_order_twice", "formula": "2*{revenue_per_order}", "aggregation": "mean", "rounding": 4},
        {"name": "revenue_per_order_w", "formula": "{revenue}/{order_count}", "aggregation": "mean", "weighting_metric": "order_count", "rounding": 4},
        *[
            {"name": f"tech_{n}", "formula": "{order_total}", "technical": t, "rounding": 4}
            for n, t in {
                "mean": "mean(3)", "sum": "sum(3)", "median": "median(3)", "std": "std(3)", "var": "var(3)", "min": "min(3)", "max": "max(3)", "boll": "boll(3)",
                "diff": "diff", "pct_change": "pct_change", "cumsum": "cumsum", "cummin": "cummin", "cummax": "cummax", "rank": "rank", "pct_rank": "pct_rank",
                "cumsum_all": "cumsum:all", "min_periods": "mean(3,2)", "center": {"type": "mean", "params": {"window": 3, "center": True, "min_periods": 1}},
            }.items()
        ],
    ],
    "dimensions": [
        {"name": n, "type": t}
        for n, t in {
            "order_id": "biginteger", "line_number": "integer", "customer_id": "biginteger", "customer_name": "string(32)", "segment": "string(16)", "part_id": "biginteger", "brand": "string(16)", "part_type": "string(32)",
            "supplier_id": "biginteger", "supplier_name": "string(32)", "nation_name": "string(32)", "region_name": "string(32)", "supplier_nation_name": "string(32)", "supplier_region_name": "string(32)",
            "customer_nation_id": "integer", "customer_region_id": "integer", "supplier_nation_id": "integer", "supplier_region_id": "integer", "order_status": "string(1)", "order_status_or_null": "string(1)",
            "return_flag": "string(1)", "line_status": "string(1)", "quantity_bucket": "integer", "event_id": "biginteger", "event_type": "string(16)", "customer_name_length": "integer", "balance_sign": "string(8)", "priority": "string(16)",
        }.items()
    ] + [
        {"name": "priority_order", "type": "string(16)", "values": ["5-LOW", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], "sorter": "values"},
        {"name": "status_label", "formula": "CASE WHEN {order_status} = 'F' THEN 'finished' ELSE 'open' END"},
    ],
    "datasources": {
        "sales": {
            "tables": {
                "orders": {
                    "type": "metric", "primary_key": ["order_id"], "priority": 2,
                    "columns": {
                        "o_orderkey": {"fields": ["order_id", "order_count"]},
                        "o_custkey": {"fields": ["customer_id", "customers"]},
                        "o_orderstatus": {"fields": ["order_status", {"name": "order_status_or_null", "ds_formula": "NULLIF(orders.o_orderstatus, 'P')"}]},
                        "o_totalprice": {"fields": [*({"name": n, "ds_formula": "CAST(orders.o_totalprice AS DECIMAL(18,4))"} for n in ("order_total", "order_mean", "order_min", "order_max", "order_total_ifnull", "grain_total"))]},
                        "o_orderdate": {"allow_type_conversions": True, "type_conversion_prefix": "order_", "disabled_type_conversions": ["hour", "minute", "hour_of_day", "minute_of_hour", "datetime"]},
                        "o_orderpriority": {"fields": ["priority", "priority_order"]},
                    },
                },
                "lineitem": {
                    "type": "metric", "primary_key": ["order_id", "line_number"], "parent": "orders", "priority": 2,
                    "columns": {
                        "l_orderkey": {"fields": ["order_id", "line_count"]},
                        "l_linenumber": {"fields": ["line_number"]},
                        "l_partkey": {"fields": ["part_id"]},
                        "l_suppkey": {"fields": ["supplier_id"]},
                        "l_quantity": {"fields": ["quantity", {"name": "quantity_bucket", "ds_formula": "CAST(FLOOR(lineitem.l_quantity / 10) AS INT)"}]},
                        "l_extendedprice": {"fields": [{"name": "revenue", "ds_formula": f"SUM({REVENUE})"}, {"name": "price_min", "ds_formula": "CAST(lineitem.l_extendedprice AS DECIMAL(18,4))"}, {"name": "highest_price", "ds_formula": "CAST(lineitem.l_extendedprice AS DECIMAL(18,4))"}]},
                        "l_discount": {"fields": ["discount_w", {"name": "discount_price_w", "ds_formula": "SUM(lineitem.l_discount*lineitem.l_extendedprice)/SUM(lineitem.l_extendedprice)"}]},
                        "l_returnflag": {"fields": ["return_flag"]},
                        "l_linestatus": {"fields": ["line_status"]},
                        "l_shipdate": {"allow_type_conversions": True, "type_conversion_prefix": "ship_"},
                    },
                },
                "customer": {
                    "type": "dimension", "primary_key": ["customer_id"], "parent": "customer_nation", "siblings": ["balance_signs"],
                    "columns": {"c_custkey": {"fields": ["customer_id"]}, "c_name": {"fields": ["customer_name", {"name": "customer_name_length", "ds_formula": "LENGTH(customer.c_name) + customer.c_custkey % 3"}]}, "c_nationkey": {"fields": ["customer_nation_id"]}, "c_mktsegment": {"fields": ["segment"]}},
                },
                "balance_signs": {
                    "type": "dimension", "primary_key": ["customer_id"],
                    "columns": {"c_custkey": {"fields": ["customer_id"]}, "c_acctbal": {"fields": [{"name": "balance_sign", "ds_formula": "CASE WHEN balance_signs.c_acctbal < 0 THEN 'negative' ELSE 'positive' END"}]}},
                },
                **_geo("customer", ""),
                "part": {"type": "dimension", "primary_key": ["part_id"], "columns": {"p_partkey": {"fields": ["part_id"]}, "p_brand": {"fields": ["brand"]}, "p_type": {"fields": ["part_type"]}}},
                "supplier": {"type": "dimension", "primary_key": ["supplier_id"], "parent": "supplier_nation", "columns": {"s_suppkey": {"fields": ["supplier_id"]}, "s_name": {"fields": ["supplier_name"]}, "s_nationkey": {"fields": ["supplier_nation_id"]}}},
                **_geo("supplier", "supplier_"),
            },
        },
        "web": {
            "tables": {
                "events": {
                    "type": "metric", "primary_key": ["event_id"],
                    "columns": {
                        "event_id": {"fields": ["event_id", "event_count"]},
                        "user_id": {"fields": ["customer_id"]},
                        "event_type": {"fields": ["event_type"]},
                        "value": {"fields": [{"name": "event_value", "ds_formula": "CAST(events.value AS DECIMAL(18,4))"}]},
                        "ts": {"allow_type_conversions": True, "type_conversion_prefix": "event_"},
                    },
                }
            }
        },
    },
}

FILES = {"customer_nation": "nation", "supplier_nation": "nation", "customer_region": "region", "supplier_region": "region", "balance_signs": "customer"}


def frames(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, Callable[[], DataFrame]]]:
    """Readers of the tables; only those that a request needs are opened."""

    def reader(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.parquet(f"{sf_dir}/{FILES.get(name, name)}.parquet")

    return {ds: {t: reader(t) for t in c["tables"]} for ds, c in CONFIG["datasources"].items()}


def warehouse(spark: SparkSession, sf_dir: str, **kw) -> Warehouse:
    return Warehouse(spark, CONFIG, frames=frames(spark, sf_dir), check=False, **kw)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, metrics: list | None = None, dimensions: list | None = None, **params) -> None:
    QUERIES[name] = lambda spark, sf_dir: warehouse(spark, sf_dir).execute(metrics, dimensions, **params).df
    if sql:
        SQL[name] = sql


OT = "round_even(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE), 2)"
SUM_OT = "CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE)"
SUM_REV = "CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE)"
REV = f"round_even({SUM_REV}, 2)"
GEO = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
OC = f"orders JOIN {GEO.replace('customer JOIN', 'customer ON o_custkey = c_custkey JOIN', 1)}"
LO = f"lineitem JOIN {OC.replace('orders JOIN', 'orders ON l_orderkey = o_orderkey JOIN', 1)}"

# Scans, dimensions, aggregates
_add("scan_project", "SELECT DISTINCT n_name AS nation_name, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey", None, ["nation_name", "region_name"])
_add("dims_distinct", "SELECT DISTINCT c_mktsegment AS segment FROM customer", None, ["segment"])
_add("dims_joined", f"SELECT DISTINCT c_mktsegment AS segment, r_name AS region_name FROM {GEO}", None, ["segment", "region_name"])
_add("global_agg", f"SELECT {OT} AS order_total, COUNT(o_orderkey) AS order_count, COUNT(DISTINCT o_custkey) AS customers FROM orders", ["order_total", "order_count", "customers"])
for _n, _m, _s in [
    ("sum", "order_total", OT), ("mean", "order_mean", f"round_even({SUM_OT} / COUNT(*), 4)"), ("min", "order_min", "MIN(o_totalprice)"), ("max", "order_max", "MAX(o_totalprice)"),
    ("count", "order_count", "COUNT(o_orderkey)"), ("count_distinct", "customers", "COUNT(DISTINCT o_custkey)"),
]:
    _add(f"agg_{_n}", f"SELECT o_orderstatus AS order_status, {_s} AS {_m} FROM orders GROUP BY 1", [_m], ["order_status"])
_add("agg_weighted_mean", "SELECT l_returnflag AS return_flag, round_even(SUM(l_discount * l_quantity) / SUM(l_quantity), 6) AS discount_w FROM lineitem GROUP BY 1", ["discount_w"], ["return_flag"])
_add("agg_ds_formula", f"SELECT l_returnflag AS return_flag, {REV} AS revenue FROM lineitem GROUP BY 1", ["revenue"], ["return_flag"])
_add("ds_formula_scalar", "SELECT l_linestatus AS line_status, round_even(SUM(l_discount * l_extendedprice) / SUM(l_extendedprice), 6) AS discount_price_w FROM lineitem GROUP BY 1", ["discount_price_w"], ["line_status"])
_add("dim_ds_formula", "SELECT CAST(floor(l_quantity / 10) AS INTEGER) AS quantity_bucket, COUNT(l_orderkey) AS line_count FROM lineitem GROUP BY 1", ["line_count"], ["quantity_bucket"])

# Criteria
_BY_SEGMENT = f"SELECT c_mktsegment AS segment, {OT} AS order_total, COUNT(o_orderkey) AS order_count FROM {OC} WHERE {{}} GROUP BY 1"
for _n, _c, _s in [
    ("eq", ("segment", "=", "BUILDING"), "c_mktsegment = 'BUILDING'"), ("ne", ("segment", "!=", "BUILDING"), "c_mktsegment <> 'BUILDING'"),
    ("gt", ("customer_id", ">", 100), "o_custkey > 100"), ("ge", ("customer_id", ">=", 100), "o_custkey >= 100"), ("lt", ("customer_id", "<", 100), "o_custkey < 100"), ("le", ("customer_id", "<=", 100), "o_custkey <= 100"),
    ("eq_list", ("segment", "=", ["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')"), ("ne_list", ("segment", "!=", ["BUILDING", "MACHINERY"]), "(c_mktsegment <> 'BUILDING' OR c_mktsegment <> 'MACHINERY')"),
    ("null", ("order_status_or_null", "=", None), "o_orderstatus = 'P'"), ("in", ("segment", "in", ["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("not_in", ("segment", "not in", ["BUILDING", "MACHINERY"]), "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ("in_null", ("order_status_or_null", "in", ["F", None]), "o_orderstatus IN ('F', 'P')"), ("not_in_null", ("order_status_or_null", "not in", ["F", None]), "o_orderstatus NOT IN ('F', 'P')"),
    ("between", ("customer_id", "between", [20, 90]), "o_custkey BETWEEN 20 AND 90"), ("not_between", ("customer_id", "not between", [20, 90]), "o_custkey NOT BETWEEN 20 AND 90"),
    ("like", ("nation_name", "like", "%A"), "n_name LIKE '%A'"), ("like_list", ("nation_name", "like", ["%A", "%N%1%"]), "(n_name LIKE '%A' OR n_name LIKE '%N%1%')"), ("not_like", ("nation_name", "not like", ["%A", "%1%"]), "(n_name NOT LIKE '%A' AND n_name NOT LIKE '%1%')"),
    ("ds_formula", ("customer_name_length", ">", 19), "length(c_name) + c_custkey % 3 > 19"),
]:
    _add(f"filter_{_n}", _BY_SEGMENT.format(_s), ["order_total", "order_count"], ["segment"], criteria=[_c])
_SUB = f"(SELECT n_name FROM {OC} GROUP BY 1 HAVING COUNT(o_orderkey) > (SELECT COUNT(*) / 25 FROM orders))"


def _filter_report(op: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = warehouse(spark, sf_dir)
        most = w.execute(["order_count"]).df.first()[0] / 25
        sub = {"metrics": ["order_count"], "dimensions": ["nation_name"], "row_filters": [("order_count", ">", most)]}
        return w.execute(["order_total", "order_count"], ["segment"], criteria=[("nation_name", op, sub)]).df

    return query


QUERIES["filter_in_report"], QUERIES["filter_not_in_report"] = _filter_report("in report"), _filter_report("not in report")
SQL["filter_in_report"], SQL["filter_not_in_report"] = _BY_SEGMENT.format(f"n_name IN {_SUB}"), _BY_SEGMENT.format(f"n_name NOT IN {_SUB}")

# Joins
_add("join_one_hop", f"SELECT c_mktsegment AS segment, {OT} AS order_total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", ["order_total"], ["segment"])
_add("join_snowflake", f"SELECT r_name AS region_name, {OT} AS order_total FROM {OC} GROUP BY 1", ["order_total"], ["region_name"])
_add("join_orthogonal", f"SELECT p_brand AS brand, c_mktsegment AS segment, {REV} AS revenue FROM {LO} JOIN part ON l_partkey = p_partkey GROUP BY 1, 2", ["revenue"], ["brand", "segment"])
_add("join_parent_metric", f"SELECT o_orderstatus AS order_status, {REV} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1", ["revenue"], ["order_status"])
_add("join_sibling", f"SELECT CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'positive' END AS balance_sign, {OT} AS order_total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", ["order_total"], ["balance_sign"])
_add("drill_across", f"SELECT * FROM (SELECT n_name AS nation_name, {REV} AS revenue FROM {LO} GROUP BY 1) FULL JOIN (SELECT n_name AS nation_name, {OT} AS order_total, COUNT(o_orderkey) AS order_count FROM {OC} GROUP BY 1) USING (nation_name)", ["revenue", "order_total", "order_count"], ["nation_name"])
_EV = "SELECT user_id AS customer_id, COUNT(event_id) AS event_count, round_even(CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS event_value FROM events GROUP BY 1"
_add("drill_across_datasources", f"SELECT * FROM (SELECT o_custkey AS customer_id, COUNT(o_orderkey) AS order_count FROM orders GROUP BY 1) FULL JOIN ({_EV}) USING (customer_id)", ["order_count", "event_count", "event_value"], ["customer_id"])
_add("drill_across_null_dim", f"SELECT a.order_status_or_null, revenue, order_count FROM (SELECT NULLIF(o_orderstatus, 'P') AS order_status_or_null, {REV} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) a JOIN (SELECT NULLIF(o_orderstatus, 'P') AS order_status_or_null, COUNT(o_orderkey) AS order_count FROM orders GROUP BY 1) b ON a.order_status_or_null IS NOT DISTINCT FROM b.order_status_or_null", ["revenue", "order_count"], ["order_status_or_null"])

# Formulas
_RO = f"SELECT n_name AS nation_name, a.r AS r, b.n AS n FROM (SELECT n_name, {SUM_REV} AS r FROM {LO} GROUP BY 1) a FULL JOIN (SELECT n_name, COUNT(o_orderkey) AS n FROM {OC} GROUP BY 1) b USING (n_name)"
_add("formula_metric", f"SELECT nation_name, round_even(r / n, 4) AS revenue_per_order FROM ({_RO})", ["revenue_per_order"], ["nation_name"])
_add("formula_nested", f"SELECT nation_name, round_even(2 * (r / n), 4) AS revenue_per_order_twice FROM ({_RO})", ["revenue_per_order_twice"], ["nation_name"])
_add("formula_weighted", f"SELECT nation_name, round_even((r / n) * n / n, 4) AS revenue_per_order_w FROM ({_RO})", ["revenue_per_order_w"], ["nation_name"])
_add("formula_adhoc", f"SELECT c_mktsegment AS segment, round_even({SUM_OT} / COUNT(o_orderkey), 3) AS mean_order FROM {OC} GROUP BY 1", [{"name": "mean_order", "formula": "{order_total}/{order_count}", "rounding": 3}], ["segment"])
_add("formula_dimension", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END AS status_label, COUNT(o_orderkey) AS order_count FROM orders GROUP BY 1", ["order_count"], ["status_label"])
_add("adhoc_dimension", "SELECT CAST(n_name LIKE '%A' AS INTEGER) AS ends_in_a, COUNT(o_orderkey) AS order_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", ["order_count"], [{"name": "ends_in_a", "formula": "{nation_name} LIKE '%A'"}])
_add("metric_ifnull", f"SELECT customer_id, event_count, coalesce(order_total_ifnull, 0.0) AS order_total_ifnull FROM ({_EV}) FULL JOIN (SELECT o_custkey AS customer_id, {OT} AS order_total_ifnull FROM orders GROUP BY 1) USING (customer_id)", ["event_count", "order_total_ifnull"], ["customer_id"])
_add("divisor_metric", f"SELECT l_returnflag AS return_flag, round_even({SUM_REV} / COUNT(l_orderkey), 4) AS revenue_per_line_count FROM lineitem GROUP BY 1", ["revenue_per_line_count"], ["return_flag"])
_add("aggregation_variants", "SELECT l_returnflag AS return_flag, MIN(l_extendedprice) AS price_min, MAX(l_extendedprice) AS highest_price FROM lineitem GROUP BY 1", ["price_min", "highest_price"], ["return_flag"])

# Rollups
_R3 = f"SELECT r_name AS region_name, n_name AS nation_name, c_mktsegment AS segment, {SUM_OT} AS v, COUNT(o_orderkey) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) AS m FROM {OC} GROUP BY 1, 2, 3"
_LEVEL = "CAST(GROUPING(region_name) + GROUPING(nation_name) + GROUPING(segment) AS INTEGER) AS rollup_level"
_D3 = ["region_name", "nation_name", "segment"]
_SETS = {"totals": "(region_name, nation_name, segment), ()", "k1": "(region_name, nation_name, segment), (region_name)", "k2": "(region_name, nation_name, segment), (region_name), (region_name, nation_name)", "all": "(region_name, nation_name, segment), (region_name), (region_name, nation_name), ()"}
for _n, _r in [("totals", "totals"), ("k1", 1), ("k2", 2), ("all", "all")]:
    _add(f"rollup_{_n}", f"SELECT region_name, nation_name, segment, round_even(SUM(v), 2) AS order_total, CAST(SUM(n) AS BIGINT) AS order_count, {_LEVEL} FROM ({_R3}) GROUP BY GROUPING SETS ({_SETS[_n]})", ["order_total", "order_count"], _D3, rollup=_r)
_add("rollup_mean", f"SELECT region_name, nation_name, segment, round_even(AVG(m), 4) AS order_mean, {_LEVEL} FROM ({_R3}) GROUP BY GROUPING SETS ({_SETS['all']})", ["order_mean"], _D3, rollup="all")
_add("rollup_null_dim", "SELECT order_status_or_null, segment, CAST(SUM(n) AS BIGINT) AS order_count, CAST(GROUPING(order_status_or_null) + GROUPING(segment) AS INTEGER) AS rollup_level FROM (SELECT NULLIF(o_orderstatus, 'P') AS order_status_or_null, c_mktsegment AS segment, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY GROUPING SETS ((order_status_or_null, segment), (order_status_or_null), ())", ["order_count"], ["order_status_or_null", "segment"], rollup="all")
_add("rollup_weighted", "SELECT return_flag, line_status, round_even(SUM(d * q) / SUM(q), 6) AS discount_w, CAST(GROUPING(return_flag) + GROUPING(line_status) AS INTEGER) AS rollup_level FROM (SELECT l_returnflag AS return_flag, l_linestatus AS line_status, SUM(l_discount * l_quantity) / SUM(l_quantity) AS d, SUM(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY GROUPING SETS ((return_flag, line_status), (return_flag), ())", ["discount_w"], ["return_flag", "line_status"], rollup="all")

# Technicals
_T = f"SELECT r_name AS region_name, strftime(o_orderdate, '%Y-%m') AS order_month, {SUM_OT} AS x FROM {OC} GROUP BY 1, 2"
_W, _R = "(PARTITION BY region_name ORDER BY order_month NULLS FIRST)", "(PARTITION BY region_name ORDER BY order_month NULLS FIRST ROWS 2 PRECEDING)"
_C = "(PARTITION BY region_name ORDER BY order_month NULLS FIRST ROWS UNBOUNDED PRECEDING)"
for _n, _s in {
    "mean": f"AVG(x) OVER {_R}", "sum": f"SUM(x) OVER {_R}", "median": f"MEDIAN(x) OVER {_R}", "std": f"STDDEV_SAMP(x) OVER {_R}", "var": f"VAR_SAMP(x) OVER {_R}", "min": f"MIN(x) OVER {_R}", "max": f"MAX(x) OVER {_R}",
    "diff": f"x - LAG(x) OVER {_W}", "pct_change": f"x / LAG(x) OVER {_W} - 1", "cumsum": f"SUM(x) OVER {_C}", "cummin": f"MIN(x) OVER {_C}", "cummax": f"MAX(x) OVER {_C}",
    "rank": "RANK() OVER (PARTITION BY region_name ORDER BY x) + (COUNT(x) OVER (PARTITION BY region_name, x) - 1) / 2.0", "pct_rank": "(RANK() OVER (PARTITION BY region_name ORDER BY x) + (COUNT(x) OVER (PARTITION BY region_name, x) - 1) / 2.0) / COUNT(x) OVER (PARTITION BY region_name)",
    "cumsum_all": "SUM(x) OVER (ORDER BY region_name, order_month ROWS UNBOUNDED PRECEDING)", "min_periods": f"CASE WHEN COUNT(x) OVER {_R} >= 2 THEN AVG(x) OVER {_R} END",
    "center": "AVG(x) OVER (PARTITION BY region_name ORDER BY order_month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
}.items():
    _add(f"tech_{_n}", f"SELECT region_name, order_month, round_even(CAST({_s} AS DOUBLE), 4) AS tech_{_n} FROM ({_T})", [f"tech_{_n}"], ["region_name", "order_month"])
_add("tech_boll", f"SELECT region_name, order_month, round_even(m, 4) AS tech_boll, round_even(m - 2 * s, 4) AS tech_boll_lower, round_even(m + 2 * s, 4) AS tech_boll_upper FROM (SELECT *, AVG(x) OVER {_R} AS m, STDDEV_SAMP(x) OVER {_R} AS s FROM ({_T}))", ["tech_boll"], ["region_name", "order_month"])
_add("tech_no_dims", f"SELECT round_even({SUM_OT}, 4) AS tech_cumsum FROM orders", ["tech_cumsum"])

# Order, limits, filters, pivot
QUERIES["order_by_metric"] = lambda spark, sf_dir: numbered(warehouse(spark, sf_dir).execute(["order_count", "order_total"], ["nation_name"], order_by=[("order_count", "desc")]).df)
SQL["order_by_metric"] = f"SELECT *, row_number() OVER (ORDER BY order_count DESC, nation_name) AS row_number FROM (SELECT n_name AS nation_name, COUNT(o_orderkey) AS order_count, {OT} AS order_total FROM {OC} GROUP BY 1)"
QUERIES["order_by_sorter"] = lambda spark, sf_dir: numbered(warehouse(spark, sf_dir).execute(["order_count"], ["priority_order"]).df)
SQL["order_by_sorter"] = "SELECT *, row_number() OVER (ORDER BY list_position(['5-LOW', '1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'], priority_order)) AS row_number FROM (SELECT o_orderpriority AS priority_order, COUNT(*) AS order_count FROM orders GROUP BY 1)"
_add("limit_topk", f"SELECT c_name AS customer_name, {OT} AS order_total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", ["order_total"], ["customer_name"], order_by=[("order_total", "desc")], limit=10)
_add("limit_first_totals", f"WITH t AS (SELECT n_name AS nation_name, {SUM_OT} AS v FROM {OC} GROUP BY 1 ORDER BY 1 LIMIT 4) SELECT nation_name, round_even(v, 2) AS order_total, 0 AS rollup_level FROM t UNION ALL SELECT NULL, round_even(SUM(v), 2), 1 FROM t", ["order_total"], ["nation_name"], limit=4, limit_first=True, rollup="totals")
_NC = f"SELECT n_name AS nation_name, COUNT(o_orderkey) AS order_count FROM {OC} GROUP BY 1"
_add("row_filter", f"SELECT * FROM ({_NC}) WHERE order_count > 20 AND order_count <= 700", ["order_count"], ["nation_name"], row_filters=[("order_count", ">", 20), ("order_count", "<=", 700)])
_add("row_filter_ne", "SELECT * FROM (SELECT o_custkey AS customer_id, COUNT(o_orderkey) AS order_count FROM orders GROUP BY 1) FULL JOIN (SELECT user_id AS customer_id, COUNT(event_id) AS event_count FROM events GROUP BY 1) USING (customer_id) WHERE order_count IS DISTINCT FROM 10", ["order_count", "event_count"], ["customer_id"], row_filters=[("order_count", "!=", 10)])
_add("row_filter_rollup", f"SELECT * FROM (SELECT nation_name, CAST(SUM(order_count) AS BIGINT) AS order_count, CAST(GROUPING(nation_name) AS INTEGER) AS rollup_level FROM ({_NC}) GROUP BY GROUPING SETS ((nation_name), ())) WHERE order_count > 610", ["order_count"], ["nation_name"], rollup="totals", row_filters=[("order_count", ">", 610)])
_PV = ", ".join(f"CAST(SUM(CASE WHEN quarter(o_orderdate) = {q} THEN 1 END) AS BIGINT) AS order_count_{q}" for q in range(1, 5))
_add("pivot_one", f"SELECT r_name AS region_name, {_PV} FROM {OC} GROUP BY 1", ["order_count"], ["region_name", "order_quarter_of_year"], pivot=["order_quarter_of_year"])
_add("pivot_rollup", None, ["order_count"], ["region_name", "order_quarter_of_year"], pivot=["order_quarter_of_year"], rollup="all")
SQL["pivot_rollup"] = f'''SELECT r_name AS region_name, 0 AS rollup_level, {_PV}, CAST(NULL AS BIGINT) AS "order_count_::" FROM {OC} GROUP BY 1
    UNION ALL SELECT r_name, 1, NULL, NULL, NULL, NULL, COUNT(*) FROM {OC} GROUP BY 1 UNION ALL SELECT NULL, 2, NULL, NULL, NULL, NULL, COUNT(*) FROM {OC}'''
_add("rounding", f"SELECT n_name AS nation_name, round_even({SUM_OT} / 1000, 1) AS thousands FROM {OC} GROUP BY 1", [{"name": "thousands", "formula": "{order_total}/1000", "rounding": 1}], ["nation_name"])
QUERIES["display_names"] = lambda spark, sf_dir: warehouse(spark, sf_dir).execute(["order_count"], ["nation_name"], rollup="totals").df_display
SQL["display_names"] = f'SELECT n_name AS "Nation Name", COUNT(o_orderkey) AS "Order Count" FROM {OC} GROUP BY 1 UNION ALL SELECT \'::\', COUNT(*) FROM orders'


def numbered(df: DataFrame) -> DataFrame:
    """df with the place of each row in its order; for results of a report's size."""
    from pyspark.sql import Window

    at = df.withColumn("row_at", F.monotonically_increasing_id())
    return at.withColumn("row_number", F.row_number().over(Window.orderBy("row_at"))).drop("row_at")


# Dates
_PARTS = {
    "year": "CAST(year({c}) AS INTEGER)", "quarter": "strftime({c}, '%Y') || '-Q' || quarter({c})", "quarter_of_year": "CAST(quarter({c}) AS INTEGER)", "month": "strftime({c}, '%Y-%m')", "month_name": "monthname({c})",
    "month_of_year": "CAST(month({c}) AS INTEGER)", "week": "strftime({c}, '%Y') || '-W' || lpad(CAST(weekofyear({c}) AS VARCHAR), 2, '0')", "week_of_year": "CAST(weekofyear({c}) AS INTEGER)",
    "week_of_month": "CAST(weekofyear({c}) - weekofyear(date_trunc('month', {c})) + 1 AS INTEGER)", "period_of_month_7d": "CAST((day({c}) - 1) // 7 + 1 AS INTEGER)", "date": "strftime({c}, '%Y-%m-%d')", "day_name": "dayname({c})",
    "day_of_week": "CAST(isodow({c}) AS INTEGER)", "is_weekday": "CAST(isodow({c}) < 6 AS INTEGER)", "day_of_month": "CAST(day({c}) AS INTEGER)", "day_of_year": "CAST(dayofyear({c}) AS INTEGER)",
    "hour": "strftime({c}, '%Y-%m-%d %H:00:00')", "hour_of_day": "CAST(hour({c}) AS INTEGER)", "minute": "strftime({c}, '%Y-%m-%d %H:%M:00')", "minute_of_hour": "CAST(minute({c}) AS INTEGER)", "datetime": "strftime({c}, '%Y-%m-%d %H:%M:%S')",
}
_add("date_dims", f"SELECT {', '.join(f'{s.format(c='ts')} AS event_{p}' for p, s in _PARTS.items())}, COUNT(event_id) AS event_count FROM events GROUP BY ALL", ["event_count"], [f"event_{p}" for p in _PARTS])
_DAY = [p for p in _PARTS if p not in ("hour", "hour_of_day", "minute", "minute_of_hour", "datetime")]
_add("date_dims_orders", f"SELECT {', '.join(f'{s.format(c='o_orderdate')} AS order_{p}' for p, s in _PARTS.items() if p in _DAY)}, COUNT(o_orderkey) AS order_count FROM orders GROUP BY ALL", ["order_count"], [f"order_{p}" for p in _DAY])
_VALUES = {"year": (2023, 2024, 2025), "month": ("2023-12", "2024-01", "2024-02"), "date": ("2024-01-05", "2024-01-10", "2024-01-20"), "hour": ("2024-01-05 04:00:00", "2024-01-10 12:00:00", "2024-01-20 20:00:00"), "minute": ("2024-01-05 04:10:00", "2024-01-10 12:30:00", "2024-01-20 20:50:00"), "datetime": ("2024-01-05 04:10:05", "2024-01-10 12:30:30", "2024-01-20 20:50:50")}
for _k, (_a, _b, _c3) in _VALUES.items():
    for _n, _op in [("eq", "="), ("ne", "!="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="), ("between", "between"), ("not_between", "not between")]:
        _x = _PARTS[_k].format(c="ts") if _k != "datetime" else "ts"
        _q = (lambda v: str(v) if isinstance(v, int) else f"TIMESTAMP '{v}'" if _k == "datetime" else f"'{v}'")
        _v = [_a, _c3] if "between" in _n else _b
        _where = f"{_x} {_op.upper()} {_q(_a)} AND {_q(_c3)}" if "between" in _n else f"{_x} {'<>' if _op == '!=' else _op} {_q(_b)}"
        _add(f"date_crit_{_k}_{_n}", f"SELECT event_type, COUNT(event_id) AS event_count FROM events WHERE {_where} GROUP BY 1", ["event_count"], ["event_type"], criteria=[(f"event_{_k}", _op, _v)])

# Routing
_SUMMARY = {
    "type": "metric", "primary_key": ["segment", "order_year"], "priority": 1,
    "columns": {"segment": {"fields": ["segment"]}, "order_year": {"fields": ["order_year"]}, "n": {"fields": [{"name": "order_count", "ds_formula": "SUM(order_summary.n)"}]}, "total": {"fields": ["order_total"]}},
}


def _routed(spark: SparkSession, sf_dir: str, own_source: bool = False, table: dict | None = None, ds_priority: list | None = None) -> Warehouse:
    """The warehouse with a table of orders summed up by segment and year."""
    from copy import deepcopy

    config, data = deepcopy(CONFIG), frames(spark, sf_dir)
    o, c = data["sales"]["orders"](), data["sales"]["customer"]()
    summary = o.join(c, o.o_custkey == c.c_custkey).groupBy(c.c_mktsegment.alias("segment"), F.year("o_orderdate").alias("order_year")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,4)")).alias("total"))
    ds = "summaries" if own_source else "sales"
    config["datasources"].setdefault(ds, {"tables": {}})["tables"]["order_summary"] = deepcopy(_SUMMARY) | (table or {})
    data.setdefault(ds, {})["order_summary"] = summary
    if own_source:
        config["dimensions"].append({"name": "order_year", "type": "smallinteger"})
    return Warehouse(spark, config, frames=data, check=False, ds_priority=ds_priority)


def _route(expect: str, dims: list[str], criteria: list | None = None, disabled: list | None = None, **kw) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = _routed(spark, sf_dir, **kw).report(metrics=["order_count", "order_total"], dimensions=dims, criteria=criteria, disabled_tables=disabled)
        if (found := [q.table_set.base.name for q in r.queries]) != expect.split():
            raise AssertionError(f"routed to {found}, not {expect}")
        return r.frame()

    return query


_BS = f"SELECT c_mktsegment AS segment, COUNT(o_orderkey) AS order_count, {OT} AS order_total FROM {OC} {{}} GROUP BY 1"
for _n, _qry, _w in [
    ("priority", _route("order_summary", ["segment"]), ""), ("disabled", _route("orders", ["segment"], disabled=["order_summary"]), ""), ("ds_priority", _route("order_summary", ["segment"], own_source=True, ds_priority=["summaries", "sales"]), ""),
    ("criteria_limit", _route("order_summary", ["segment"], criteria=[("order_year", ">=", 1998)], table={"criteria_limits": [["order_year", ">=", 1997]]}), "WHERE year(o_orderdate) >= 1998"),
    ("criteria_limit_unmet", _route("orders", ["segment"], criteria=[("order_year", ">=", 1996)], table={"criteria_limits": [["order_year", ">=", 1997]]}), "WHERE year(o_orderdate) >= 1996"),
    # the summary's total asks for the year, so it doesn't come from there with the count
    ("column_grain", _route("order_summary orders", ["segment"], own_source=True, ds_priority=["summaries", "sales"], table={"columns": _SUMMARY["columns"] | {"total": {"fields": ["order_total"], "required_grain": ["order_year"]}}}), ""),
    # a table without BUILDING has no row of a null segment either
    ("limit_null", _route("orders", ["segment"], criteria=[("segment", "=", None)], table={"criteria_limits": [["segment", "!=", "BUILDING"]]}), "WHERE c_mktsegment IS NULL"),
    ("limit_not", _route("order_summary", ["segment"], criteria=[("segment", "in", ["MACHINERY", "FURNITURE"])], table={"criteria_limits": [["segment", "!=", "BUILDING"]]}), "WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE')"),
]:
    QUERIES[f"route_{_n}"], SQL[f"route_{_n}"] = _qry, _BS.format(_w)
_add("partial_report", "SELECT event_type, COUNT(event_id) AS event_count FROM events GROUP BY 1", ["event_count", "order_count"], ["event_type"], allow_partial=True)
_add("required_grain_ok", f"SELECT c_mktsegment AS segment, {OT} AS grain_total FROM {OC} GROUP BY 1", ["grain_total"], ["segment"])


def _converted(op: str, value: object) -> Query:
    """Criteria on a bucket of quantities that its field turns into ranges of the quantity itself."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from copy import deepcopy

        config = deepcopy(CONFIG)
        bucket = config["datasources"]["sales"]["tables"]["lineitem"]["columns"]["l_quantity"]["fields"][1]
        bucket["ds_criteria_conversions"] = {"=": [[">=", "10.0 * :0"], ["<", "10.0 * :0 + 10"]], "between": [[">=", "10.0 * :0"], ["<", "10.0 * :1 + 10"]]}
        w = Warehouse(spark, config, frames=frames(spark, sf_dir), check=False)
        return w.execute(["line_count"], ["return_flag"], criteria=[("quantity_bucket", op, value)]).df

    return query


for _n, _qry, _w in [("eq", _converted("=", 2), "= 2"), ("between", _converted("between", [1, 3]), "BETWEEN 1 AND 3"), ("gt", _converted(">", 2), "> 2")]:
    QUERIES[f"criteria_conversion_{_n}"], SQL[f"criteria_conversion_{_n}"] = _qry, f"SELECT l_returnflag AS return_flag, COUNT(*) AS line_count FROM lineitem WHERE CAST(FLOOR(l_quantity / 10) AS INTEGER) {_w} GROUP BY 1"


# Sources
def _file_query(kind: str) -> Query:
    """nation.parquet written in another format and reported from there."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        import json
        import tempfile
        from pathlib import Path

        folder = Path(tempfile.mkdtemp(prefix="lattica-files-"))
        rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]
        names = list(rows[0])
        path = folder / f"nations.{kind}"
        if kind == "csv":
            path.write_text("\n".join([",".join(names), *(",".join(str(r[n]) for n in names) for r in rows)]))
        elif kind == "json":
            path.write_text(json.dumps({"schema": {}, "data": rows}))
        elif kind == "html":
            path.write_text("<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>" + "".join("<tr>" + "".join(f"<td>{r[n]}</td>" for n in names) + "</tr>" for r in rows) + "</table>")
        columns = {"n_nationkey": {"fields": ["nation_key"]}, "n_name": {"fields": ["nation"]}, "n_regionkey": {"fields": ["region_key", "keys"]}}
        config = {"metrics": [{"name": "keys", "type": "biginteger", "aggregation": "count"}], "dimensions": [{"name": "nation_key", "type": "integer"}, {"name": "nation", "type": "string"}, {"name": "region_key", "type": "integer"}]}
        data = rows if kind == "rows" else str(path)
        w = Warehouse.from_tables(spark, [AdHocTable("nations", data, "metric", ["nation_key"], columns)], config=config)
        return w.execute(["keys"], ["region_key"]).df

    return query


for _n, _k in [("adhoc_rows", "rows"), ("csv_roundtrip", "csv"), ("json_table", "json"), ("html_table", "html")]:
    QUERIES[_n], SQL[_n] = _file_query(_k), "SELECT n_regionkey AS region_key, COUNT(*) AS keys FROM nation GROUP BY 1"


def _adhoc(name: str, sql: str, data: Callable[[SparkSession, str], DataFrame], columns: dict, key: list[str], metrics: list[dict], dims: list[dict], ask: tuple, **kw) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = Warehouse.from_tables(spark, [AdHocTable("t", data(spark, sf_dir), "metric", key, columns, **kw)], config={"metrics": metrics, "dimensions": dims})
        return w.execute(*ask).df

    QUERIES[name], SQL[name] = query, sql


_CUST = {"c_custkey": {"fields": ["id"]}, "c_mktsegment": {"fields": ["segment"]}, "c_acctbal": {"fields": ["n"]}}
_N, _SEG = [{"name": "n", "type": "float", "aggregation": "count"}], [{"name": "id", "type": "string"}, {"name": "segment", "type": "string"}]
_adhoc("drop_dupes", "SELECT c_mktsegment AS segment, COUNT(*) AS n FROM customer GROUP BY 1", lambda s, d: (lambda x: x.unionByName(x))(s.read.parquet(f"{d}/customer.parquet").select(*_CUST)), _CUST, ["id"], _N, _SEG, (["n"], ["segment"]), drop_dupes=True)
_adhoc("convert_types", "SELECT c_mktsegment AS segment, CAST(SUM(CAST(c_custkey AS INTEGER)) AS BIGINT) AS s FROM customer GROUP BY 1", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string"), "c_mktsegment"), {"c_custkey": {"fields": ["id", "s"]}, "c_mktsegment": {"fields": ["segment"]}}, ["id"], [{"name": "s", "type": "biginteger"}], _SEG, (["s"], ["segment"]), convert_types={"c_custkey": "integer"})
_adhoc("fillna_pk", "SELECT COALESCE(NULLIF(c_mktsegment, 'BUILDING'), '') AS segment, COUNT(*) AS n FROM customer GROUP BY 1", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("c_mktsegment"), "c_acctbal"), _CUST, ["id", "segment"], _N, _SEG, (["n"], ["segment"]), fillna_value="")


# Results of questions
def _two(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    w = warehouse(spark, sf_dir)
    return [w.execute(["order_count"], ["nation_name"]).df, w.execute(["order_total"], ["nation_name"], criteria=[("segment", "=", "BUILDING")]).df]


_A, _B = f"(SELECT n_name AS nation_name, COUNT(o_orderkey) AS order_count FROM {OC} GROUP BY 1)", f"(SELECT n_name AS nation_name, {OT} AS order_total FROM {OC} WHERE c_mktsegment = 'BUILDING' GROUP BY 1)"
QUERIES["combine_merge"] = lambda s, d: wrangle.merge(_two(s, d), ["nation_name"])
QUERIES["combine_join"] = lambda s, d: wrangle.join_on_index(_two(s, d), [["nation_name"], ["nation_name"]])
SQL["combine_merge"] = SQL["combine_join"] = f"SELECT * FROM {_A} FULL JOIN {_B} USING (nation_name)"
QUERIES["combine_concat"] = lambda s, d: wrangle.concat_rows(_two(s, d))
SQL["combine_concat"] = f"SELECT 1 AS report_index, nation_name, order_count, CAST(NULL AS DOUBLE) AS order_total FROM {_A} UNION ALL SELECT 2, nation_name, NULL, order_total FROM {_B}"
QUERIES["wrangle_chain"] = lambda s, d: wrangle.apply(wrangle.merge(_two(s, d), ["nation_name"]), [
    {"op": "fillna", "value": 0, "columns": ["order_total"]}, {"op": "filter_rows", "column": "order_count", "operator": ">", "value": 20}, {"op": "rename_columns", "columns": {"nation_name": "nation"}},
    {"op": "sort_values", "by": ["order_count"], "ascending": False}, {"op": "select_columns", "columns": ["nation", "order_total"]},
])
SQL["wrangle_chain"] = f"SELECT nation_name AS nation, COALESCE(order_total, 0.0) AS order_total FROM {_A} FULL JOIN {_B} USING (nation_name) WHERE order_count > 20"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and orders of one region by nation: two fact tables, joins, a formula, rollup and order."""
    w = warehouse(spark, sf_dir)
    return w.execute(["revenue", "order_count", "revenue_per_order"], ["region_name", "nation_name"], criteria=[("order_year", ">=", 1996)], rollup="all", order_by=[("revenue", "desc")]).df


QUERIES["flagship"] = flagship
SQL["flagship"] = f"""WITH t AS (SELECT region_name, nation_name, r, n FROM (SELECT r_name AS region_name, n_name AS nation_name, {SUM_REV} AS r FROM {LO} WHERE year(o_orderdate) >= 1996 GROUP BY 1, 2)
    FULL JOIN (SELECT r_name AS region_name, n_name AS nation_name, COUNT(o_orderkey) AS n FROM {OC} WHERE year(o_orderdate) >= 1996 GROUP BY 1, 2) USING (region_name, nation_name))
    SELECT region_name, nation_name, round_even(SUM(r), 2) AS revenue, CAST(SUM(n) AS BIGINT) AS order_count, round_even(AVG(r / n), 4) AS revenue_per_order, CAST(GROUPING(region_name) + GROUPING(nation_name) AS INTEGER) AS rollup_level
    FROM t GROUP BY GROUPING SETS ((region_name, nation_name), (region_name), ())"""
