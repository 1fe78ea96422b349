"""Reports over the harbour, held against brute force in pandas, and what requests may not ask."""

import datetime as dt
import itertools
import random

import pandas as pd
import pytest

from lattica.errors import ConfigError, DisallowedSQL, InvalidDimensionValue, InvalidField, MaxFormulaDepth, MaxReportDepth, ReportError, UnsupportedGrain, WarehouseError
from lattica.plans.limits import Allowed, holds
from tests.fixture import CONFIG, flat, make

ALL = {n: flat(n) for n in ("calls", "boxes")}
NONE = None


@pytest.fixture(scope="module")
def w(spark):
    return make(spark)


def rows(w, *args, **kw):
    return [tuple(r) for r in w.execute(*args, **kw).rows]


def key(values):
    return tuple(NONE if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in values)


MEASURES = {
    "calls": ("calls", lambda g: g.call_id.nunique()), "boxes": ("boxes", lambda g: g.box_id.nunique()), "tonnes": ("boxes", lambda g: int(g.tonnes.sum())),
    "fee": ("boxes", lambda g: round(float(sum(x for x in g.fee if x is not NONE)), 2) if g.fee.notna().any() else NONE),
    "fee_by_weight": ("boxes", lambda g: round(float((g.fee.astype(float) * g.tonnes).sum() / g.tonnes.sum()), 4) if g.fee.notna().any() else NONE),
}


def brute(metrics, dims, keep=None):
    """Each metric over its own table, grouped by dims (nulls are values), put side by side."""
    out = {}
    for i, m in enumerate(metrics):
        table, measure = MEASURES[m]
        t = ALL[table]
        t = t[[bool(keep(r)) for r in t.to_dict("records")]] if keep else t
        groups = t.groupby(dims, dropna=False) if dims else [((), t)]
        for k, g in groups:
            out.setdefault(key(k if isinstance(k, tuple) else (k,)), [NONE] * len(metrics))[i] = measure(g)
    return out


def close(a, b):
    return a == b or a is not NONE and b is not NONE and not isinstance(a, str) and abs(float(a) - float(b)) < 2e-4


def same(got, want, n):
    got = {tuple(r[:n]): r[n:] for r in got}
    assert set(got) == set(want)
    for k, v in want.items():
        assert all(close(a, b) for a, b in zip(got[k], v, strict=False)), (k, got[k], v)


def test_any_fields_together(w):
    """Metrics of either table by dimensions at either end of the joins."""
    rng = random.Random(1)
    dims = ["quay_label", "berth_label", "crane", "ship", "quay_id", "berth_id"]
    for k in range(14):
        metrics, by = rng.sample(list(MEASURES), rng.randrange(1, 4)), rng.sample(dims, k % 4)
        same(rows(w, metrics, by), brute(metrics, by), len(by))
    for by in (["goods"], ["goods", "quay_label"], ["box_id"], ["call_id", "goods"]):
        metrics = [m for m in MEASURES if m != "calls"]
        same(rows(w, metrics, by), brute(metrics, by), len(by))


CLAUSES = {
    "=": lambda x, v: x == v if v is not NONE else x is NONE, "!=": lambda x, v: x is not NONE and x != v, ">": lambda x, v: x is not NONE and x > v, ">=": lambda x, v: x is not NONE and x >= v,
    "<": lambda x, v: x is not NONE and x < v, "<=": lambda x, v: x is not NONE and x <= v, "in": lambda x, v: x in v, "not in": lambda x, v: x is not NONE and x not in v,
    "between": lambda x, v: x is not NONE and v[0] <= x <= v[1], "not between": lambda x, v: x is not NONE and not v[0] <= x <= v[1],
}


@pytest.mark.parametrize("op", CLAUSES)
def test_criteria_of_each_kind(w, op):
    lists, pairs = {"in": 1, "not in": 1}, {"between": 1, "not between": 1}
    for name, one, many, two in (("ship", "ship 4", ["ship 1", "ship 7"], ["ship 2", "ship 5"]), ("berth_id", 21, [11, 31, 22], [12, 22]), ("crane", "tall", ["tall", "none"], ["a", "t"])):
        v = many if op in lists else two if op in pairs else one
        keep = lambda r, name=name, v=v: CLAUSES[op](NONE if pd.isna(r[name]) else r[name], v)
        same(rows(w, ["fee", "calls"], ["quay_label"], criteria=[(name, op, v)]), brute(["fee", "calls"], ["quay_label"], keep), 1)


def test_criteria_with_nulls_and_patterns(w):
    for op, keep in (("=", lambda r: pd.isna(r["ship"])), ("!=", lambda r: not pd.isna(r["ship"]))):
        same(rows(w, ["calls"], ["quay_label"], criteria=[("ship", op, NONE)]), brute(["calls"], ["quay_label"], keep), 1)
    same(rows(w, ["calls"], ["ship"], criteria=[("ship", "like", ["%1", "%2"])]), brute(["calls"], ["ship"], lambda r: str(r["ship"])[-1] in "12"), 1)
    same(rows(w, ["calls"], ["quay_label"], criteria=[("quay_label", "in", "West")]), brute(["calls"], ["quay_label"], lambda r: r["quay_label"] == "West"), 1)
    with pytest.raises(InvalidDimensionValue):
        w.report(metrics=["calls"], criteria=[("quay_label", "=", "East")])
    for bad in [("quay_or_none", "=", "x"), ("what", "=", 1), ("ship", "~", 1), ("ship", "between", 1), ("ship",)]:
        with pytest.raises(ReportError):
            w.report(metrics=["calls"], criteria=[bad])


PARTS = {
    "year": lambda t: t.year, "month": lambda t: f"{t:%Y-%m}", "date": lambda t: f"{t:%Y-%m-%d}", "hour": lambda t: f"{t:%Y-%m-%d %H}:00:00", "minute": lambda t: f"{t:%Y-%m-%d %H:%M}:00", "datetime": lambda t: f"{t:%Y-%m-%d %H:%M:%S}",
    "quarter": lambda t: f"{t.year}-Q{(t.month + 2) // 3}", "day_name": lambda t: f"{t:%A}", "week": lambda t: f"{t.year}-W{t.isocalendar()[1]:02d}", "hour_of_day": lambda t: t.hour, "day_of_year": lambda t: t.timetuple().tm_yday,
}


@pytest.mark.parametrize("part", PARTS)
def test_date_parts_and_their_criteria(w, part):
    times = ALL["calls"].arrived
    want = {}
    for t in times:
        want[PARTS[part](t)] = want.get(PARTS[part](t), 0) + 1
    assert dict(rows(w, ["calls"], [part])) == want
    if part in ("year", "month", "date", "hour", "minute", "datetime"):
        values = sorted(want)
        middle, low, high = values[len(values) // 2], values[1], values[-2]
        for op, v in (("=", middle), ("!=", middle), (">", middle), (">=", middle), ("<", middle), ("<=", middle), ("between", [low, high]), ("not between", [low, high])):
            n = sum(k for x, k in want.items() if CLAUSES[op](x, v))
            assert (rows(w, ["calls"], criteria=[(part, op, v)])[0][0] or 0) == n, (op, v)


def test_dates_by_words(w):
    assert (rows(w, ["calls"], criteria=[("date", "=", "today")])[0][0] or 0) == 0 == (rows(w, ["calls"], criteria=[("date", "=", "no date")])[0][0] or 0)
    assert rows(w, ["calls"], criteria=[("date", "<", "2 days ago")]) == [(40,)] and rows(w, ["calls"], criteria=[("date", ">", dt.date(2021, 12, 31))]) == [(40,)]
    got = rows(w, ["calls"], ["opened_month"])
    want = {}
    for t in ALL["calls"].berth_opened:
        want[f"{t:%Y-%m}"] = want.get(f"{t:%Y-%m}", 0) + 1
    assert dict(got) == want


def test_date_range_reaches_the_scan(spark):
    from lattica import catalog

    plan = catalog.warehouse(spark, "/root/testdata/sf0.001").execute(["order_count"], ["segment"], criteria=[("order_year", "=", 1996)]).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in plan and "LessThan(o_orderdate" in plan


@pytest.mark.parametrize("rollup, levels", [("totals", [0, 2]), ("all", [0, 1, 2]), (1, [0, 1]), (2, [0, 1, 2])])
def test_rollups(w, rollup, levels):
    """Sums and counts at each level; a weighted mean by all weights; ratios as means of the rows below."""
    metrics = ["boxes", "tonnes", "fee"]
    got = rows(w, metrics, ["quay_label", "berth_label"], rollup=rollup)
    assert sorted({r[-1] for r in got}) == levels
    for level in levels:
        by = ["quay_label", "berth_label"][: 2 - level]
        own = [(*r[: 2 - level], *r[2:-1]) for r in got if r[-1] == level]
        same(own, brute(metrics, by), len(by))
        assert all(r[2 - level : 2] == (NONE,) * level for r in got if r[-1] == level)
    if rollup == "totals":
        assert dict((r[0], r[1]) for r in rows(w, ["fee_by_weight"], ["quay_label"], rollup="totals")).keys() == {"North", "South", "West", NONE}
        r = w.execute(["fee"], ["quay_label"], rollup="totals")
        assert tuple(r.df_display.collect()[-1])[0] == "::" and r.rollup_rows.count() == 1 and r.non_rollup_rows.count() == 3


def test_rollup_errors_and_nulls(w):
    for bad in ({"dimensions": ["quay_label"], "rollup": 2}, {"rollup": "totals"}):
        with pytest.raises(ReportError):
            w.report(metrics=["fee"], **bad)
    got = rows(w, ["calls"], ["ship", "berth_label"], rollup="all")  # a null ship isn't a rolled-up one
    same([r[:3] for r in got if r[3] == 0], brute(["calls"], ["ship", "berth_label"]), 2)
    assert [r[2] for r in got if r[3] == 2] == [40] and sum(r[2] for r in got if r[3] == 1) == 40


def test_formulas_of_aggregates(w):
    fee, calls = brute(["fee"], ["quay_label"]), brute(["calls"], ["quay_label"])
    want = {k[0]: float(fee[k][0]) / calls[k][0] for k in fee}
    for name, times in (("fee_each", 1), ("fee_each_more", 3), ("fee_per_call", 1)):
        got = dict(rows(w, [name], ["quay_label"]))
        assert got.keys() == want.keys() and all(abs(float(got[k]) - times * want[k]) < 2e-3 for k in want)
    assert rows(w, ["no_number"]) == [(NONE,)]
    assert dict(rows(w, [{"name": "many", "formula": "{calls} > 12"}], ["quay_label"])) == {k[0]: int(v[0] > 12) for k, v in calls.items()}
    assert dict(rows(w, ["calls"], [{"name": "is_west", "formula": "{quay_label} = 'West'"}])) == {int(b): sum(v[0] for k, v in calls.items() if (k[0] == "West") == b) for b in (True, False)}
    assert dict(rows(w, ["calls"], ["quay_or_none"])) == {k[0]: v[0] for k, v in calls.items()}


def test_formula_errors(w):
    for bad in ["1; drop table x", "(select 1)", "{fee} -- x", "{fee}) or (1=1"]:
        with pytest.raises(DisallowedSQL):
            w.report(metrics=[{"name": "x", "formula": bad}])
    for bad, error in (({"name": "fee", "formula": "1"}, InvalidField), ({"name": "x", "formula": "{nothing}"}, (InvalidField, ReportError)), ({"name": "x y", "formula": "1"}, ConfigError)):
        with pytest.raises(error):
            w.report(metrics=[bad])
    with pytest.raises(ReportError):
        w.report(metrics=["fee"], dimensions=[{"name": "d", "formula": "{fee}"}])
    deep = [{"name": "f0", "formula": "{fee}"}] + [{"name": f"f{i}", "formula": f"{{f{i - 1}}}"} for i in range(1, 8)]
    with pytest.raises((WarehouseError, MaxFormulaDepth)):
        make(w.spark, lambda c: c["metrics"].extend(deep))


def by_berth():
    """Sums by berth in the report's order: quays by their declared values, berths by name."""
    order = CONFIG["dimensions"][0]["values"]
    fees = brute(["fee"], ["quay_label", "berth_label"])
    return pd.DataFrame([(*k, float(v[0])) for k, v in sorted(fees.items(), key=lambda x: (order.index(x[0][0]), x[0][1]))], columns=["quay", "berth", "fee"])


def test_technicals(w):
    t = by_berth()
    groups = t.groupby("quay", sort=False).fee
    got = rows(w, ["fee_smooth"], ["quay_label", "berth_label"])
    assert [r[:2] for r in got] == list(zip(t.quay, t.berth, strict=True)) and [r[2] for r in got] == pytest.approx(groups.transform(lambda x: x.rolling(3, min_periods=1).mean()).tolist(), abs=1e-3)
    mean, std = (groups.transform(lambda x, f=f: getattr(x.rolling(4, min_periods=1), f)()) for f in ("mean", "std"))
    for r, m, s in zip(rows(w, ["fee_range"], ["quay_label", "berth_label"]), mean, std, strict=True):
        assert r[2] == pytest.approx(m, abs=1e-3)
        if pd.isna(s):  # one value has no deviation
            assert r[3] is NONE and r[4] is NONE
        else:
            assert r[3] <= r[2] <= r[4] and r[4] - r[2] == pytest.approx(r[2] - r[3], abs=1e-3) and (r[4] - r[2]) / s == pytest.approx(1, abs=0.2) or (r[4] - r[2]) / s == pytest.approx(2, abs=0.2)
    limit = sorted(r[2] for r in got)[3]
    assert rows(w, ["fee_smooth"], ["quay_label", "berth_label"], row_filters=[("fee_smooth", ">", float(limit))]) == [r for r in got if r[2] > limit]


def test_technical_with_rollup(w):
    got = rows(w, ["fee_smooth", "fee"], ["quay_label", "berth_label"], rollup="all")
    plain = {r[:2]: r[2] for r in rows(w, ["fee_smooth"], ["quay_label", "berth_label"])}
    assert {r[:2]: r[2] for r in got if r[-1] == 0} == plain and {r[0]: r[3] for r in got if r[-1] == 1} == {k[0]: v[0] for k, v in brute(["fee"], ["quay_label"]).items()}


def test_order_limit_and_pivot(w):
    assert [r[0] for r in rows(w, ["fee"], ["quay_label"])] == ["West", "South", "North"]
    assert [r[0] for r in rows(w, ["fee"], ["quay_label"], order_by=[("quay_label", "desc")], limit=2)] == ["North", "South"]
    fees = {k[0]: v[0] for k, v in brute(["fee"], ["ship"]).items()}
    top = sorted((v for v in fees.values() if v is not NONE), reverse=True)[:3]
    assert [float(r[1]) for r in rows(w, ["fee"], ["ship"], order_by=[("fee", "desc")], limit=3)] == [float(x) for x in top]
    got = rows(w, ["calls"], ["call_id"], limit=3, limit_first=True, rollup="totals")
    assert len(got) == 4 and got[-1][1] == 3
    wide = {r.berth_label: r for r in w.execute(["fee"], ["berth_label", "quay_label"], pivot=["quay_label"]).df.collect()}
    assert all(float(wide[k[1]][f"fee_{k[0]}"]) == float(v[0]) for k, v in brute(["fee"], ["quay_label", "berth_label"]).items())
    (one,) = w.execute(["calls"], ["quay_label"], pivot=["quay_label"]).rows
    assert {q: one[f"calls_{q}"] for q in ("North", "South", "West")} == {k[0]: v[0] for k, v in brute(["calls"], ["quay_label"]).items()}


def test_reports_within_reports(w):
    calls = {k[0]: v[0] for k, v in brute(["calls"], ["quay_label"]).items()}
    middle = sorted(calls.values())[1]
    many = {"metrics": ["calls"], "dimensions": ["quay_label"], "row_filters": [("calls", ">", middle)]}
    for op, keep in (("in report", lambda n: n > middle), ("not in report", lambda n: n <= middle)):
        assert {r[0] for r in rows(w, ["fee"], ["quay_label"], criteria=[("quay_label", op, many)])} == {q for q, n in calls.items() if keep(n)}
    nested = many
    for _ in range(4):
        nested = {"metrics": ["calls"], "dimensions": ["quay_label"], "criteria": [("quay_label", "in report", nested)]}
    with pytest.raises(MaxReportDepth):
        w.report(metrics=["fee"], criteria=[("quay_label", "in report", nested)])


def test_grain(w):
    for bad in ({"metrics": ["calls"], "dimensions": ["box_id"]}, {"metrics": ["fee_at_berth"], "dimensions": ["quay_label"]}, {"metrics": ["calls"], "dimensions": ["box_id"], "allow_partial": True}):
        with pytest.raises(UnsupportedGrain):
            w.report(**bad)
    assert len(rows(w, ["fee_at_berth"], ["berth_label"])) == len(brute(["fee"], ["berth_label"]))
    r = w.execute(["fee", "calls"], ["box_id"], allow_partial=True)
    assert r.is_partial and list(r.unsupported_metrics) == ["calls"] and len(r.rows) == 150
    assert rows(w, NONE, ["quay_label"]) == [("West",), ("South",), ("North",)]
    assert {"berth_label", "quay_label"} <= w.supported_dimensions(["fee", "calls"]) and "box_id" not in w.supported_dimensions(["fee", "calls"])


def base(w, criteria=None, metrics=("seen",), dims=("quay_label",), **kw):
    return [q.table_set.base.alias for q in w.report(metrics=list(metrics), dimensions=list(dims), criteria=criteria, **kw).queries]


def test_routing(spark, w):
    assert base(w) == ["calls"] and base(w, disabled_tables=["port.calls"]) == ["boxes"]
    assert base(make(spark, lambda c: c["datasources"]["port"]["tables"]["port.boxes"].update(priority=0))) == ["boxes"]
    assert base(w, metrics=["boxes"], dims=["berth_id"]) == ["boxes"]
    other = make(spark, ds_priority=["books", "port"])
    assert base(other, metrics=["boxes"], dims=["berth_id"]) == ["tallies"]
    same(rows(other, ["boxes"], ["berth_id"]), brute(["boxes"], ["berth_id"]), 1)


def test_column_grain_holds_for_shared_queries(spark):
    """A metric doesn't join a query of a table whose column asks for more dimensions."""
    other = make(spark, ds_priority=["books", "port"])
    assert base(other, metrics=["fee"], dims=["berth_id"]) == ["boxes"] and base(other, metrics=["fee"], dims=["berth_id", "quay_id"]) == ["tallies"]
    assert base(other, metrics=["boxes", "fee"], dims=["berth_id"]) == ["tallies", "boxes"] and base(other, metrics=["boxes", "fee"], dims=["berth_id", "quay_id"]) == ["tallies"]
    same(rows(other, ["boxes", "fee"], ["berth_id"]), brute(["boxes", "fee"], ["berth_id"]), 1)


VALUES = {"quay_label": ["North", "South", "West"], "berth_id": [11, 12, 13, 21, 22, 23, 31], "ship": ["ship 1", "ship 2", "ship 3", NONE]}


def clause_pool(name):
    v = VALUES[name]
    pool = [(op, x) for op in ("=", "!=") for x in v] + [(op, list(x)) for op in ("in", "not in") for x in itertools.combinations([y for y in v if y is not NONE], 2)]
    if name == "berth_id":
        pool += [(op, x) for op in (">", ">=", "<", "<=") for x in v] + [(op, [a, b]) for op in ("between", "not between") for a, b in ((11, 21), (12, 22), (22, 31))]
    return pool


@pytest.mark.parametrize("name", VALUES)
def test_limits_never_lose_rows(name):
    """A limit counts as implied only if each value that the criteria let through meets it; and is so for most such."""
    rng, right, all_ = random.Random(3), 0, 0
    pool = clause_pool(name)
    for _ in range(1500):
        criteria, limit = rng.sample(pool, rng.randrange(1, 3)), rng.choice(pool)
        allowed = Allowed()
        for c in criteria:
            allowed.add(*c)
        through = [x for x in VALUES[name] if all(CLAUSES[op](x, v) for op, v in criteria)]
        meant = all(CLAUSES[limit[0]](x, limit[1]) for x in through)
        found = allowed.known and allowed.implies(*limit)
        assert meant or not found, (criteria, limit)
        if meant and len(through) and limit in criteria or len(criteria) == 1 and meant and criteria[0][0] in ("=", "in"):
            all_ += 1
            right += found
    assert right > 0.9 * all_ > 20


def test_null_meets_only_clauses_for_null():
    assert [holds(op, v, NONE) for op, v in (("=", NONE), ("in", [NONE, 1]), ("!=", 1), ("not in", [1]), ("!=", NONE), ("between", [1, 2]))] == [True, True, False, False, False, False]


@pytest.mark.parametrize(
    "limits, criteria, table",
    [
        ([["quay_label", "=", "South"]], [("quay_label", "=", "South")], "boxes"), ([["quay_label", "=", "South"]], None, "calls"), ([["ship", "!=", "ship 3"]], [("ship", "=", None)], "calls"), ([["ship", "!=", "ship 3"]], [("ship", "=", "ship 4")], "boxes"),
        ([["date", ">=", "2023-05-01"]], [("month", "=", "2023-06")], "boxes"), ([["date", ">=", "2023-05-01"]], [("year", "=", 2023)], "calls"), ([["date", "between", ["2023-01-01", "2023-12-31"]]], [("year", "=", 2023)], "boxes"),
        ([["date", ">=", "40 days ago"]], [("date", ">=", "9 days ago")], "boxes"), ([["date", ">=", "9 days ago"]], [("date", ">=", "40 days ago")], "calls"), ([["quay_label", "=", "South"], ["year", ">", 2022]], [("quay_label", "=", "South")], "calls"),
    ],
)
def test_limits_decide_the_table(spark, limits, criteria, table):
    def change(c):
        t = c["datasources"]["port"]["tables"]["port.boxes"]
        t |= {"priority": 0, "criteria_limits": limits}
        t["columns"]["landed"]["type_conversion_prefix"] = None

    assert base(make(spark, change), criteria) == [table]


def test_request_errors(w):
    one = {"metrics": ["calls"]}
    for bad in [{}, {"metrics": ["what"]}, one | {"dimensions": ["ship", "ship"]}, one | {"limit": 0}, one | {"limit_first": True}, one | {"order_by": [("goods", "asc")]}, one | {"pivot": ["goods"]}, one | {"row_filters": [("calls", "like", 1)]}]:
        with pytest.raises((ReportError, InvalidField)):
            w.report(**bad)
    r = w.execute(["calls"], ["quay_label"], row_filters=[("what", ">", 1)])
    assert len(r.rows) == 3 and "what" in r.warnings[0]


def tables(c):
    return c["datasources"]["port"]["tables"]


@pytest.mark.parametrize(
    "change",
    [
        lambda c: c["dimensions"].append({"name": "of_a_metric", "formula": "{fee}"}),
        lambda c: c["dimensions"].append({"name": "GOODS", "type": "string"}),
        lambda c: tables(c)["port.boxes"]["columns"]["goods"]["fields"].append("not_declared"),
        lambda c: tables(c)["port.calls"].update(primary_key=["quay_id"]),
        lambda c: tables(c)["port.boxes"].update(parent="port.what"),
        lambda c: tables(c)["port.boxes"]["columns"].pop("tonnes"),
        lambda c: tables(c)["port.boxes"].update(criteria_limits=[["what", "=", 1]]),
        lambda c: tables(c)["port.boxes"].update(parent="port.quays"),
        lambda c: c["metrics"].append({"name": "of_a_technical", "formula": "{fee_smooth}+1"}),
    ],
)
def test_integrity(spark, change):
    with pytest.raises(WarehouseError):
        make(spark, change)
