import datetime as dt
import json
import sqlite3
import threading
import time
import zipfile

import pytest

from lattica import cli, config
from lattica.bootstrap import bootstrap, write_config
from lattica.datasource import AdHocTable, DataSource
from lattica.errors import ConfigError, DisallowedSQL, ExecutionKilled, ExecutionLocked, InvalidReportId, InvalidTechnical, InvalidWarehouseId, QuestionError, QueryTimeout
from lattica.functions import dates, formulas, types
from lattica.operators import wrangle
from lattica.operators.technicals import parse_technical
from lattica.plans.limits import Allowed
from lattica.runtime import Execution
from lattica.sources import readers
from lattica.store import Store
from lattica.warehouse import Warehouse
from tests.fixture import make


def test_formula_texts():
    assert formulas.null_for_zero("a/b/(c+d)") == "a/ nullif(b, 0)/ nullif((c+d), 0)"
    assert formulas.null_for_zero("x / -sum(y) * 2 || 'a/b'") == "x / nullif(-sum(y), 0) * 2 || 'a/b'"
    assert formulas.aggregates("COUNT(DISTINCT x.id)") and not formulas.aggregates("max_speed + 1")
    assert formulas.check("CASE WHEN a = 'select; --' THEN 1 ELSE EXTRACT(YEAR FROM b) END")
    for bad in ["a;b", "exists(select 1)", "drop table", "a /* x */", "(a", "a)", "union", "a b"]:
        with pytest.raises(DisallowedSQL):
            formulas.check(bad)


def test_types():
    assert types.spark_type("NUMERIC(10, 2)").simpleString() == "double" and types.spark_type("string(3)").simpleString() == "string" and types.spark_type("datetime").simpleString() == "timestamp_ntz"
    for bad in ["nothing", "numeric(a)", "", "string(1"]:
        with pytest.raises(ConfigError):
            types.spark_type(bad)


@pytest.mark.parametrize("text, kind, params, mode", [("mean(5)", "mean", {"window": 5, "min_periods": 1}, "group"), ("sum(5, 2):all", "sum", {"window": 5, "min_periods": 2}, "all"), ("diff", "diff", {}, "group"), ("pct_change(2)", "pct_change", {"periods": 2}, "group"), ("cumsum:all", "cumsum", {}, "all")])
def test_technical_texts(text, kind, params, mode):
    t = parse_technical(text)
    assert (t.type, t.params, t.mode) == (kind, params, mode)


def test_technical_errors():
    for bad in ["nothing", "mean", "mean(0)", "mean(a)", "cumsum(3)", "mean(1,2,3)", "mean(3):some", {"type": "rank", "params": {"window": 2}}]:
        with pytest.raises(InvalidTechnical):
            parse_technical(bad)


def test_date_clauses():
    now = lambda: dt.datetime(2024, 3, 10, 12, 30, 5)
    assert dates.start_of("date", "3 days ago", now) == dt.datetime(2024, 3, 7) and dates.start_of("hour", "last 2 hours", now) == dt.datetime(2024, 3, 10, 10)
    assert dates.clauses("month", "=", "2023-12") == [(">=", dt.datetime(2023, 12, 1)), ("<", dt.datetime(2024, 1, 1))]
    assert dates.clauses("year", "in", [2020]) is None and dates.clauses("year", "=", "x") == [("never", None)]


def test_allowed():
    a = Allowed()
    a.add(">=", 3)
    a.add("<", 9)
    assert a.implies(">", 2) and a.implies("between", [1, 9]) and not a.implies("<", 8) and a.implies("!=", 9) and not a.implies("=", 3)
    a.add("in", [1, 4, 5])
    assert a.implies("in", [4, 5, 6]) and not a.implies("=", 4)


def test_config_files(tmp_path, monkeypatch):
    (tmp_path / "table.json").write_text(json.dumps({"type": "metric", "primary_key": ["id"], "columns": {"id": {"fields": ["id"]}}}))
    (tmp_path / "ds.yaml").write_text("connect: parquet:${DATA_FOLDER}\ntables:\n  t: table.json\n")
    (tmp_path / "common.json").write_text(json.dumps({"metrics": [{"name": "a", "type": "integer"}, {"name": "b", "type": "integer"}]}))
    (tmp_path / "w.json").write_text(json.dumps({"includes": ["common.json"], "metrics": [{"name": "b", "type": "float"}], "dimensions": [{"name": "id", "type": "integer"}], "datasources": {"d": "ds.yaml"}}))
    monkeypatch.setenv("DATA_FOLDER", "/data")
    c = config.load_warehouse_config(str(tmp_path / "w.json"))
    assert {m["name"]: m["type"] for m in c["metrics"]} == {"a": "integer", "b": "float"}
    assert c["datasources"]["d"]["connect"] == "parquet:/data" and c["datasources"]["d"]["tables"]["t"]["type"] == "metric"
    assert config.settings({"LATTICA_MAX_JOINS": "3"})["MAX_JOINS"] == 3


def test_macros_and_bad_configs():
    made = config.metric_macros([{"name": "v", "type": "integer", "aggregation": {"mean": {"rounding": 1}, "sum": {"name": "total"}}, "divisors": {"metrics": ["calls"]}}])
    assert [m["name"] for m in made] == ["v_mean", "total", "v_mean_per_call", "total_per_call"]
    for bad in [{"name": "x"}, {"name": "1x", "type": "integer"}, {"name": "x", "type": "integer", "aggregation": "median"}, {"name": "x", "type": "integer", "weighting_metric": "y"}, {"name": "x", "type": "integer", "other": 1}]:
        with pytest.raises(ConfigError):
            config.make_metric(bad)
    for bad in [{"type": "other", "primary_key": ["a"]}, {"type": "metric"}, {"type": "metric", "primary_key": ["a"], "criteria_limits": [["a", "?", 1]]}]:
        with pytest.raises(ConfigError):
            config.check_table("t", bad)
    with pytest.raises(ConfigError):
        config.check_table("t; drop", {"type": "metric", "primary_key": ["a"]})


def xlsx(path, rows):
    sheet = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>" for v in r) + "</row>" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')


def test_file_sources(spark, tmp_path):
    rows = [["zip", "code", "name"], [10, 1.5, "a"], [20, 2.5, "b"], [20, 9.5, "c"]]
    xlsx(tmp_path / "t.xlsx", rows)
    (tmp_path / "t.csv").write_text("\n".join(",".join(map(str, r)) for r in rows))
    (tmp_path / "t.json").write_text(json.dumps([dict(zip(rows[0], r, strict=True)) for r in rows[1:]]))
    (tmp_path / "t.html").write_text("<table>" + "".join("<tr>" + "".join(f"<td>{v}</td>" for v in r) + "</tr>" for r in rows) + "</table>")
    for kind in ("xlsx", "csv", "json", "html"):
        w = Warehouse.from_data_file(spark, str(tmp_path / f"t.{kind}"), ["zip"], columns={"zip": {"fields": ["zip"]}, "code": {"fields": ["code"]}}, drop_dupes=True)
        assert [tuple(r) for r in w.execute(["code"], ["zip"]).rows] == [(10, 1.5), (20, 2.5)], kind
    with pytest.raises(AssertionError):
        readers.read_file(spark, str(tmp_path / "t.doc"))
    (tmp_path / "two.html").write_text("<table></table><table></table>")
    with pytest.raises(ValueError):
        readers.read_html(spark, str(tmp_path / "two.html"))
    assert readers.sheet_csv_url("https://docs.google.com/x/edit#gid=0") == "https://docs.google.com/x/export?format=csv"


def test_sqlite_and_bootstrap(spark, tmp_path):
    path = tmp_path / "db.sqlite"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE items (id INTEGER, name VARCHAR(10), price DECIMAL(10,2), made TIMESTAMP)")
        con.executemany("INSERT INTO items VALUES (?, ?, ?, ?)", [(1, "a", 1.5, "2024-01-01 10:00:00"), (2, None, 2.5, "2024-02-01 10:00:00")])
    found = bootstrap(spark, f"sqlite:///{path}")
    assert [m["name"] for m in found["metrics"]] == ["price"] and found["tables"]["items"]["primary_key"] == ["item_id"]
    for suffix in ("yaml", "json"):
        write_config({"datasources": {"d": found}}, str(tmp_path / f"w.{suffix}"))
        w = Warehouse(spark, str(tmp_path / f"w.{suffix}"))
        assert [tuple(r) for r in w.execute(["price"], ["made_month"]).rows] == [("2024-01", 1.5), ("2024-02", 2.5)]
    assert cli.main(["convert", str(tmp_path / "w.yaml"), str(tmp_path / "x.json")]) == 0 and json.loads((tmp_path / "x.json").read_text())
    assert cli.criterion("a not in 1,2") == ("a", "not in", [1, 2]) and cli.criterion("b = New York") == ("b", "=", "New York")
    assert cli.main(["report", str(tmp_path / "w.json"), "-m", "price", "-d", "name", "--rollup", "totals"]) == 0
    with pytest.raises(ConfigError):
        readers.connect(spark, "x", "nothing:x")


def made_by_function(spark, name, n):
    return {"t": spark.range(n).selectExpr("id", "id * 2.0 AS v")}


def test_connect_function_and_adhoc_sources(spark, tmp_path):
    c = {"connect": {"func": "tests.test_units.made_by_function", "params": {"n": 4}}, "tables": {"t": {"type": "metric", "primary_key": ["id"], "create_fields": True, "use_full_column_names": False}}}
    w = Warehouse(spark, {"datasources": {"d": c}})
    assert w.execute(["v"]).rows[0][0] == 12
    extra = DataSource.from_tables(spark, "extra", [AdHocTable("x", [{"id": 1, "weight": 5}, {"id": None, "weight": 7}, {"id": 1, "weight": 9}], "metric", ["id"], drop_dupes=True, fillna_value=3, schema="id long, weight long")])
    r = w.execute(["v", "weight"], ["id"], adhoc_datasources=[extra], order_by=["id"])
    assert [tuple(x) for x in r.rows] == [(0, 0, None), (1, 2, 5), (2, 4, None), (3, 6, 7)]
    readers.save_table(spark.range(3), "lattica_saved", "replace")
    with pytest.raises(ValueError):
        readers.save_table(spark.range(1), "lattica_saved", "fail")
    readers.save_table(spark.range(1), "lattica_saved", "ignore")
    assert spark.table("lattica_saved").count() == 3
    spark.sql("DROP TABLE lattica_saved")


def test_store(spark, tmp_path):
    w = make(spark, store=str(tmp_path))
    spec = w.save_report(metrics=["calls"], dimensions=["quay_label"], meta={"a": 1})
    assert w.execute_id(spec).rows == w.execute(["calls"], ["quay_label"]).rows
    assert [r[0] for r in w.execute(["fee"], ["quay_label"], criteria=[("quay_label", "in report", spec)]).rows] == ["West", "South", "North"]
    w.delete_report(spec)
    with pytest.raises(InvalidReportId):
        w.load_report(spec)
    s = Store(str(tmp_path))
    one, two = s.save_warehouse("one", {"config": "x"}, None), s.save_warehouse("two", {"config": "x"}, None)
    assert one != two
    with pytest.raises(ValueError):
        s.save_warehouse("one", {}, None)
    s.delete_warehouse(one)
    with pytest.raises(InvalidWarehouseId):
        s.load_warehouse(one)
    s.put_values(None, "goods", ["tea"])
    assert w.allowed_values(w.get_dimension("goods")) == ["tea"]


def test_timeout_and_kill(spark):
    slow = lambda: spark.range(0, 2 * 10**10, 1, 4).selectExpr("sum(id % 7)").collect()
    e = Execution(spark)
    with pytest.raises(QueryTimeout):
        e.run(slow, timeout=1)
    found = []

    def run():
        try:
            e.run(slow)
        except Exception as x:
            found.append(x)

    t = threading.Thread(target=run)
    t.start()
    for _ in range(100):
        if e.state.value == "querying":
            break
        time.sleep(0.05)
    with pytest.raises(ExecutionLocked):
        e.run(slow)
    time.sleep(1)
    assert e.kill()
    t.join(60)
    assert isinstance(found[0], ExecutionKilled) and not e.kill() and e.run(lambda: 5) == 5


def test_questions(spark):
    w, seen = make(spark), []

    def planner(question, tools):
        assert tools.find_fields("fee by quay label")[0]["name"] in ("fee", "quay_label") and "calls" in tools.overview()["metrics"]
        assert not tools.validate({"metrics": ["what"]})["valid"]
        return {"reports": [{"metrics": ["fee"], "dimensions": ["quay_label"]}, {"metrics": ["calls"], "dimensions": ["quay_label"]}], "wrangle": [{"op": "sort_values", "by": ["calls"], "ascending": False}, {"op": "select_columns", "columns": ["quay_label", "calls"]}]}

    a = w.answer_question("fee and calls by quay label", planner, lambda q, df: f"{df.count()} rows", lambda event, data: seen.append(event))
    most = max(w.execute(["calls"], ["quay_label"]).rows, key=lambda r: r.calls)
    assert a.result.collect()[0].calls == most.calls and a.summary == "3 rows" and seen == ["report", "report", "combine", "done"]
    for bad in [{}, {"reports": [{"metrics": ["what"]}]}, {"reports": [{"metrics": ["calls"]}], "combine_strategy": "other"}, {"reports": [{"other": 1}]}]:
        with pytest.raises(QuestionError):
            w.plan_question("q", lambda q, t, bad=bad: bad)
    with pytest.raises(QuestionError):
        w.plan_question("q")
    a, b = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string"), spark.createDataFrame([(None, "z")], "k int, v string")
    assert sorted(map(str, (tuple(r) for r in wrangle.merge([a, b], ["k"]).collect()))) == ["(1, 'x', None)", "(None, 'y', 'z')"]
    assert wrangle.apply(a, [{"op": "filter_rows", "column": "k", "operator": "not in", "value": [1]}]).count() == 1
    assert set(wrangle.combine([a, b], [["k"], ["k"]], "separate")) == {"report_1", "report_2"}


def test_question_coverage_and_visibility(spark):
    from lattica.questions import default_summary, uncovered, visible_fields

    def change(c):
        c["meta"] = {"agent": {"field_disabled_groups": ["secret"], "field_disabled_patterns": ["^landed_", "^box_id"]}}
        c["metrics"] += [{"name": "hidden_one", "type": "integer", "meta": {"agent": {"enabled": False}}}, {"name": "hidden_two", "type": "integer", "meta": {"group": "secret"}}]

    w = make(spark, change)
    shown = visible_fields(w)
    assert "fee" in shown and not {"hidden_one", "hidden_two", "box_id", "landed_year"} & set(shown)
    plan = [{"metrics": ["fee"], "dimensions": ["quay_label"]}]
    assert uncovered(w, "Fee by quay label?", plan) == [] and uncovered(w, "fee and calls by berth label", plan) == ["metrics ['calls']", "dimensions ['berth_label']"]
    assert uncovered(w, "fee last 3 days", plan)[0].startswith("criteria") and uncovered(w, "fee last 3 days", [plan[0] | {"criteria": [("date", ">=", "3 days ago")]}]) == []
    with pytest.raises(QuestionError):
        w.plan_question("number", lambda q, t: {"reports": [{"metrics": ["fee"], "dimensions": ["box_id"]}]})
    a = w.answer_question("fee by quay label", lambda q, t: {"reports": plan})
    assert "1 report" in a.summary and default_summary("q", a.reports, {"x": a.result}).endswith("1 results apart.")
