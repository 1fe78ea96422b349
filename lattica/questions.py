"""Questions in words: a planner turns one into report requests, whose results are combined and put in shape.

The planner is any callable(question, tools) -> dict with ``reports`` (parameters of reports), ``combine_strategy``, ``combine_on``,
``wrangle`` and ``notes``. ``tools`` lets it look at the warehouse and try out requests. None is built in; a setting may name one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from lattica.config import imported
from lattica.errors import LatticaError, QuestionError
from lattica.operators import wrangle
from lattica.report import PARAMS, Report, ReportResult

Progress = Callable[[str, dict], None]


@dataclass
class QuestionPlan:
    question: str
    reports: list[dict]
    combine_strategy: str = "auto"
    combine_on: list[str] = field(default_factory=list)
    wrangle: list[dict] = field(default_factory=list)
    notes: str = ""


@dataclass
class Answer:
    plan: QuestionPlan
    reports: list[ReportResult]
    result: DataFrame | dict[str, DataFrame]
    summary: str | None = None


def visible_fields(warehouse) -> dict[str, Any]:
    """Fields that question planners may use.

    A field is hidden by ``meta.agent.enabled: false``, by a ``meta.group`` among the warehouse's ``meta.agent.field_disabled_groups``,
    or by a name that one of its ``meta.agent.field_disabled_patterns`` is found in.
    """
    rules = ((warehouse.meta or {}).get("agent") or {})
    groups, patterns = rules.get("field_disabled_groups") or [], [re.compile(p) for p in rules.get("field_disabled_patterns") or []]

    def shown(name: str, f) -> bool:
        meta = f.meta or {}
        return (meta.get("agent") or {}).get("enabled", True) is not False and not (meta.get("group") and meta["group"] in groups) and not any(p.search(name) for p in patterns)

    return {n: f for n, f in warehouse.get_fields().items() if shown(n, f)}


_RELATIVE_TIME = re.compile(r"\b(today|yesterday|(last|past|previous|this)\s+(\d+\s+)?(minute|hour|day|week|month|quarter|year)s?|\d+\s+(minute|hour|day|week|month|year)s?\s+ago)\b")


def _says(words: str, f, name: str) -> bool:
    """Whether a phrase names a field, by its name or display name; a plural s is let pass."""
    return any(re.search(rf"\b{re.escape(x.lower())}s?\b", words) for x in {name.replace("_", " "), f.shown_as})


def uncovered(warehouse, question: str, reports: list[dict]) -> list[str]:
    """What a question names that the plan's reports leave out: metrics, dimensions after by or per, a relative time."""
    words, fields = " ".join(question.lower().replace("_", " ").split()), visible_fields(warehouse)
    used = {kind: {x if isinstance(x, str) else x.get("name") for r in reports for x in r.get(kind) or []} for kind in ("metrics", "dimensions")}
    criteria = {c[0] for r in reports for c in r.get("criteria") or []}
    out = []
    named = [n for n, f in fields.items() if warehouse.has_metric(n) and _says(words, f, n)]
    longest = [n for n in named if not any(n != m and n.replace("_", " ") in m.replace("_", " ") for m in named)]
    if lack := sorted(set(longest) - used["metrics"]):
        out.append(f"metrics {lack}")
    after = " ".join(m[1] for m in re.finditer(r"\b(?:by|per|for each)\s+(.+?)(?=\b(?:where|in|for|during|since|over|last|past|with)\b|[?.!]|$)", words))
    if lack := sorted({n for n, f in fields.items() if warehouse.has_dimension(n) and not warehouse.has_metric(n) and _says(after, f, n)} - used["dimensions"]):
        out.append(f"dimensions {lack}")
    temporal = {u.name for d in warehouse.datasources.values() for t in d.tables.values() for c in t.columns.values() for u in c.fields if u.part}
    if _RELATIVE_TIME.search(words) and temporal and not criteria & temporal:
        out.append("criteria for the time that is asked for")
    return out


def default_summary(question: str, reports: list[ReportResult], result: Any) -> str:
    """A summary without any model."""
    shape = f"{len(result)} results apart" if isinstance(result, dict) else f"{len(result.columns)} columns: {', '.join(result.columns)}"
    return f"{question.strip()} Answered by {len(reports)} report{'s' * (len(reports) != 1)}, {shape}."


class Tools:
    """What a planner may do with a warehouse."""

    def __init__(self, warehouse):
        self.warehouse = warehouse

    def overview(self) -> dict:
        w, fields = self.warehouse, visible_fields(self.warehouse)
        return {"metrics": sorted(n for n in fields if w.has_metric(n)), "dimensions": sorted(n for n in fields if w.has_dimension(n)), "datasources": {n: sorted(d.tables) for n, d in w.datasources.items()}}

    def find_fields(self, text: str, limit: int = 20) -> list[dict]:
        """Fields whose name, display name or description share words with the text, best first."""
        words = set(re.findall(r"[a-z0-9]+", text.lower()))
        found = []
        for name, f in visible_fields(self.warehouse).items():
            own = set(re.findall(r"[a-z0-9]+", f"{name.replace('_', ' ')} {f.shown_as} {f.description or ''}".lower()))
            if score := len(words & own) / max(1, len(own)) + (name.lower() in text.lower()):
                found.append((score, {"name": name, "kind": "metric" if self.warehouse.has_metric(name) else "dimension", "display_name": f.shown_as, "description": f.description}))
        return [x for _, x in sorted(found, key=lambda x: (-x[0], x[1]["name"]))[:limit]]

    def validate(self, spec: dict) -> dict:
        """Whether a request can be planned; nothing runs."""
        try:
            r = Report(self.warehouse, **spec)
        except (LatticaError, TypeError, ValueError) as e:
            return {"valid": False, "error": str(e)}
        return {"valid": True, "grain": r.get_grain(), "tables": [q.table_set.tables for q in r.queries]}


def make_plan(warehouse, question: str, raw: dict) -> QuestionPlan:
    """A planner's answer in checked form."""
    if extra := set(raw) - {"reports", "combine_strategy", "combine_on", "wrangle", "notes"}:
        raise QuestionError(f"unknown keys {sorted(extra)} in the plan")
    reports = raw.get("reports") or []
    if not reports:
        raise QuestionError("the plan has no report")
    for r in reports:
        if extra := set(r) - set(PARAMS):
            raise QuestionError(f"unknown report parameters {sorted(extra)}")
        found = Tools(warehouse).validate(r)
        if not found["valid"]:
            raise QuestionError(f"invalid report: {found['error']}")
        asked = [x for x in [*(r.get("metrics") or []), *(r.get("dimensions") or []), *(c[0] for c in r.get("criteria") or [])] if isinstance(x, str)]
        if hidden := sorted(set(asked) - set(visible_fields(warehouse))):
            raise QuestionError(f"fields {hidden} are hidden from questions")
    if lack := uncovered(warehouse, question, reports):
        raise QuestionError(f"the plan leaves out {'; '.join(lack)}")
    strategy = raw.get("combine_strategy") or "auto"
    if strategy not in wrangle.STRATEGIES:
        raise QuestionError(f"unknown strategy {strategy!r}")
    return QuestionPlan(question, reports, strategy, list(raw.get("combine_on") or []), list(raw.get("wrangle") or []), raw.get("notes") or "")


def plan_question(warehouse, question: str, planner: Callable | None = None) -> QuestionPlan:
    if not question or not question.strip():
        raise QuestionError("empty question")
    name = warehouse.settings.get("QUESTION_PLANNER")
    planner = planner or (imported(name) if name else None)
    if planner is None:
        raise QuestionError("no question planner is given or set")
    return make_plan(warehouse, question, planner(question, Tools(warehouse)))


def execute_plan(warehouse, plan: QuestionPlan, progress: Progress | None = None) -> Answer:
    tell = progress or (lambda event, data: None)
    results = []
    for i, params in enumerate(plan.reports, 1):
        tell("report", {"index": i, "of": len(plan.reports), "params": params})
        results.append(warehouse.execute(**params))
    tell("combine", {"strategy": plan.combine_strategy})
    out: Any = wrangle.combine([r.df for r in results], [r.report.dims for r in results], plan.combine_strategy, plan.combine_on)
    if plan.wrangle:
        if isinstance(out, dict):
            raise QuestionError("separate results can't be wrangled")
        out = wrangle.apply(out, plan.wrangle)
    tell("done", {})
    return Answer(plan, results, out)


def answer(warehouse, question: str, planner: Callable | None = None, summarizer: Callable[[str, Any], str] | None = None, progress: Progress | None = None) -> Answer:
    out = execute_plan(warehouse, plan_question(warehouse, question, planner), progress)
    out.summary = summarizer(question, out.result) if summarizer else default_summary(question, out.reports, out.result)
    return out
