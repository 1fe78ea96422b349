"""Whether a request's criteria imply a table's criteria limits.

Criteria on one column are summed up as an allowed set: exact values, or an interval, less what is excluded.
A limit is implied if every value of the allowed set meets it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from lattica.functions import dates
from lattica.plans.graph import TableSet

Criterion = tuple[str, str, object]


@dataclass
class Allowed:
    """Values that the criteria let through."""

    exact: list | None = None
    low: tuple | None = None  # (value, whether it belongs)
    high: tuple | None = None
    without: list = field(default_factory=list)  # clauses that exclude
    known: bool = False

    def add(self, op: str, v: object) -> None:
        if isinstance(v, list | tuple) and op not in ("in", "not in", "between", "not between", "outside", "beyond"):
            if op != "=":
                return
            op = "in"
        try:
            if op in ("=", "in"):
                values = [v] if op == "=" else list(v) if isinstance(v, list | tuple | set) else [v]
                self.exact = values if self.exact is None else [x for x in self.exact if x in values]
            elif op in (">", ">="):
                new = (v, op == ">=")
                if self.low is None or (v, not new[1]) > (self.low[0], not self.low[1]):
                    self.low = new
            elif op in ("<", "<="):
                new = (v, op == "<=")
                if self.high is None or (v, new[1]) < (self.high[0], self.high[1]):
                    self.high = new
            elif op == "between":
                self.add(">=", v[0])
                self.add("<=", v[1])
            elif op in ("!=", "not in", "not between", "outside", "beyond", "like", "not like"):
                self.without.append((op, v))
            else:
                return
            self.known = True
        except TypeError:
            return

    def values(self) -> list | None:
        """The exact values left by all criteria, if there are exact ones."""
        if self.exact is None:
            return None
        out = []
        for x in self.exact:
            try:
                inside = (self.low is None or x > self.low[0] or self.low[1] and x == self.low[0]) and (self.high is None or x < self.high[0] or self.high[1] and x == self.high[0])
            except TypeError:
                inside = True
            if inside and all(holds(op, v, x) is not False for op, v in self.without):
                out.append(x)
        return out

    def implies(self, op: str, v: object) -> bool:
        exact = self.values()
        if exact is not None:
            return all(holds(op, v, x) is True for x in exact)
        try:
            if op == "between":
                return self.implies(">=", v[0]) and self.implies("<=", v[1])
            if op in (">", ">="):
                return self.low is not None and (self.low[0] > v or self.low[0] == v and (op == ">=" or not self.low[1]))
            if op in ("<", "<="):
                return self.high is not None and (self.high[0] < v or self.high[0] == v and (op == "<=" or not self.high[1]))
            if op in ("=", "in"):
                values = [v] if op == "=" else v
                return self.low is not None and self.high is not None and self.low[1] and self.high[1] and self.low[0] == self.high[0] and self.low[0] in values
            if op in ("!=", "not in"):
                return all(self._excludes(x) for x in ([v] if op == "!=" else v))
            if op in ("not between", "outside", "beyond"):
                a, b = v
                after = self.low is not None and (self.low[0] > b or self.low[0] == b and (op == "outside" or not self.low[1]))
                before = self.high is not None and (self.high[0] < a or self.high[0] == a and not self.high[1])
                return after or before or any(o == op and w[0] <= a and w[1] >= b for o, w in self.without if o in ("not between", "outside", "beyond"))
        except TypeError:
            return False
        return (op, v) in self.without

    def _excludes(self, x: object) -> bool:
        if self.low is not None and (x < self.low[0] or x == self.low[0] and not self.low[1]):
            return True
        if self.high is not None and (x > self.high[0] or x == self.high[0] and not self.high[1]):
            return True
        return any(holds(op, v, x) is False for op, v in self.without)


def holds(op: str, v: object, x: object) -> bool | None:
    """Whether x meets a clause; None if that isn't known. A null meets clauses that name null, and no other."""
    if x is None:
        return op == "=" and v is None or op == "in" and isinstance(v, list | tuple | set) and None in v
    try:
        if op == "=":
            return x == v
        if op == "!=":
            return x != v
        if op == "in":
            return x in v
        if op == "not in":
            return x not in v
        if op == ">":
            return x > v
        if op == ">=":
            return x >= v
        if op == "<":
            return x < v
        if op == "<=":
            return x <= v
        if op == "between":
            return v[0] <= x <= v[1]
        if op == "not between":
            return not v[0] <= x <= v[1]
        if op == "outside":
            return x < v[0] or x >= v[1]
        if op == "beyond":
            return x < v[0] or x > v[1]
    except TypeError:
        return None
    return None


def _clauses(kind: str | None, op: str, v: object) -> list[tuple]:
    if kind not in dates.FORMATS:
        return [(op, v)]
    if v is None:
        return []
    found = dates.clauses(kind, op, v)
    return [] if found is None or any(c[0] == "never" for c in found) else found


def _uses(table_set: TableSet, name: str) -> list[tuple[str, str, str | None]]:
    out = []
    for t in table_set.tables:
        use = table_set.datasource.tables[t].uses().get(name)
        if use:
            kind = use[1].part if use[1].part else "datetime" if table_set.datasource.is_temporal(t, use[0].name) and not use[1].ds_formula else None
            out.append((t, use[0].name, kind))
    return out


def implied(table_set: TableSet, limit: Criterion, criteria: list[Criterion]) -> bool:
    """Whether the criteria imply a limit, on any column of the table set that provides its field."""
    name, op, value = limit
    places = _uses(table_set, name) or [(None, None, None)]
    for table, column, kind in places:
        wanted = _clauses(kind, op, value)
        if not wanted:
            continue
        allowed = Allowed()
        for n, o, v in criteria:
            if table is None:
                if n == name:
                    allowed.add(o, v)
                continue
            for t, c, k in _uses(table_set, n):
                if (t, c) == (table, column):
                    for clause in _clauses(k, o, v):
                        allowed.add(*clause)
        if allowed.known and all(allowed.implies(*w) for w in wanted):
            return True
    return False


def limits_met(table_set: TableSet, criteria: list[Criterion]) -> bool:
    """Whether all tables of a table set may be used under the criteria."""
    return all(implied(table_set, tuple(limit), criteria) for t in table_set.tables for limit in table_set.datasource.tables[t].criteria_limits or [])


