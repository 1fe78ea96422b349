"""The graph of tables: which tables a table may be joined to, and the smallest joins that provide given fields.

An edge goes from a table to one whose whole primary key it has, so a join never multiplies rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from lattica.errors import WarehouseError
from lattica.model import ColumnSpec, FieldUse, TableSpec


@dataclass(frozen=True)
class JoinStep:
    """left LEFT JOIN right on equal fields."""

    left: str
    right: str
    fields: tuple[str, ...]


@dataclass
class TableSet:
    """A base table and the joins that give it all fields of a grain."""

    datasource: object
    base: TableSpec
    steps: list[JoinStep] = field(default_factory=list)
    #: Which table provides each field of the grain.
    provider: dict[str, str] = field(default_factory=dict)

    @property
    def tables(self) -> list[str]:
        return [self.base.name, *(s.right for s in self.steps)]

    def __len__(self) -> int:
        return len(self.tables)

    def use(self, name: str) -> tuple[TableSpec, ColumnSpec, FieldUse]:
        table = self.datasource.tables[self.provider.get(name, self.base.name)]
        column, use = table.uses()[name]
        return table, column, use


def neighbours(tables: dict[str, TableSpec]) -> dict[str, list[JoinStep]]:
    """Edges of each table."""
    out: dict[str, list[JoinStep]] = {}
    for t in tables.values():
        own, found = t.uses(), {}
        if t.type == "metric":
            for d in tables.values():
                if d.type == "dimension" and d.name != t.name and all(k in own for k in d.primary_key):
                    found[d.name] = tuple(d.primary_key)
        if t.parent:
            parent = tables.get(t.parent)
            if parent is None:
                raise WarehouseError(f"table {t.name}: no parent {t.parent}")
            if missing := [k for k in parent.primary_key if k not in own]:
                raise WarehouseError(f"table {t.name} lacks {missing} of its parent's key")
            found[parent.name] = tuple(parent.primary_key)
            for s in parent.siblings:
                if s in tables and s != t.name and all(k in own for k in tables[s].primary_key):
                    found[s] = tuple(tables[s].primary_key)
        for s in t.siblings:
            if s not in tables:
                raise WarehouseError(f"table {t.name}: no sibling {s}")
            if t.type == "dimension" and all(k in own for k in tables[s].primary_key):
                found.setdefault(s, tuple(tables[s].primary_key))
        barred = set(t.incomplete_dimensions)
        out[t.name] = [JoinStep(t.name, r, f) for r, f in found.items() if not barred & set(f)]
    return out


def paths_to(edges: dict[str, list[JoinStep]], tables: dict[str, TableSpec], start: str, name: str, most: int | None = None) -> list[tuple[JoinStep, ...]]:
    """Simple paths from start to tables with the field; a path ends at the first such table. Shortest first."""
    out, open_ = [], [((), (start,))]
    while open_:
        path, seen = open_.pop(0)
        for step in edges.get(seen[-1], []):
            if step.right in seen:
                continue
            longer = (*path, step)
            if name in tables[step.right].uses():
                out.append(longer)
                if most and len(out) >= most:
                    return out
            else:
                open_.append((longer, (*seen, step.right)))
    return out


def smallest_join(edges: dict[str, list[JoinStep]], tables: dict[str, TableSpec], base: TableSpec, grain: list[str], max_candidates: int | None = 100, max_joins: int | None = None) -> tuple[list[JoinStep], dict[str, str]] | None:
    """The fewest joins that provide all fields of the grain, and each field's table; None if there are none.

    Branch and bound over the paths of each missing field, fewest paths first.
    """
    own = base.uses()
    missing = [f for f in grain if f not in own]
    choices = {}
    for f in missing:
        choices[f] = paths_to(edges, tables, base.name, f, max_candidates)
        if not choices[f]:
            return None
    order = sorted(missing, key=lambda f: (len(choices[f]), grain.index(f)))
    best: list = [None, None]
    tried = [0]

    def search(i: int, steps: dict[str, JoinStep], provider: dict[str, str]) -> None:
        if best[0] is not None and len(steps) >= len(best[0]):
            return
        if max_joins is not None and len(steps) > max_joins:
            return
        if i == len(order):
            best[0], best[1] = dict(steps), dict(provider)
            return
        f = order[i]
        if present := next((t for t in steps if f in tables[t].uses()), None):
            search(i + 1, steps, provider | {f: present})
            return
        for path in choices[f]:
            tried[0] += 1
            if max_candidates and tried[0] > max_candidates * 50 and best[0] is not None:
                return
            # a table is joined once: a path that reaches one by another way takes the way it was reached
            longer = dict(steps)
            for s in path:
                longer.setdefault(s.right, s)
            search(i + 1, longer, provider | {f: path[-1].right})

    search(0, {}, {})
    if best[0] is None:
        return None
    done, steps, left = {base.name}, [], list(best[0].values())
    while left:
        step = next((s for s in left if s.left in done), None)
        if step is None:
            return None
        left.remove(step)
        steps.append(step)
        done.add(step.right)
    return steps, {f: base.name for f in grain if f in own} | best[1]


def reachable(edges: dict[str, list[JoinStep]], start: str) -> list[str]:
    out, open_ = [start], [start]
    while open_:
        for s in edges.get(open_.pop(), []):
            if s.right not in out:
                out.append(s.right)
                open_.append(s.right)
    return out
