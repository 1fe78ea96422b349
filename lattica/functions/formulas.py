"""Formula texts: field references, a guard against statements, aggregates, and division that gives NULL for zero."""

from __future__ import annotations

import re
from collections.abc import Callable

from lattica.errors import DisallowedSQL, InvalidField, MaxFormulaDepth

MAX_DEPTH = 5
_REF = re.compile(r"\{(\w+)\}")
_TOKEN = re.compile(r"""(?P<space>\s+)|(?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<quoted>`[^`]*`)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[A-Za-z_][\w$]*(?:\.(?:[A-Za-z_][\w$]*|`[^`]*`))*)|(?P<ref>\{\w+\})|(?P<comment>--|/\*|\*/|\#)|(?P<op>::|<=>|<>|!=|>=|<=|==|\|\||&&|.)""", re.S)

#: Words that no formula may have.
FORBIDDEN = set(
    "select insert update delete merge replace_into truncate drop create alter rename grant revoke set use show describe explain with from join union intersect except "
    "into values where having call execute exec attach detach pragma vacuum commit rollback begin load copy refresh cache uncache analyze exists java_method reflect".split()
)
#: Functions that aggregate.
AGGREGATES = set("avg sum min max count count_distinct std stddev stddev_samp stddev_pop median mode var variance var_samp var_pop mean first last any_value approx_count_distinct percentile percentile_approx bool_or bool_and".split())


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token; texts add up to the input."""
    return [(m.lastgroup or "op", m[0]) for m in _TOKEN.finditer(text)]


def check(text: str) -> str:
    """The formula itself; DisallowedSQL if it holds anything but an expression."""
    depth, last = 0, ("", "")
    for kind, t in tokens(text):
        if kind == "comment" or t == ";":
            raise DisallowedSQL(f"{t!r} in formula {text!r}")
        if kind == "word" and t.lower() in FORBIDDEN and not ("." in t):
            if not (t.lower() == "from" and re.search(r"extract\s*\(\s*\w+\s+$|trim\s*\([^()]*$", text[: text.lower().find("from")].lower())):
                raise DisallowedSQL(f"{t!r} in formula {text!r}")
        if kind in ("word", "number", "string", "quoted") and last[0] in ("word", "number", "quoted") and kind != "op":
            pair = {last[1].lower(), t.lower()}
            words = {"and", "or", "not", "is", "null", "like", "rlike", "in", "between", "case", "when", "then", "else", "end", "distinct", "as", "date", "timestamp", "interval", "div", "over", "partition", "order", "by", "asc", "desc", "rows", "range", "true", "false", "escape", "year", "month", "day", "hour", "minute", "second", "from", "filter", "ilike", "both", "leading", "trailing"}
            if not pair & words:
                raise DisallowedSQL(f"{last[1]} {t} in formula {text!r}")
        if kind == "op":
            depth += (t == "(") - (t == ")")
            if depth < 0:
                raise DisallowedSQL(f"unbalanced parentheses in {text!r}")
        if kind != "space":
            last = (kind, t)
    if depth:
        raise DisallowedSQL(f"unbalanced parentheses in {text!r}")
    return text


def references(text: str) -> list[str]:
    """Names of the fields that a formula refers to, in order, each once."""
    return list(dict.fromkeys(_REF.findall(text)))


def aggregates(text: str) -> bool:
    """Whether the formula calls an aggregate function."""
    found = [x for x in tokens(text) if x[0] != "space"]
    return any(kind == "word" and t.lower() in AGGREGATES and after[1] == "(" for (kind, t), after in zip(found, found[1:], strict=False))


def expanded(name: str, formula_of: Callable[[str], str | None], depth: int = 0) -> tuple[str, list[str]]:
    """A field's formula down to raw fields (kept as {name}), and those fields. formula_of: None for raw fields."""
    if depth > MAX_DEPTH:
        raise MaxFormulaDepth(f"{name}: more than {MAX_DEPTH} formulas within each other")
    formula = formula_of(name)
    if formula is None:
        return f"{{{name}}}", [name]
    raw: dict[str, None] = {}

    def put(m: re.Match) -> str:
        if m[1] == name:
            raise InvalidField(f"formula of {name} refers to itself")
        text, fields = expanded(m[1], formula_of, depth + 1)
        raw.update(dict.fromkeys(fields))
        return text

    return "(" + _REF.sub(put, check(formula)) + ")", list(raw)


def _operand_end(found: list[tuple[str, str]], i: int) -> int:
    """The index after the operand that begins at i."""

    def skip(i: int) -> int:
        while i < len(found) and found[i][0] == "space":
            i += 1
        return i

    def closed(i: int) -> int:
        depth = 0
        while i < len(found):
            depth += (found[i][1] == "(") - (found[i][1] == ")")
            i += 1
            if not depth:
                return i
        return i

    i = skip(i)
    while i < len(found) and found[i][1] in "+-~":
        i = skip(i + 1)
    if i < len(found) and found[i][1] == "(":
        return closed(i)
    if i < len(found) and found[i][0] == "word" and found[i][1].lower() == "case":
        depth = 0
        while i < len(found):
            word = found[i][1].lower() if found[i][0] == "word" else ""
            depth += (word == "case") - (word == "end")
            i += 1
            if not depth:
                return i
    i += 1
    j = skip(i)
    return closed(j) if j < len(found) and found[j][1] == "(" and found[i - 1][0] == "word" else i


def null_for_zero(text: str) -> str:
    """The formula with every divisor d as nullif(d, 0)."""
    found, out, i = tokens(text), [], 0
    while i < len(found):
        kind, t = found[i]
        out.append(t)
        i += 1
        if kind == "op" and t in "/%":
            end = _operand_end(found, i)
            out.append(f" nullif({null_for_zero(''.join(x[1] for x in found[i:end]).strip())}, 0)")
            i = end
    return "".join(out)


def bound(text: str, column_of: Callable[[str], str]) -> str:
    """The formula with each {field} as the column name that column_of gives."""
    return null_for_zero(_REF.sub(lambda m: f"`{column_of(m[1])}`", text))
