"""Dimensions derived from date and time columns, and range predicates on the raw column for them.

A filter such as year = 1996 on a derived dimension becomes a half-open range on the column itself, so
that it reaches the scan. Literals that are no date give no rows, not an error.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = [dt.date(2000, m, 1).strftime("%B") for m in range(1, 13)]
DAYS = [dt.date(2000, 1, 3 + d).strftime("%A") for d in range(7)]


@dataclass(frozen=True)
class DatePart:
    """A derived dimension: its type, its expression, and whether a date column has it as well."""

    type: str
    make: Callable[[Column], Column]
    for_dates: bool = True
    values: tuple[str, ...] | None = None
    description: str = ""


def _week(c: Column) -> Column:
    return F.concat(F.date_format(c, "yyyy"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


PARTS: dict[str, DatePart] = {
    "year": DatePart("smallinteger", F.year, description="Year"),
    "quarter": DatePart("string(8)", lambda c: F.concat(F.date_format(c, "yyyy"), F.lit("-Q"), F.quarter(c).cast("string")), description="Year and quarter"),
    "quarter_of_year": DatePart("smallinteger", F.quarter, description="Numeric quarter"),
    "month": DatePart("string(8)", lambda c: F.date_format(c, "yyyy-MM"), description="Year and month"),
    "month_name": DatePart("string(8)", lambda c: F.date_format(c, "MMMM"), values=tuple(MONTHS), description="Full month name"),
    "month_of_year": DatePart("smallinteger", F.month, description="Numeric month"),
    "week": DatePart("string(8)", _week, description="Year and ISO week"),
    "week_of_year": DatePart("smallinteger", F.weekofyear, description="ISO week"),
    "week_of_month": DatePart("smallinteger", lambda c: F.weekofyear(c) - F.weekofyear(F.trunc(c, "MM")) + 1, description="Week in its month"),
    "period_of_month_7d": DatePart("smallinteger", lambda c: (F.floor((F.dayofmonth(c) - 1) / 7) + 1).cast("int"), description="Seven-day period in its month"),
    "date": DatePart("string(10)", lambda c: F.date_format(c, "yyyy-MM-dd"), description="Date"),
    "day_name": DatePart("string(10)", lambda c: F.date_format(c, "EEEE"), values=tuple(DAYS), description="Full day name"),
    "day_of_week": DatePart("smallinteger", lambda c: F.weekday(c) + 1, description="Day of the week, Monday is 1"),
    "is_weekday": DatePart("smallinteger", lambda c: F.when(c.isNotNull(), F.when(F.weekday(c) < 5, 1).otherwise(0)), description="1 from Monday to Friday"),
    "day_of_month": DatePart("smallinteger", F.dayofmonth, description="Day of the month"),
    "day_of_year": DatePart("smallinteger", F.dayofyear, description="Day of the year"),
    "hour": DatePart("string(20)", lambda c: F.date_format(c, "yyyy-MM-dd HH:00:00"), False, description="Date and hour"),
    "hour_of_day": DatePart("smallinteger", F.hour, False, description="Hour of the day"),
    "minute": DatePart("string(20)", lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:00"), False, description="Date, hour and minute"),
    "minute_of_hour": DatePart("smallinteger", F.minute, False, description="Minute of the hour"),
    "datetime": DatePart("string(20)", lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), False, description="Date and time in seconds"),
}


def unixtime(c: Column) -> Column:
    """Seconds since 1970; an expression for formulas, not one of the derived dimensions."""
    return F.unix_timestamp(c.cast("timestamp"))


#: Formats of literals for the derived dimensions that have ranges.
FORMATS = {"year": "%Y", "month": "%Y-%m", "date": "%Y-%m-%d", "hour": "%Y-%m-%d %H:%M:%S", "minute": "%Y-%m-%d %H:%M:%S", "datetime": "%Y-%m-%d %H:%M:%S"}
_RELATIVE = re.compile(r"^(?:last\s+)?(\d+)\s+(minute|hour|day|week)s?(?:\s+ago)?$")


def truncated(kind: str, t: dt.datetime) -> dt.datetime:
    zero = {"second": 0, "microsecond": 0}
    return {
        "year": lambda: t.replace(month=1, day=1, hour=0, minute=0, **zero),
        "month": lambda: t.replace(day=1, hour=0, minute=0, **zero),
        "date": lambda: t.replace(hour=0, minute=0, **zero),
        "hour": lambda: t.replace(minute=0, **zero),
        "minute": lambda: t.replace(**zero),
        "datetime": lambda: t,
    }[kind]()


def start_of(kind: str, value: object, now: Callable[[], dt.datetime] = dt.datetime.now) -> dt.datetime | None:
    """The first moment of a value; None where it is no such value. Relative values count back from now."""
    if isinstance(value, dt.datetime):
        return truncated(kind, value)
    if isinstance(value, dt.date):
        return truncated(kind, dt.datetime(value.year, value.month, value.day))
    text = str(value).strip()
    low = text.lower()
    if low in ("today", "yesterday"):
        return truncated(kind, now() - dt.timedelta(days=low == "yesterday"))
    if m := _RELATIVE.match(low):
        if not (kind == "year" and low.isdigit()):
            return truncated(kind, now() - dt.timedelta(**{f"{m[2]}s": int(m[1])}))
    for form in dict.fromkeys([FORMATS[kind], "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d %H", "%Y-%m-%d", "%Y-%m", "%Y"]):
        try:
            return truncated(kind, dt.datetime.strptime(text, form))
        except ValueError:
            pass
    return None


def end_of(kind: str, start: dt.datetime) -> dt.datetime:
    """The first moment after the value that begins at start."""
    if kind == "year":
        return start.replace(year=start.year + 1)
    if kind == "month":
        return start.replace(year=start.year + start.month // 12, month=start.month % 12 + 1)
    return start + {"date": dt.timedelta(days=1), "hour": dt.timedelta(hours=1), "minute": dt.timedelta(minutes=1), "datetime": dt.timedelta(0)}[kind]


#: What a range predicate is made of: (operator, moment), all of which must hold; "outside" has two moments.
Clause = tuple[str, object]


def clauses(kind: str, op: str, value: object, now: Callable[[], dt.datetime] = dt.datetime.now) -> list[Clause] | None:
    """The ranges for a criterion on a derived dimension; None where the operator has none, [] never holds."""
    pair = op in ("between", "not between")
    if op not in ("=", "!=", ">", ">=", "<", "<=", "between", "not between") or (isinstance(value, list | tuple) and not pair):
        return None
    starts = [start_of(kind, v, now) for v in (value if pair else [value])]
    if any(s is None for s in starts):
        return [("never", None)]
    lo, hi = starts[0], starts[-1]
    if kind == "datetime":
        if pair:
            return [(">=", lo), ("<=", hi)] if op == "between" else [("beyond", (lo, hi))]
        return [(op, lo)]
    after = end_of(kind, hi)
    return {
        "=": [(">=", lo), ("<", after)], "!=": [("outside", (lo, after))], ">": [(">=", after)], ">=": [(">=", lo)], "<": [("<", lo)], "<=": [("<", after)],
        "between": [(">=", lo), ("<", after)], "not between": [("outside", (lo, after))],
    }[op]


def range_predicate(c: Column, kind: str, op: str, value: object) -> Column | None:
    """The predicate on the raw column for a criterion on its derived dimension, if there is one."""
    if value is None:
        return {"=": c.isNull(), "!=": c.isNotNull()}.get(op)
    found = clauses(kind, op, value)
    if found is None:
        return None
    out = None
    for what, v in found:
        if what == "never":
            one = F.lit(False)
        elif what == "outside":
            one = (c < F.lit(v[0]).cast("timestamp_ntz")) | (c >= F.lit(v[1]).cast("timestamp_ntz"))
        elif what == "beyond":
            one = (c < F.lit(v[0]).cast("timestamp_ntz")) | (c > F.lit(v[1]).cast("timestamp_ntz"))
        else:
            at = F.lit(v).cast("timestamp_ntz")
            one = {"=": c == at, "!=": c != at, ">": c > at, ">=": c >= at, "<": c < at, "<=": c <= at}[what]
        out = one if out is None else out & one
    return out
