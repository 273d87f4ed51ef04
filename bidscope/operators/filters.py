"""Plan filters (F1-F15) as one conjunctive predicate.

Every filter becomes a ``Column`` predicate with literal operands: dates are
resolved once per run on the driver (``today``), literals are cast to the
column's type, and the conjunction is a single ``where``.  Catalyst then
pushes date ranges and equalities into the parquet scan.
"""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import force_date, last_week, resolve_today, this_week
from ..functions.text import col_ref
from .project import DATE_COLUMNS, DERIVED, is_derived

# The operator vocabulary of a plan.
OPERATORS = ("equals", "in", "contains", "between", "next_days", "today", "tomorrow",
             "yesterday", "this_week", "last_week", "last_7_days")
DATE_OPERATORS = OPERATORS[3:]


class FilterError(ValueError):
    """A filter cannot be applied to the column it names (analysis-time)."""


def _is_datelike(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _as_date(c: Column, dt: T.DataType) -> Column:
    return c if isinstance(dt, T.DateType) else F.to_date(c)


def _typed_literal(value, dt: T.DataType) -> Column:
    """Cast the *literal* to the column type (never the column), so the
    comparison stays pushable; text that does not fit becomes NULL."""
    if isinstance(value, (Mapping, list, tuple, set)):
        raise FilterError(f"a filter value must be a single value, got {value!r}")
    if isinstance(dt, T.DateType):
        return force_date(F.lit(None if value is None else str(value)))
    if isinstance(value, bool):
        value = str(value).lower()
    if isinstance(dt, T.IntegralType):
        # A cast would cut a fraction off; a literal with one, or beyond 64
        # bits, equals no integer.
        try:
            number = Decimal(str(value))
            whole = (number.is_finite() and number == number.to_integral_value()
                     and -(1 << 63) <= number < 1 << 63)
            value = int(number) if whole else None
        except ArithmeticError:
            pass
    if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
        value = str(value)
    return F.lit(value).try_cast(dt)


def _days(val, name: str) -> int:
    """A number of days: a number loses its fraction, text has to be whole."""
    try:
        number = Decimal(str(val))
        if number.is_finite() and not isinstance(val, bool):
            # Wider than the calendar is as good as its end.
            days = max(Decimal(-4_000_000), min(Decimal(4_000_000), number))
            if not isinstance(val, str) or days == days.to_integral_value():
                return int(days)
    except ArithmeticError:
        pass
    raise FilterError(f"next_days on {name!r} needs a whole number of days, got {val!r}")


def _date_range(c: Column, lo, hi, derived: bool = False) -> Column:
    """Inclusive range; NULL never matches.

    On a stored DATE column the two comparisons reach the parquet scan as
    pushed filters.  On a parsed (derived) date Catalyst would copy the whole
    parse into each comparison, so the test references it once:
    ``|2 * (d - lo) - (hi - lo)| <= hi - lo``.
    """
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    if not derived:
        return (c >= lo_c) & (c <= hi_c)
    width = F.datediff(hi_c, lo_c)
    return F.abs(F.datediff(c, lo_c) * 2 - width) <= width


def filter_predicate(df: DataFrame, f: Mapping, today: _dt.date, strict: bool = False,
                     regex_contains: bool = False, notes: list[str] | None = None,
                     ref=col_ref) -> Column | None:
    """One filter to a predicate; ``None`` means "skip" (lenient, F13).

    ``df`` supplies names, types and the derived flag; ``ref`` maps a name to
    the column the predicate reads (by default the column of that name).
    """
    if not isinstance(f, Mapping):
        return _skip(f"filter {f!r} is not an object", strict, notes)
    name, op, val = f.get("column"), f.get("operator"), f.get("value")
    if not name or name not in df.columns:
        return _skip(f"filter column {name!r} not in the table", strict, notes)
    dt = df.schema[name].dataType
    c = ref(name)
    derived = is_derived(df, name)
    if name in DATE_COLUMNS and not _is_datelike(dt):   # F14
        c, dt, derived = force_date(c, dt), T.DateType(), True

    if op == "in":                                       # F1 (+Q15, Q19)
        values = list(val) if isinstance(val, (list, tuple, set)) else [val]
        return c.isin([_typed_literal(v, dt) for v in values])
    if op == "equals":                                   # F2 (+Q15, Q16)
        return c == _typed_literal(val, dt)
    if op == "contains":                                 # F3 (+Q13)
        text = c.cast("string")
        needle = "" if val is None else str(val)
        if regex_contains:
            try:
                re.compile(needle)
            except re.error as e:
                raise FilterError(f"bad pattern {needle!r} for contains: {e}") from e
            return text.rlike("(?i)" + needle)
        return F.lower(text).contains(needle.lower())
    if op not in DATE_OPERATORS:
        return _skip(f"unknown operator {op!r} on {name!r}", strict, notes)

    if not _is_datelike(dt):                             # Q18
        raise FilterError(f"operator {op!r} needs a date column; {name!r} is {dt.simpleString()}")
    d = _as_date(c, dt)
    if op == "between":                                  # F4 (+Q17)
        if not isinstance(val, (list, tuple)) or len(val) < 2:
            return _skip(f"between on {name!r} without two bounds", strict, notes)
        lo = _typed_literal(val[0], T.DateType())
        hi = _typed_literal(val[1], T.DateType())
        return _date_range(d, lo, hi, derived)
    if op == "next_days":                                # F5
        # No day lies between today and an earlier one, however much earlier.
        days = max(-1, min(_days(val, name), (_dt.date.max - today).days))
        last = today + _dt.timedelta(days=days)
        return _date_range(d, today, last, derived)
    if op == "today":                                    # F6
        return d == F.lit(today)
    if op == "tomorrow":                                 # F7
        return d == F.lit(today + _dt.timedelta(days=1))
    if op == "yesterday":                                # F8
        return d == F.lit(today - _dt.timedelta(days=1))
    if op == "this_week":                                # F9
        return _date_range(d, *this_week(today), derived)
    if op == "last_week":                                # F10
        return _date_range(d, *last_week(today), derived)
    # last_7_days, F11: eight calendar days, today included
    return _date_range(d, today - _dt.timedelta(days=7), today, derived)


def _skip(msg: str, strict: bool, notes: list[str] | None):
    if strict:
        raise FilterError(msg)
    if notes is not None:
        notes.append("skipped: " + msg)
    return None


def combined_predicate(df: DataFrame, filters: Sequence[Mapping] | None, today=None,
                       tz: str = "Africa/Lagos", strict: bool = False,
                       regex_contains: bool = False, notes: list[str] | None = None,
                       ref=col_ref) -> Column | None:
    """AND of all filters in list order; ``None`` when nothing applies."""
    if not filters:
        return None
    day = resolve_today(today, tz)
    preds = [p for p in (filter_predicate(df, f, day, strict, regex_contains, notes, ref)
                         for f in filters) if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else None


def apply_filters(df: DataFrame, filters: Sequence[Mapping] | None, today=None,
                  tz: str = "Africa/Lagos", strict: bool = False, regex_contains: bool = False,
                  notes: list[str] | None = None) -> DataFrame:
    """F1-F14 over a canonical table; one ``where``, no action."""
    df = _recoerce_dates(df, filters)
    pred = combined_predicate(df, filters, today, tz, strict, regex_contains, notes)
    return df if pred is None else df.where(pred)


def _recoerce_dates(df: DataFrame, filters) -> DataFrame:
    """a filtered date column that arrives as text becomes DATE."""
    names = {f.get("column") for f in (filters or []) if isinstance(f, Mapping)}
    for name in DATE_COLUMNS:
        if name in names and name in df.columns:
            dt = df.schema[name].dataType
            if not _is_datelike(dt):
                df = df.withColumn(name, force_date(col_ref(name), dt).alias(
                    name, metadata={DERIVED: True}))
    return df
