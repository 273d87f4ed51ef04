"""Date scalars: lenient text-to-date (D1), "today" in a zone (D2), weeks.

D1 is one ``CASE`` over built-in functions.  Each accepted layout is guarded
by a regex so that ``try_cast`` never accepts trailing junk, and text never
goes through a zoned timestamp (that would shift offset dates by a day).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PY_WHITESPACE, PY_WHITESPACE_CLASS, col_ref, py_strip

DEFAULT_TZ = "Africa/Lagos"

# Accepted text layouts, tried per row (a superset of one-format-per-column).
_CLOCK = r"([01]?[0-9]|2[0-3])(:[0-5][0-9](:[0-5][0-9]([.,][0-9]{1,9})?)?)?"
_ZONE = r"([Zz]|[A-Za-z]{2,5}|(UTC|GMT)? ?[+-][0-9]{1,2}(:?[0-9]{2})?)"
ISO_RE = rf"^[0-9]{{4}}(-[0-9]{{1,2}}(-[0-9]{{1,2}}([ T]{_CLOCK} ?([AaPp][Mm])? ?{_ZONE}?)?)?)?$"
COMPACT_RE = r"^[0-9]{8}$"
US_RE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?( ?[AaPp][Mm])?)?$"
US_DATE_PART = r"^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"
NAMED_RE = r"^[A-Za-z]{3,9} [0-9]{1,2}, [0-9]{4}$"

# Further layouts, by shape: a date in one of these orders, with one of the
# separators, an optional weekday in front and an optional time and zone
# behind (the local date is kept, whatever the zone).
_DAY_NAME = r"(?:(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_MONTH_NAME = (r"((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?i:uary|ruary|ch|il|e|y|ust|"
               r"t|tember|ober|ember)?)\.?")
_TIME = (r"(?:(?:\s+(?:at\s+)?|\s*,\s*|[Tt])(?:[01]?[0-9]|2[0-3])(?::?[0-5][0-9]){0,2}"
         r"(?:[.,][0-9]{1,9})?\s*(?:[AaPp]\.?[Mm]\.?)?"
         r"\s*(?:[Zz]|\(?[A-Za-z]{2,5}\)?|(?:UTC|GMT)?\s*[+-][0-9]{1,2}(?::?[0-9]{2})?)?)?")
_YEAR = r"([0-9]{4}|'?[0-9]{2})"
_NTH = r"(?:st|nd|rd|th)?"
YEAR_FIRST = rf"^{_DAY_NAME}([0-9]{{4}})[-/. ]([0-9]{{1,2}})[-/. ]([0-9]{{1,2}}){_TIME}$"
YEAR_NAME = rf"^{_DAY_NAME}([0-9]{{4}})[-/. ]\s*{_MONTH_NAME}[-/. ]\s*([0-9]{{1,2}}){_TIME}$"
YEAR_LAST = rf"^{_DAY_NAME}([0-9]{{1,2}})[-/. ]([0-9]{{1,2}})[-/. ]{_YEAR}{_TIME}$"
DAY_NAME = rf"^{_DAY_NAME}([0-9]{{1,2}}){_NTH}[-/., ]*{_MONTH_NAME}[-/., ]*{_YEAR}{_TIME}$"
NAME_DAY = rf"^{_DAY_NAME}{_MONTH_NAME}[-/. ]*([0-9]{{1,2}}){_NTH}(?:\s*,\s*|[-/. ]+){_YEAR}{_TIME}$"
COMPACT_TIME = (r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:[ Tt][0-9]{2}:?[0-9]{2}(?::?[0-9]{2})?|[0-9]{6}|"
                r"[0-9]{4})(?:\s*(?:[Zz]|[A-Za-z]{2,5}|[+-][0-9]{2}:?[0-9]{2}))?$")
# A month of a year is its first day.
NAME_YEAR = rf"^{_MONTH_NAME}[-/., ]+([0-9]{{4}})$"
NUMBER_YEAR = r"^([0-9]{1,2})[-/]([0-9]{4})$"
YEAR_NUMBER = r"^([0-9]{4})[/.]([0-9]{1,2})$"
# A time in front, or between the day and the year, is taken away first.
TIME_AHEAD = (r"^(?:(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?\s*(?:[AaPp][Mm])?|"
              r"(?:1[0-2]|0?[1-9])\s*[AaPp][Mm])[\s,]+(?:on\s+)?")
TIME_INSIDE = rf"^{_DAY_NAME}({_MONTH_NAME}\s+[0-9]{{1,2}})\s+(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?\s+(?:[A-Z]{{2,5}}\s+)?([0-9]{{4}})$"
# Years of two digits from here on are of the last century.
CENTURY_FROM = 69
LONGEST = 64


def _padded(rx: str) -> str:
    """``rx`` (anchored) allowing Python whitespace around the value."""
    return f"^{PY_WHITESPACE_CLASS}*(?:{rx[1:-1]}){PY_WHITESPACE_CLASS}*$"


# Every Python whitespace code point is <= 32 or >= 128; the checks below
# may admit more than the guard does (the guard still decides), never less.
assert all(ord(c) <= 32 or ord(c) >= 128 for c in PY_WHITESPACE)


def _year(two_or_four: Column) -> Column:
    digits = F.regexp_replace(two_or_four, "'", "")
    short = digits.try_cast("int")
    return F.when(F.length(digits) > 2, digits).otherwise(
        (short + F.when(short >= CENTURY_FROM, 1900).otherwise(2000)).cast("string"))


def _month(name: Column) -> Column:
    """The number of a month's name, by its first three letters."""
    place = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3)))
    return ((place + 2) / 3).cast("int").cast("string")


def _shaped(t: Column, day_first: bool = False) -> Column:
    """The further layouts as a date.  Of two numbers that can both be the
    month the first one is, or the second one with ``day_first``; a first
    number above 31 is the year."""
    t = F.regexp_replace(F.regexp_replace(t, TIME_AHEAD, ""), TIME_INSIDE, "$1 $3")

    def part(shape: str, k: int) -> Column:
        return F.regexp_extract(t, shape, k)

    def date(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, m, d).try_cast("date")

    a, b, c = (part(YEAR_LAST, k) for k in (1, 2, 3))
    first, second = a.try_cast("int"), b.try_cast("int")
    turned = (second <= 12) if day_first else (first > 12)
    one = F.lit("1")
    return (
        F.when(t.rlike(YEAR_FIRST), date(part(YEAR_FIRST, 1), part(YEAR_FIRST, 2),
                                         part(YEAR_FIRST, 3)))
        .when(t.rlike(YEAR_LAST), F.when(first > 31, date(_year(a), b, c)).otherwise(
            date(_year(c), F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b))))
        .when(t.rlike(DAY_NAME), date(_year(part(DAY_NAME, 3)), _month(part(DAY_NAME, 2)),
                                      part(DAY_NAME, 1)))
        .when(t.rlike(NAME_DAY), date(_year(part(NAME_DAY, 3)), _month(part(NAME_DAY, 1)),
                                      part(NAME_DAY, 2)))
        .when(t.rlike(YEAR_NAME), date(part(YEAR_NAME, 1), _month(part(YEAR_NAME, 2)),
                                       part(YEAR_NAME, 3)))
        .when(t.rlike(COMPACT_TIME), date(part(COMPACT_TIME, 1), part(COMPACT_TIME, 2),
                                          part(COMPACT_TIME, 3)))
        .when(t.rlike(NAME_YEAR), date(part(NAME_YEAR, 2), _month(part(NAME_YEAR, 1)), one))
        .when(t.rlike(NUMBER_YEAR), date(part(NUMBER_YEAR, 2), part(NUMBER_YEAR, 1), one))
        .when(t.rlike(YEAR_NUMBER), date(part(YEAR_NUMBER, 1), part(YEAR_NUMBER, 2), one))
        # What is left once the time in front is gone.
        .when(t.rlike(ISO_RE), t.try_cast("date")))


def _other_shape(raw: Column) -> Column:
    # A date has a digit or two, is short, and starts with a digit or a
    # letter of a month's or a weekday's name; other text ends here.
    return (F.length(raw) <= LONGEST) & raw.rlike(
        rf"^{PY_WHITESPACE_CLASS}*(?:[0-9]{{1,4}}[-/., A-Za-z:]|[0-9]{{8}}[ Tt0-9]|"
        r"(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|mon|tue|wed|thu|fri|sat|sun)).*[0-9]")


def may_be_date(raw: Column) -> Column:
    """Whether text has a layout that ``text_to_date`` tries: it never parses
    other text, and which digits stand there does not matter."""
    guards = [raw.rlike(_padded(shape)) for shape in (ISO_RE, COMPACT_RE, US_RE, NAMED_RE)]
    return guards[0] | guards[1] | guards[2] | guards[3] | _other_shape(raw)


def text_to_date(text: Column, mostly_not_dates: bool = False, day_first: bool = False) -> Column:
    """Lenient, never-raising parse of date text; unparsable gives NULL.

    The layout guards run on the raw text (whitespace allowed around it) and
    only the chosen branch strips it, so the parse stays cheap when Catalyst
    copies it into a filter.

    ``mostly_not_dates`` (role detection over arbitrary columns) puts each
    guard behind facts it implies and that cost no regex -- the first
    character is a digit (a letter for month names) or possibly whitespace,
    a US date has a ``/``, a named one a ``,`` -- so ordinary text never
    reaches a regex.  On real date columns the plain form is cheaper.

    ``day_first`` is the order of a column whose numbers say so
    (``day_first_columns``); it decides cells that fit both orders.
    """
    raw = text.cast("string")
    t = py_strip(raw)
    if mostly_not_dates:
        first = F.ascii(raw)
        space = (first <= 32) | (first >= 128)  # cheap superset of leading whitespace
        digit = first.between(48, 57) | space
        letter = first.between(65, 90) | first.between(97, 122) | space
        iso = digit & raw.rlike(_padded(ISO_RE))
        compact = digit & (F.length(raw) >= 8) & raw.rlike(_padded(COMPACT_RE))
        us = digit & (F.instr(raw, "/") > 0) & raw.rlike(_padded(US_RE))
        named = letter & (F.instr(raw, ",") > 0) & raw.rlike(_padded(NAMED_RE))
    else:
        iso = raw.rlike(_padded(ISO_RE))
        compact = raw.rlike(_padded(COMPACT_RE))
        us = raw.rlike(_padded(US_RE))
        named = raw.rlike(_padded(NAMED_RE))
    other = _other_shape(raw)
    common = (
        F.when(iso, t.try_cast("date"))
        .when(compact, F.try_to_date(t, "yyyyMMdd"))
        .when(us, F.try_to_date(F.regexp_extract(t, US_DATE_PART, 1),
                                 "d/M/yyyy" if day_first else "M/d/yyyy"))
        .when(named, F.coalesce(F.try_to_date(t, "MMM d, yyyy"),
                                F.try_to_date(t, "MMMM d, yyyy")))
    )
    # The rarer layouts stay out of the generated code, as a function of an
    # array's element: with them every date would be past the method limit.
    rare = F.get(F.transform(F.array(t), lambda x: _shaped(x, day_first)), F.lit(0))
    return F.coalesce(common, F.when(other, rare))


NUMBERS = rf"^{PY_WHITESPACE_CLASS}*{_DAY_NAME}([0-9]{{1,2}})[-/. ]([0-9]{{1,2}})[-/. ]'?[0-9]{{2}}"


def day_first_columns(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """The text columns whose cells show that the day comes first: more cells
    whose first number can only be a day than cells whose second can.  One
    aggregate for all columns; ambiguous cells then follow their column."""
    evidence = []
    for i, name in enumerate(columns):
        text = col_ref(name).cast("string")
        first, second = (F.regexp_extract(text, NUMBERS, k).try_cast("int") for k in (1, 2))
        evidence += [F.count_if(first.between(13, 31) & (second <= 12)).alias(f"d{i}"),
                     F.count_if(second.between(13, 31) & (first <= 12)).alias(f"m{i}")]
    if not evidence:
        return set()
    r = df.agg(*evidence).first()
    return {name for i, name in enumerate(columns) if r[f"d{i}"] > r[f"m{i}"]}


def force_date(c: Column, dtype: T.DataType | None = None,
               mostly_not_dates: bool = False, day_first: bool = False) -> Column:
    """Any column to DATE.  Typed columns take the cheap path."""
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        s = c.cast("string")
        return F.when(s.rlike(COMPACT_RE), F.try_to_date(s, "yyyyMMdd"))
    return text_to_date(c, mostly_not_dates, day_first)


def today_in(tz: str = DEFAULT_TZ, now: _dt.datetime | None = None) -> _dt.date:
    """The calendar date in ``tz``, read once per run on the driver."""
    now = now or _dt.datetime.now(_dt.timezone.utc)
    return now.astimezone(ZoneInfo(tz)).date()


def resolve_today(today: _dt.date | str | None, tz: str = DEFAULT_TZ) -> _dt.date:
    if today is None:
        return today_in(tz)
    if isinstance(today, _dt.datetime):
        return today.date()
    if isinstance(today, _dt.date):
        return today
    return _dt.date.fromisoformat(str(today))


def week_of(today: _dt.date, offset: int = 0) -> tuple[_dt.date, _dt.date]:
    """First and last day of the ISO week ``offset`` weeks from ``today``'s."""
    year, week, _ = (today + _dt.timedelta(weeks=offset)).isocalendar()
    return tuple(_dt.date.fromisocalendar(year, week, day) for day in (1, 7))


def this_week(today: _dt.date) -> tuple[_dt.date, _dt.date]:
    """D3."""
    return week_of(today)


def last_week(today: _dt.date) -> tuple[_dt.date, _dt.date]:
    """D4."""
    return week_of(today, -1)
