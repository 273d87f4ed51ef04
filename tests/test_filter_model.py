"""Random filter lists against a plain-Python model of the filter rules."""

import datetime as dt

from hypothesis import HealthCheck, given, settings, strategies as st

from bidscope.functions.dates import last_week, this_week
from bidscope.operators.filters import apply_filters

TODAY = dt.date(1998, 2, 4)
DAYS = [TODAY + dt.timedelta(days=k) for k in range(-12, 16)]
AGENCIES = ["NAVY", "ARMY", "GSA", "Navy Yard", None]


def model(row, f):
    col, op, val = f["column"], f["operator"], f.get("value")
    v = row[col]
    if op == "in":
        return v is not None and v in val
    if op == "equals":
        return v is not None and v == val
    if op == "contains":
        return v is not None and str(val).lower() in str(v).lower()
    if v is None:
        return False
    lo, hi = {
        "between": lambda: tuple(dt.date.fromisoformat(x) for x in val),
        "next_days": lambda: (TODAY, TODAY + dt.timedelta(days=val)),
        "today": lambda: (TODAY, TODAY),
        "tomorrow": lambda: (TODAY + dt.timedelta(days=1),) * 2,
        "yesterday": lambda: (TODAY - dt.timedelta(days=1),) * 2,
        "this_week": lambda: this_week(TODAY),
        "last_week": lambda: last_week(TODAY),
        "last_7_days": lambda: (TODAY - dt.timedelta(days=7), TODAY),
    }[op]()
    return lo <= v <= hi


date_filter = st.one_of(
    st.builds(lambda a, b: {"column": "Due Date", "operator": "between",
                            "value": [min(a, b).isoformat(), max(a, b).isoformat()]},
              st.sampled_from(DAYS), st.sampled_from(DAYS)),
    st.builds(lambda n: {"column": "Due Date", "operator": "next_days", "value": n},
              st.integers(-2, 14)),
    st.sampled_from([{"column": "Due Date", "operator": op} for op in
                     ("today", "tomorrow", "yesterday", "this_week", "last_week", "last_7_days")]))
text_filter = st.one_of(
    st.builds(lambda xs: {"column": "Agency", "operator": "in", "value": xs},
              st.lists(st.sampled_from(AGENCIES[:-1]), min_size=1, max_size=2)),
    st.builds(lambda x: {"column": "Agency", "operator": "equals", "value": x},
              st.sampled_from(AGENCIES[:-1])),
    st.builds(lambda x: {"column": "Agency", "operator": "contains", "value": x},
              st.sampled_from(["navy", "A", "yard", "rm"])))
rows_st = st.lists(st.tuples(st.sampled_from(AGENCIES), st.one_of(st.none(), st.sampled_from(DAYS))),
                   min_size=1, max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_st, st.lists(st.one_of(date_filter, text_filter), min_size=1, max_size=3),
       st.booleans())
def test_filters_match_model(spark, rows, filters, as_text):
    data = [(i, a, (d.isoformat() if as_text and d else d)) for i, (a, d) in enumerate(rows)]
    schema = f"id int, Agency string, `Due Date` {'string' if as_text else 'date'}"
    df = spark.createDataFrame(data, schema)
    got = sorted(r["id"] for r in apply_filters(df, filters, TODAY).collect())
    want = sorted(i for i, (a, d) in enumerate(rows)
                  if all(model({"Agency": a, "Due Date": d}, f) for f in filters))
    assert got == want
