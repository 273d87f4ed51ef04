"""Literals of F1, F2 and F5 that are no value of the column's type."""

import datetime as dt

import pytest

from bidscope.operators.filters import FilterError, apply_filters

TODAY = dt.date(1998, 2, 4)


def keys(spark, f):
    df = spark.createDataFrame([(5, 1.5, "5", dt.date(1998, 2, 5)), (-(1 << 63), 1e30, "x", None),
                                ((1 << 63) - 1, float("inf"), "1e30", dt.date(9999, 12, 31))],
                               "n long, d double, t string, `Due Date` date")
    return [r.n for r in apply_filters(df, [f], TODAY).collect()]


@pytest.mark.parametrize("column,value,want", [
    ("n", "1e30", []), ("n", 10 ** 30, []), ("n", "1e400", []), ("n", "inf", []), ("n", "nan", []),
    ("n", 5.0, [5]), ("n", "5.0", [5]), ("n", 5.5, []), ("n", -(1 << 63), [-(1 << 63)]),
    ("n", 1 << 63, []), ("n", "x", []), ("n", None, []), ("d", 10 ** 30, [-(1 << 63)]),
    ("d", "1e30", [-(1 << 63)]), ("t", "1e30", [(1 << 63) - 1]), ("t", 5, [5])])
def test_equals(spark, column, value, want):
    assert keys(spark, {"column": column, "operator": "equals", "value": value}) == want
    assert keys(spark, {"column": column, "operator": "in", "value": [10 ** 20, value]}) == want


@pytest.mark.parametrize("value", [[5], {"a": 5}, (5,)])
def test_equals_takes_one_value(spark, value):
    with pytest.raises(FilterError):
        keys(spark, {"column": "n", "operator": "equals", "value": value})
    with pytest.raises(FilterError):
        keys(spark, {"column": "n", "operator": "in", "value": [value]})


@pytest.mark.parametrize("value,n", [(1, 1), (1.7, 1), ("1.0", 1), (0.9, 0), (10 ** 9, 2),
                                     (-(10 ** 9), 0), ("1e9", 2)])
def test_next_days(spark, value, n):
    assert len(keys(spark, {"column": "Due Date", "operator": "next_days", "value": value})) == n


@pytest.mark.parametrize("value", ["1.5", "soon", None, True, "nan", [1]])
def test_next_days_needs_a_number(spark, value):
    with pytest.raises(FilterError):
        keys(spark, {"column": "Due Date", "operator": "next_days", "value": value})
