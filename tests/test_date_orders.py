"""Month-level and free-order date text, and the order of a column."""

import pytest
from pyspark.sql import functions as F

from bidscope.functions.dates import day_first_columns, force_date

CASES = [
    ("Feb 2024", "2024-02-01"), ("02/2024", "2024-02-01"), ("2024/2", "2024-02-01"),
    ("07Feb2024", "2024-02-07"), ("12:30 2024-02-01", "2024-02-01"),
    ("Thu Feb 1 12:00:00 2024", "2024-02-01"), ("Feb 1st, 2024 at 5:00 PM", "2024-02-01"),
    ("5 PM May 1 2024", "2024-05-01"), ("99/12/31", "1999-12-31"), ("13/2024", None),
    ("2024-02-01 25:99", None), ("2024-02-01T10:00:00 America/New_York", None),
    ("2024-02-01 10:61", None), ("2024-02-01T23:30:00-05:00", "2024-02-01"),
    ("2024-02-01 08:00:00.123", "2024-02-01"), ("2024-02-01T08:00Z", "2024-02-01"),
    ("2024-02-01 8:00 PM", "2024-02-01"), ("13/02/2024", "2024-02-13"), ("02/13/24", "2024-02-13"),
    ("03/04/2024", "2024-03-04"), ("25:00 2024-02-01", None), ("May", None), ("1234 Main St 5", None)]


def test_layouts(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "t string")
    got = [r.d for r in df.select(force_date(F.col("t")).cast("string").alias("d")).collect()]
    assert dict(zip([t for t, _ in CASES], got)) == dict(CASES)


@pytest.mark.parametrize("day_first", [False, True])
def test_order_of_a_column(spark, day_first):
    days = ["2024-02-03", "2024-02-13", "2024-12-31", "2023-01-01", "1999-10-09"]
    fmt = "{2}/{1}/{0}" if day_first else "{1}/{2}/{0}"
    cells = [fmt.format(*d.split("-")) for d in days] + [None, "TBD", "2024-05-06"]
    df = spark.createDataFrame([(c, "03/04/2024") for c in cells], "`a b` string, other string")
    found = day_first_columns(df, ["a b", "other"])
    assert found == ({"a b"} if day_first else set())
    got = [r[0] for r in df.select(force_date(
        F.col("a b"), day_first="a b" in found).cast("string")).collect()]
    assert got == [*days, None, None, "2024-05-06"]
    assert day_first_columns(df, []) == set()
