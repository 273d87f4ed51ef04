import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidscope.functions.dates import force_date, last_week, this_week, today_in


def parse(spark, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    rows = df.select("i", force_date(F.col("v"), df.schema["v"].dataType).alias("d")).orderBy("i")
    return [r["d"] for r in rows.collect()]


def test_offset_keeps_local_date(spark):
    for tz in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", tz)
        assert parse(spark, ["2024-02-01T23:30:00-05:00"]) == [dt.date(2024, 2, 1)]  # Q8
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_mixed_layouts_per_row(spark):
    got = parse(spark, ["2024-02-01", "02/05/2024", "Feb 7, 2024", "bad", None])  # Q9
    assert got == [dt.date(2024, 2, 1), dt.date(2024, 2, 5), dt.date(2024, 2, 7), None, None]


def test_guards(spark):
    got = parse(spark, ["2024-02-01 garbage", "20240201", "2024-02", "2024", " 2024-02-03 ",
                        "2/5/2024 10:30 AM", "February 9, 2024", "2024-02-30"])  # Q26
    assert got == [None, dt.date(2024, 2, 1), dt.date(2024, 2, 1), dt.date(2024, 1, 1),
                   dt.date(2024, 2, 3), dt.date(2024, 2, 5), dt.date(2024, 2, 9), None]


def test_integer_dates(spark):
    assert parse(spark, [20240201, 12345], "bigint") == [dt.date(2024, 2, 1), None]  # Q10


def test_idempotent(spark):
    df = spark.createDataFrame([("02/05/2024",), ("x",)], "v string")
    once = df.select(force_date(F.col("v"), T.StringType()).alias("d"))
    twice = once.select(force_date(F.col("d"), T.DateType()).alias("d"))
    assert once.collect() == twice.collect()


def test_weeks():
    wed = dt.date(1998, 2, 4)
    assert this_week(wed) == (dt.date(1998, 2, 2), dt.date(1998, 2, 8))
    assert last_week(wed) == (dt.date(1998, 1, 26), dt.date(1998, 2, 1))
    sun, mon = dt.date(1998, 2, 8), dt.date(1998, 2, 9)
    assert this_week(sun) == (dt.date(1998, 2, 2), dt.date(1998, 2, 8))
    assert this_week(mon) == (dt.date(1998, 2, 9), dt.date(1998, 2, 15))


def test_today_in_zone():
    now = dt.datetime(2024, 3, 1, 23, 30, tzinfo=dt.timezone.utc)
    assert today_in("Africa/Lagos", now) == dt.date(2024, 3, 2)
    assert today_in("UTC", now) == dt.date(2024, 3, 1)


from hypothesis import HealthCheck, given, settings, strategies as st  # noqa: E402

PIECES = ["2024", "-", "02", "-01", "T10:00", " ", "　", "/", "05", "/2024", "Feb", " 7,", " 2024",
          "x", "20240201", "\t", "é", ",", "13", "1998-02-04"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=5).map("".join), min_size=1, max_size=40))
def test_prechecked_parse_equals_plain(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    plain = df.select(force_date(F.col("v"), T.StringType()).alias("d")).collect()
    fast = df.select(force_date(F.col("v"), T.StringType(), mostly_not_dates=True).alias("d")).collect()
    assert plain == fast
