import datetime as dt

import pytest

from bidscope.operators.filters import FilterError, apply_filters
from bidscope.operators.project import ColumnMapError, resolve_columns
from bidscope.plans.run import run_plan

TODAY = dt.date(1998, 2, 4)


@pytest.fixture(scope="module")
def table(spark):
    rows = [("A-1", "Engine 8(a) parts", "NAVY", dt.date(1998, 2, 1), dt.date(1998, 2, 4)),
            ("A-2", "Generator", "ARMY", dt.date(1998, 1, 20), dt.date(1998, 2, 10)),
            ("A-3", None, "NAVY", None, None),
            ("A-4", "generator set", "GSA", dt.date(1998, 2, 3), dt.date(1998, 1, 29))]
    return spark.createDataFrame(rows, "`Solicitation Number` string, Title string, Agency string, "
                                       "`Solicitation Date` date, `Due Date` date")


def ids(df):
    return sorted(r["Solicitation Number"] for r in df.collect())


def test_contains_is_literal_and_null_safe(table):
    assert ids(apply_filters(table, [{"column": "Title", "operator": "contains",
                                      "value": "8(a"}], TODAY)) == ["A-1"]  # Q13
    assert ids(apply_filters(table, [{"column": "Title", "operator": "contains",
                                      "value": "GENERATOR"}], TODAY)) == ["A-2", "A-4"]
    assert ids(apply_filters(table, [{"column": "Title", "operator": "contains",
                                      "value": "na"}], TODAY)) == []


def test_regex_contains_validated(table):
    with pytest.raises(FilterError):
        apply_filters(table, [{"column": "Title", "operator": "contains", "value": "8(a"}],
                      TODAY, regex_contains=True)


def test_lenient_and_strict(table):
    notes = []
    out = apply_filters(table, [{"column": "Budget", "operator": "equals", "value": 1},
                                {"column": "Title", "operator": "bigger", "value": 1}],
                        TODAY, notes=notes)
    assert ids(out) == ["A-1", "A-2", "A-3", "A-4"] and len(notes) == 2  # Q14
    with pytest.raises(FilterError):
        apply_filters(table, [{"column": "Budget", "operator": "equals", "value": 1}],
                      TODAY, strict=True)


def test_date_literals_cast(table):
    eq = [{"column": "Due Date", "operator": "equals", "value": "1998-02-10"}]  # Q15
    assert ids(apply_filters(table, eq, TODAY)) == ["A-2"]
    isin = [{"column": "Agency", "operator": "in", "value": "NAVY"}]  # Q19 scalar
    assert ids(apply_filters(table, isin, TODAY)) == ["A-1", "A-3"]


def test_between_bounds(table):
    bad = [{"column": "Due Date", "operator": "between", "value": ["bad", "1998-02-05"]}]
    assert ids(apply_filters(table, bad, TODAY)) == []  # Q17
    notes = []
    missing = [{"column": "Due Date", "operator": "between", "value": ["1998-02-01"]}]
    assert len(ids(apply_filters(table, missing, TODAY, notes=notes))) == 4 and notes
    ok = [{"column": "Solicitation Date", "operator": "between", "value": ["02/01/1998", "1998-02-03"]}]
    assert ids(apply_filters(table, ok, TODAY)) == ["A-1", "A-4"]


def test_calendar_operators(table):
    def run(op, value=None):
        return ids(apply_filters(table, [{"column": "Due Date", "operator": op, "value": value}],
                                 TODAY))
    assert run("today") == ["A-1"]
    assert run("next_days", 6) == ["A-1", "A-2"]
    assert run("next_days", "5") == ["A-1"]
    assert run("this_week") == ["A-1"]
    assert run("last_week") == ["A-4"]
    assert run("last_7_days") == ["A-1", "A-4"]  # eight calendar days
    assert run("tomorrow") == [] and run("yesterday") == []


def test_range_on_text_column_is_an_error(table):
    with pytest.raises(FilterError):  # Q18
        apply_filters(table, [{"column": "Title", "operator": "today"}], TODAY)


def test_conjunction_is_order_independent(table):
    fs = [{"column": "Agency", "operator": "in", "value": ["NAVY", "ARMY"]},
          {"column": "Due Date", "operator": "next_days", "value": 30}]
    assert ids(apply_filters(table, fs, TODAY)) == ids(apply_filters(table, fs[::-1], TODAY))


def test_text_dates_recoerced(spark):
    df = spark.createDataFrame([("x", "02/04/1998"), ("y", "junk")],
                               "`Solicitation Number` string, `Due Date` string")
    out = apply_filters(df, [{"column": "Due Date", "operator": "today"}], TODAY)
    assert ids(out) == ["x"]  # F14


def test_date_allow_list():
    with pytest.raises(ColumnMapError):  # P4
        resolve_columns(["ArchiveDate"], {"solicitation_date": "ArchiveDate"})
    r = resolve_columns(["NoticeID", "UiLink", "UIlink", "DueDate"], {})
    assert r["solicitation_number"] == "NoticeID" and r["uilink"] == "UiLink"
    assert r["due_date"] == "DueDate" and r["title"] is None


def test_case_sensitive_link_columns(spark):
    df = spark.createDataFrame([("a", "l1", "l2", "SDVOSB")],
                               "NoticeId string, UiLink string, UIlink string, "
                               "TypeOfSetAsideDescription string")
    out = run_plan(df, {}, today=TODAY)
    assert out.first()["UiLink"] == "l1"


def test_missing_set_aside_column_empties_result(spark):
    df = spark.createDataFrame([("a", "Solicitation")], "NoticeId string, Type string")
    notes = []
    assert run_plan(df, {}, today=TODAY, notes=notes).count() == 0  # Q11
    assert any("set-aside" in n for n in notes)


def test_plan_column_missing_from_sheet_drops_target(spark):
    df = spark.createDataFrame([("a", "t", "SDVOSB")],
                               "NoticeId string, Title string, TypeOfSetAsideDescription string")
    out = run_plan(df, {"columns": {"title": "Headline"}}, today=TODAY)  # Q21
    assert "Title" not in out.columns


def test_output_columns(spark):
    df = spark.createDataFrame([("a", "t", "Solicitation", "2024-01-02", "SDVOSB", "x")],
                               "NoticeId string, Title string, Type string, PostedDate string, "
                               "TypeOfSetAsideDescription string, Extra string")
    out = run_plan(df, {"output_columns": ["NoticeId", "Title", "Type", "PostedDate", "Extra"]},
                   today=TODAY)
    assert out.columns == ["Solicitation Number", "Title", "Opportunity Type",
                           "Solicitation Date", "Extra"]
    assert out.first()["Extra"] == "x"


def test_case_colliding_names_in_case_insensitive_session(spark):
    spark.conf.set("spark.sql.caseSensitive", "false")
    try:
        df = spark.createDataFrame([("a", "l2", "l1", "SDVOSB")],
                                   "NoticeId string, UIlink string, UiLink string, "
                                   "TypeOfSetAsideDescription string")
        out = run_plan(df, {}, today=TODAY).collect()
        assert out[0]["UiLink"] == "l1"  # the candidate list prefers UiLink
    finally:
        spark.conf.set("spark.sql.caseSensitive", "true")
