import datetime as dt

import pytest

from bidscope.fixtures import notices
from bidscope.plans.plan import Plan, PlanError, validate
from bidscope.plans.run import run_plan, run_saved_plans

from conftest import SF001

FLAGSHIP = {"columns": {}, "filters": [
    {"column": "Normalized Set Aside", "operator": "in", "value": ["SDVOSB"]},
    {"column": "Due Date", "operator": "next_days", "value": 14}]}


def test_decode_defaults():
    p = Plan.from_json("not json")
    assert p.filters == [] and p.columns == {}  # L1
    assert Plan.from_json('{"columns": null, "filters": null}').columns == {}  # Q22
    with pytest.raises(PlanError):
        Plan.from_json("[1, 2]")  # Q23
    assert Plan.from_json(Plan.from_dict(FLAGSHIP).to_json()).filters == FLAGSHIP["filters"]


def test_validate():
    bad = Plan.from_dict({"filters": [{"column": "Budget", "operator": "gt"},
                                      {"column": "Normalized Set Aside", "operator": "in",
                                       "value": ["SDVOSBX"]}],
                          "set_aside_patterns": {"X": "abc"}})
    problems = validate(bad)
    assert len(problems) == 4
    with pytest.raises(PlanError):
        validate(bad, strict=True)
    assert validate(Plan.from_dict(FLAGSHIP)) == []


def test_flagship_counts(spark):
    out = run_plan(notices(spark, SF001), FLAGSHIP, today="1998-02-04")
    assert out.count() == 2  # FIXTURES expected count at sf0.001


def test_final_count_and_order(spark):
    out = run_plan(notices(spark, SF001), {}, today="1998-02-04",
                   tie_break=["Solicitation Number"])
    rows = out.collect()
    assert len(rows) == 764
    rank = {"Solicitation": 0, "Presolicitation": 1, "Sources Sought": 2, "Other": 3}
    keys = [(rank.get(r["Opportunity Type"], 9), r["Solicitation Date"] or dt.date.max,
             r["Solicitation Number"]) for r in rows]
    assert keys == sorted(keys)


def test_no_set_aside_request(spark):
    plan = {"filters": [{"column": "Normalized Set Aside", "operator": "in",
                         "value": ["NO SET-ASIDE"]}]}
    n = notices(spark, SF001)
    assert run_plan(n, plan, today="1998-02-04").count() == 375  # Q12 decision
    assert run_plan(n, plan, today="1998-02-04", parity=True).count() == 0


def test_saved_plans_equal_single_runs(spark):
    n = notices(spark, SF001)
    plans = {"a": FLAGSHIP,
             "b": {"filters": [{"column": "Due Date", "operator": "this_week"}]},
             "c": {"set_aside_patterns": {"8(A)": ["8(a)"]},
                   "filters": [{"column": "Normalized Set Aside", "operator": "in",
                                "value": ["8(A)"]}]}}
    combined = run_saved_plans(n, plans, today="1998-02-04")
    for pid, plan in plans.items():
        got = sorted(tuple(r)[1:] for r in combined.where(f"plan_id = '{pid}'").collect())
        want = sorted(tuple(r) for r in run_plan(n, plan, today="1998-02-04", sort=False).collect())
        assert got == want, pid


def test_saved_plans_read_the_table_once(spark, tmp_path):
    from bidscope.plans.run import run_saved_plans
    path = str(tmp_path / "sheet")
    notices(spark, SF001).write.parquet(path)
    plans = {"a": FLAGSHIP,
             "b": {"set_aside_patterns": {"8(A)": ["8(a)"]},
                   "filters": [{"column": "Normalized Set Aside", "operator": "in", "value": ["8(A)"]}]},
             "c": {"columns": {"title": "UiLink"},
                   "filters": [{"column": "Title", "operator": "contains", "value": "opp/1"}]}}
    out = run_saved_plans(spark.read.parquet(path), plans, today="1998-02-04")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1 and "Exchange" not in text
    got = {pid: n for pid, n in out.groupBy("plan_id").count().collect()}
    for pid, plan in plans.items():
        assert got.get(pid, 0) == run_plan(spark.read.parquet(path), plan,
                                           today="1998-02-04").count(), pid


def test_ties_keep_scan_order_with_row_ids(spark, tmp_path):
    from bidscope.sources.readers import read_csv
    lines = ["NoticeId,Type,PostedDate,TypeOfSetAsideDescription"]
    lines += [f"N{i:03d},Solicitation,1998-02-01,SDVOSB" for i in range(40, 0, -1)]
    (tmp_path / "s.csv").write_text("\n".join(lines) + "\n")
    df = read_csv(spark, str(tmp_path / "s.csv"), with_row_id=True, latin1_fallback=False)
    got = [r["Solicitation Number"] for r in run_plan(df, {}, today="1998-02-04").collect()]
    assert got == [f"N{i:03d}" for i in range(40, 0, -1)]  # all tie: file order kept
    assert "_row" not in run_plan(df, {}, today="1998-02-04").columns


def test_saved_plans_sorted(spark):
    from bidscope.plans.run import run_saved_plans
    plans = {"b": FLAGSHIP, "a": {"filters": [{"column": "Due Date", "operator": "this_week"}]}}
    rows = run_saved_plans(notices(spark, SF001), plans, today="1998-02-04",
                           tie_break=["Solicitation Number"], sort=True).collect()
    ids = [r["plan_id"] for r in rows]
    assert ids == sorted(ids) and set(ids) == {"a", "b"}
