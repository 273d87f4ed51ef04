import datetime as dt
import os
import tempfile

from bidscope.fixtures import notices
from bidscope.operators.audit import audit_view, clear_audit, log_event, read_audit
from bidscope.operators.order import top_n
from bidscope.plans.run import run_plan, stage
from bidscope.plans.plan import Plan
from bidscope.streaming.plans import start_plan_stream, stream_plan

from conftest import SF001

FLAGSHIP = {"filters": [
    {"column": "Normalized Set Aside", "operator": "in", "value": ["SDVOSB"]},
    {"column": "Due Date", "operator": "next_days", "value": 14}]}


def test_audit_log(spark):
    path = os.path.join(tempfile.mkdtemp(), "audit")
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0, 123456)
    log_event(spark, path, "run_plan", "ok", "rows=2", {"rows": 2}, role="admin", at=t0)
    log_event(spark, path, "run_plan", "empty", at=t0 + dt.timedelta(days=1))
    view = audit_view(spark, path).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in view] == ["2024-01-01 10:00:00", "2024-01-02 10:00:00"]
    assert view[0]["extra"] == {"rows": "2"}
    clear_audit(spark, path, before=t0 + dt.timedelta(hours=1))
    assert read_audit(spark, path).count() == 1
    clear_audit(spark, path)
    assert read_audit(spark, path).count() == 0


def test_stream_matches_batch(spark):
    src = os.path.join(tempfile.mkdtemp(), "src")
    batch = notices(spark, SF001)
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    want = sorted(tuple(r) for r in run_plan(batch, FLAGSHIP, today="1998-02-04",
                                             sort=False).collect())
    q = (stream_plan(stream, FLAGSHIP, today="1998-02-04").writeStream.format("memory")
         .queryName("flagship_stream").start())
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM flagship_stream").collect())
    assert got == want and len(got) == 2
    sink, ckpt = (os.path.join(tempfile.mkdtemp(), x) for x in ("sink", "ckpt"))
    q = start_plan_stream(stream, FLAGSHIP, sink, ckpt, today="1998-02-04", available_now=True)
    q.awaitTermination()
    got2 = sorted(tuple(r) for r in spark.read.parquet(sink).drop("batch").collect())
    assert got2 == want


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark):
    df = run_plan(notices(spark, SF001), FLAGSHIP, today="1998-02-04")
    text = plan_text(df)
    assert "PythonUDF" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    top = top_n(stage(notices(spark, SF001), Plan()), 50, ["Solicitation Number"])
    assert "TakeOrderedAndProject" in plan_text(top)


def test_typed_dates_push_down(spark):
    path = os.path.join(tempfile.mkdtemp(), "typed")
    spark.createDataFrame([("a", dt.date(1998, 2, 5), "SDVOSB")],
                          "NoticeId string, DueDate date, TypeOfSetAsideDescription string"
                          ).write.parquet(path)
    df = run_plan(spark.read.parquet(path), {"filters": [
        {"column": "Due Date", "operator": "next_days", "value": 14}]}, today="1998-02-04")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(DueDate), GreaterThanOrEqual(DueDate" in text
    assert df.count() == 1


def test_ingest_then_query_prunes_and_matches(spark):
    from bidscope.plans.ingest import ingest, run_plan_ingested, solicitation_months
    from bidscope.plans.plan import Plan
    path = os.path.join(tempfile.mkdtemp(), "ingested")
    n = notices(spark, SF001)
    assert ingest(n, path) == 1500
    plan = {"filters": [
        {"column": "Normalized Set Aside", "operator": "in", "value": ["SDVOSB", "WOSB"]},
        {"column": "Solicitation Date", "operator": "between", "value": ["1998-01-15", "1998-03-10"]}]}
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    got = run_plan_ingested(spark, path, plan, today="1998-02-04")
    want = run_plan(n, plan, today="1998-02-04")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(posted_month" in text
    assert "GreaterThanOrEqual(PostedDate,1998-01-15)" in text
    custom = dict(plan, set_aside_patterns={"8(A)": ["8(a)"]})
    got2 = run_plan_ingested(spark, path, custom, today="1998-02-04")
    assert got2.count() == run_plan(n, custom, today="1998-02-04").count()
    assert solicitation_months(Plan.from_dict(plan), dt.date(1998, 2, 4)) == ("1998-01", "1998-03")


def test_run_and_export_logs(spark):
    from bidscope.plans.jobs import run_and_export
    out = os.path.join(tempfile.mkdtemp(), "out")
    audit = os.path.join(tempfile.mkdtemp(), "audit")
    plan = dict(FLAGSHIP, summary_by=["NAICS"], sheets={"Summary": "By NAICS"},
                filters=FLAGSHIP["filters"] + [{"column": "Budget", "operator": "equals", "value": 1}])
    res = run_and_export(notices(spark, SF001), plan, out, audit_path=audit, today="1998-02-04")
    assert res["rows"] == 2 and res["status"] == "ok" and res["sheets"]["By NAICS"] >= 1
    ev = read_audit(spark, audit).first()
    assert ev["extra"]["rows"] == "2" and "Budget" in ev["extra"]["notes"]
    assert spark.read.option("header", True).csv(os.path.join(out, "Filtered")).count() == 2
