"""What rules keep, dealt to their plans; the index of what rows have."""

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bidscope.catalog import dates_as_text
from bidscope.fixtures import notices
from bidscope.operators.project import CANONICAL_ORDER
from bidscope.plans import plan_table
from bidscope.plans.plan_table import NAMES, _index, _rules, compile_plans, run_plan_table
from bidscope.plans.run import run_plan
from conftest import SF001

TODAY = "1998-02-04"


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def test_a_large_rule_is_dealt_by_many_tasks(spark, no_broadcast, monkeypatch):
    """Alike rows, a repeated plan id and one that is null, some rules alone."""
    for name, value in {"_CELL_ROWS": 5, "_CELL_PLANS": 4, "_DEALT_ROWS": 300}.items():
        monkeypatch.setattr(plan_table, name, value, raising=False)
    kept = [(7, f"t{i % 3}") for i in range(60)] + [(i, "own") for i in range(20, 30)] + [(99, "x")]
    ids = ["p1", "p1", None, *[f"q{i}" for i in range(97)]]
    plans = [(7, i) for i in ids] + [(i, f"r{i}") for i in range(20, 32)]
    out = plan_table._dealt(spark.createDataFrame(kept, "__rule long, Title string"),
                            spark.createDataFrame(plans, "rule long, plan_id string"))
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    want = Counter((i, t) for r, t in kept for q, i in plans if r == q)
    assert Counter((r.plan_id, r.Title) for r in rows) == want
    tasks = Counter(r.task for r in rows)
    assert len(tasks) > 8 and max(tasks.values()) < len(rows) / 4


def test_keys_that_no_row_has_are_not_indexed(spark):
    between = lambda *days: {"filters": [
        {"column": "Due Date", "operator": "between", "value": list(days)}]}
    plans = {"met": between("1998-02-03", "1998-02-05"), "far": between("2998-01-03", "2998-01-09"),
             "value": {"filters": [{"column": "Title", "operator": "in", "value": ["a", "b"]}]}}
    table = spark.createDataFrame([(k, json.dumps(v)) for k, v in plans.items()],
                                  "plan_id string, plan string")
    compiled = compile_plans(table, dt.date(1998, 2, 4)).withColumn("layout", F.lit(0))
    day = "date'1998-02-04'"
    seen = spark.range(1).selectExpr("0 as layout", *[
        f"{day if 'Date' in n else repr('a')} as `{n}`" for n in NAMES])
    keys = {r.key for r in _index(_rules(compiled)[0], seen).collect()}
    assert len(keys) == 2 and "a" in keys


def test_finish_and_ids_that_are_null_or_repeated(spark, no_broadcast):
    sheet = notices(spark, SF001)
    plan = {"filters": [{"column": "Due Date", "operator": "next_days", "value": 30}]}
    table = spark.createDataFrame([("a", json.dumps(plan)), ("a", json.dumps(plan)),
                                   (None, json.dumps(plan))], "plan_id string, plan string")
    out = run_plan_table(sheet, table, TODAY, finish=dates_as_text)
    assert dict(out.dtypes)["Due Date"] == "string"
    found = Counter(tuple(r) for r in out.select("plan_id", *CANONICAL_ORDER).collect())
    alone = dates_as_text(run_plan(sheet, plan, today=TODAY, sort=False)).select(*CANONICAL_ORDER)
    want = Counter(tuple(r) for r in alone.collect())
    own = {r[1:]: n for r, n in found.items() if r[0] == "a"}
    assert want and own == {r: 2 * n for r, n in want.items()}
    assert any(r[0] is None for r in found)
