"""Regressions of date layouts, literals, ingest and package shipping."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidscope.functions.dates import force_date, last_week, this_week
from bidscope.operators.filters import apply_filters
from bidscope.plans.ingest import ingest, run_plan_ingested

LAYOUTS = {
    "01-Feb-2024": "2024-02-01", "1 Feb 2024": "2024-02-01", "Feb 07, 2024 05:00 PM": "2024-02-07",
    "Feb 7, 2024 5:00 pm EST": "2024-02-07", "2024/02/01": "2024-02-01", "2.5.24": "2024-02-05",
    "Thursday, February 1, 2024": "2024-02-01", "20240201T120000": "2024-02-01",
    "13/02/2024": "2024-02-13", "Sept 5, 2024": "2024-09-05", "2/5/71": "1971-02-05",
    "1st May 2024": "2024-05-01", "2024-02-01T23:30:00-05:00": "2024-02-01",
    "TBD": None, "2024-13-45": None, "Feb 30, 2024": None, "12D": None, "1.2.3.4": None,
    "10:30": None, "March": None, "": None, "room 5 May 2024 x": None}


@pytest.mark.parametrize("sparse", [False, True])
def test_date_layouts(spark, sparse):
    rows = spark.createDataFrame([(k,) for k in LAYOUTS], "v string")
    got = rows.select("v", force_date(F.col("v"), T.StringType(), sparse).cast("string").alias("d"))
    assert {r.v: r.d for r in got.collect()} == LAYOUTS


def test_weeks_written_out():
    import datetime as dt
    d = dt.date
    assert this_week(d(2024, 2, 4)) == (d(2024, 1, 29), d(2024, 2, 4))
    assert this_week(d(2024, 1, 1)) == (d(2024, 1, 1), d(2024, 1, 7))
    assert last_week(d(2021, 1, 3)) == (d(2020, 12, 21), d(2020, 12, 27))


def test_literals_that_are_no_integers(spark):  # Q16
    rows = spark.createDataFrame([(5,), (6,), (7,)], "n long")
    run = lambda op, v: sorted(r.n for r in apply_filters(
        rows, [{"column": "n", "operator": op, "value": v}]).collect())
    assert run("equals", 5.5) == [] and run("equals", "5.5") == [] and run("equals", 5.0) == [5]
    assert run("in", [6.9, "7", "x", None]) == [7]


def test_ingested_sources(spark, tmp_path):
    row = ("S1", "T", "A", "2024-01-05", "2024-03-01", "Solicitation", "Women-Owned", "Sources",
           "2024-02-10")
    sheet = spark.createDataFrame([row], "SolicitationNumber string, Title string, Agency string, "
                                  "PostedDate string, ResponseDeadLine string, Type string, "
                                  "TypeOfSetAsideDescription string, UiLink string, "
                                  "NoticeDate string")
    ingest(sheet, str(tmp_path / "t"))
    plan = {"columns": {"solicitation_date": "NoticeDate"}, "filters": [
        {"column": "Solicitation Date", "operator": "between",
         "value": ["2024-02-01", "2024-02-28"]}]}
    assert run_plan_ingested(spark, str(tmp_path / "t"), plan, today="2024-01-01").count() == 1


def test_tasks_import_the_package_from_another_folder(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from bidscope.session import build_session
        spark = build_session("local[1]", shuffle_partitions=1)
        def tasks(batches):
            import bidscope
            for b in batches:
                yield b.assign(path=bidscope.__file__)
        print("FROM", spark.range(1).mapInPandas(tasks, "id long, path string").first().path)
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert "FROM " in out.stdout, out.stderr[-2000:]


def put(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_csv", ".csv")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_folder_columns_go_by_name(spark, tmp_path):
    from bidscope.sources.readers import load_dataset
    put(tmp_path, a_csv="Title,Agency\nt1,a1\n", b_csv="Agency,Title,Type\na2,t2,x\n",
        sub__c_csv="Title\nt3\n", l_csv="Title,Agency\nt4,Köln\n".encode("latin-1"))
    got = {(r.Title, r.Agency, r.Type) for r in load_dataset(spark, str(tmp_path)).collect()}
    assert got == {("t1", "a1", None), ("t2", "a2", "x"), ("t3", None, None), ("t4", "Köln", None)}


def test_mixed_folder_is_refused(spark, tmp_path):
    from bidscope.sources.readers import UnsupportedFormat, load_dataset
    put(tmp_path, a_csv="x\n1\n")
    (tmp_path / "b.json").write_text('{"x": 1}\n')
    with pytest.raises(UnsupportedFormat):
        load_dataset(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, str(tmp_path / "nothing"))


def test_inference_keeps_identifiers(spark, tmp_path):
    from bidscope.sources.readers import read_csv
    put(tmp_path, a_csv="id,long,flag,f,Title,Title\n12D,12345678901234567890123,true,1e3,a,b\n"
                        "70F,1,FALSE,.5,c,d\n")
    df = read_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"id": "string", "long": "string", "flag": "boolean", "f": "double",
                               "Title": "string", "Title.1": "string"}
    assert sorted((r.id, r.long, r.flag, r.f) for r in df.collect()) == [
        ("12D", "12345678901234567890123", True, 1000.0), ("70F", "1", False, 0.5)]


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_examples_of_unsorted_rows(spark, partitions):
    import random

    from bidscope.operators.profile import first_distinct_values
    rng = random.Random(partitions)
    rows = [(k, rng.choice("abc"), f"v{rng.randrange(40)}", None if k % 3 else f"w{k % 50}")
            for k in rng.sample(range(100_000), 4000)]
    df = spark.createDataFrame(rows, "k long, few string, some string, gaps string").repartition(
        partitions)
    assert "Sort " not in first_distinct_values(df, 10, "k")._jdf.queryExecution().optimizedPlan() \
        .toString().split("MapInArrow")[-1]
    got = {}
    for r in first_distinct_values(df, 10, "k").collect():
        got.setdefault(r["name"], {})[r["example_rank"]] = r["example_value"]
    for i, name in enumerate(df.columns):
        seen = []
        for row in sorted(rows):
            if row[i] is not None and str(row[i]) not in seen and len(seen) < 10:
                seen.append(str(row[i]))
        assert [got[name][j + 1] for j in range(len(seen))] == seen
