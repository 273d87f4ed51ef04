import datetime as dt
import io
import os
import tempfile
import zipfile

import pytest

from bidscope.sinks.exports import write_csv, write_sheets
from bidscope.sinks.workbooks import workbook_bytes, write_workbooks
from bidscope.sources.readers import UnsupportedFormat, load_dataset, read_csv
from bidscope.sources.workbooks import read_workbooks


def tmpdir():
    return tempfile.mkdtemp(prefix="bidscope-test-")


def test_csv_round_trip_keeps_text(spark):
    rows = [("a,b", 'say "hi"', "  padded  ", dt.date(2024, 2, 1), None),
            ("line\nbreak", "back\\slash", "x", None, "None")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d date, e string")
    path = os.path.join(tmpdir(), "out")
    assert write_csv(df, path, single_file=True) == 2
    back = read_csv(spark, path, schema="a string, b string, c string, d date, e string")
    got = sorted(back.collect(), key=lambda r: r["a"])
    assert got[0]["a"] == "a,b" and got[0]["b"] == 'say "hi"' and got[0]["c"] == "  padded  "
    assert got[1]["a"] == "line\nbreak" and got[1]["e"] is None  # NA token
    assert got[0]["d"] == dt.date(2024, 2, 1)


def test_csv_inference_and_na_tokens(spark):
    d = tmpdir()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("n,x,flag,t\n1,1.5,True,NA\n2,n/a,False,text\n")
    df = read_csv(spark, d)
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "flag": "boolean", "t": "string"}
    assert [r["t"] for r in df.orderBy("n").collect()] == [None, "text"]


def test_latin1_file_beside_utf8(spark):
    d = tmpdir()
    with open(os.path.join(d, "u.csv"), "wb") as f:
        f.write("name,city\nJosé,Zürich\n".encode("utf-8"))
    with open(os.path.join(d, "l.csv"), "wb") as f:
        f.write("name,city\nAnaïs,Köln\n".encode("latin-1"))
    got = sorted(r["name"] for r in read_csv(spark, d).collect())  # S2
    assert got == ["Anaïs", "José"]


def test_format_dispatch(spark):
    with pytest.raises(UnsupportedFormat):
        load_dataset(spark, "/tmp/sheet.xls")  # Q2
    with pytest.raises(UnsupportedFormat):
        load_dataset(spark, "/tmp/sheet.txt")


def test_workbook_round_trip(spark):
    rows = [("A-1", 3, 1.5, dt.date(2024, 2, 1), True, "x<&>y"),
            ("A-2", None, None, None, False, None)]
    df = spark.createDataFrame(rows, "id string, n long, f double, d date, b boolean, s string")
    path = os.path.join(tmpdir(), "wb")
    manifest = write_workbooks(df.coalesce(1), path, sheet_name="A very long sheet name for testing")
    assert sum(r for _, r in manifest) == 2
    back = read_workbooks(spark, path).orderBy("id").collect()
    assert back[0]["n"] == 3 and back[0]["f"] == 1.5 and back[0]["d"] == "2024-02-01"
    assert back[0]["b"] is True and back[0]["s"] == "x<&>y"
    assert back[1]["n"] is None and back[1]["s"] is None
    with zipfile.ZipFile(io.BytesIO(workbook_bytes(["a"], [(1,)], "x" * 40))) as z:
        assert 'name="' + "x" * 31 + '"' in z.read("xl/workbook.xml").decode()


def test_workbook_row_limit_splits(spark):
    df = spark.range(25).coalesce(1)
    manifest = write_workbooks(df, os.path.join(tmpdir(), "split"), rows_per_file=10)
    assert sorted(r for _, r in manifest) == [5, 10, 10]


def test_sheets(spark):
    df = spark.range(3)
    counts = write_sheets({"Filtered": df, "Summary": df.limit(1)}, tmpdir())
    assert counts == {"Filtered": 3, "Summary": 1}


def test_folder_dispatch(spark):
    d = tmpdir()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("x\n1\n")
    assert load_dataset(spark, d).count() == 1


def test_preview_is_head_in_scan_order(spark):
    from bidscope.operators.order import preview
    d = tmpdir()
    for part in range(3):
        with open(os.path.join(d, f"p{part}.csv"), "w") as f:
            f.write("k\n" + "".join(f"{part * 100 + i}\n" for i in range(30)))
    df = read_csv(spark, d, with_row_id=True, latin1_fallback=False)
    head = [r["_row"] for r in preview(df, 20).collect()]
    ordered = [r["_row"] for r in df.orderBy("_row").limit(20).collect()]
    assert head == ordered
