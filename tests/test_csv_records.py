"""Quoted CSV, cut in parallel, against Python's and pandas' own readers."""

import io
import random

import pandas as pd
import pytest

from bidscope.sources import readers

AWKWARD = ['5" pipe', "", "a,b", 'say ""hi""', "two\nlines", "x\r\ny", "\n\n", " pad ", "Größe", '"', "'"]


def quoted(value, rng):
    if any(c in value for c in ',"\n\r') and value != '5" pipe' or rng.random() < 0.3:
        return '"' + value.replace('"', '""') + '"'
    return value


def sheet(rng, n, header):
    rows = [header]
    for i in range(n):
        rows.append(",".join([str(i)] + [quoted(rng.choice(AWKWARD), rng)
                                         for _ in range(header.count(",") or 1)]))
        if rng.random() < 0.1:
            rows.append(rng.choice(["", ""]))
    return "\n\n" * rng.randint(0, 2) + "\n".join(rows) + rng.choice(["", "\n"])


def as_pandas(raw, encoding="utf-8"):
    out = pd.read_csv(io.BytesIO(raw), encoding=encoding, dtype=str, keep_default_na=False,
                      na_values=[""])
    return [tuple(None if pd.isna(v) else v for v in row) for row in out.itertuples(index=False)]


def split_size(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.fixture(autouse=True)
def whole_files(spark):
    yield
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


@pytest.mark.parametrize("size,n", [(7, 9), (64, 40), (1 << 20, 60)])
def test_records_equal_a_csv_reader_at_any_split(spark, tmp_path, size, n):
    rng = random.Random(size)
    want = []
    for k in range(2):
        raw = sheet(rng, n, 'Id,A,"B ""x"" B"').encode()
        (tmp_path / f"f{k}.csv").write_bytes(raw)
        want += as_pandas(raw)
    split_size(spark, size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    got = readers.read_csv(spark, str(tmp_path), na_tokens=("",), infer=False)
    assert got.columns == ["Id", "A", 'B "x" B']
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("size", [16, 1 << 20])
@pytest.mark.parametrize("body", [
    '\n\r\n\nTitle,Agency\r\nx,DoD\r\n',
    '"Ti\ntle",Agency\n"a\nb",DoD\n',
    '\n"Ti\n\n,""tle""",Agency\n1,"a\n\n\n"\n\n2,b\n',
    'A,B\n"1\n2\n3\n4\n5\n6\n7\n8\n9\n10\n11\n12\n13\n14\n15",y\nz,"w"\n'])
def test_headers_and_blank_lines(spark, tmp_path, body, size):
    (tmp_path / "x.csv").write_bytes(body.encode())
    split_size(spark, size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    got = readers.read_csv(spark, str(tmp_path / "x.csv"), infer=False, na_tokens=("",))
    want = pd.read_csv(io.BytesIO(body.encode()), dtype=str)
    assert got.columns == list(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(as_pandas(body.encode()))


def test_encodings_and_headers_by_their_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Größe,Id\nklein,1\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("Gräße,Id\n\"g\nroß\",2\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("Id,Größe\n3,ö\n".encode())
    (tmp_path / "readme.txt").write_text("hi\nthere\n")
    got = readers.load_dataset(spark, str(tmp_path))
    assert set(got.columns) == {"Größe", "Gräße", "Id"}
    assert {(r["Id"], r["Größe"], r["Gräße"]) for r in got.collect()} == {
        (1, "klein", None), (2, None, "g\nroß"), (3, "ö", None)}
    assert dict(got.dtypes)["Id"] == "bigint"


def test_stray_files_and_suffix_case(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("A,B\n1,x\n")
    (tmp_path / "readme.txt").write_text("hi\nthere\n")
    got = readers.load_dataset(spark, str(tmp_path))
    assert got.columns == ["A", "B"] and [tuple(r) for r in got.collect()] == [(1, "x")]


def test_given_schema_and_lines_that_hold_newlines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,day\n1,2024-01-02\n2,"2024-\n"\n')
    got = readers.read_csv(spark, str(tmp_path), schema="k int, day date")
    assert [tuple(map(str, r)) for r in got.collect()] == [("1", "2024-01-02"), ("2", "None")]
    assert readers.read_csv(spark, str(tmp_path), schema="k int, day string").count() == 2


def test_many_headers_make_one_plan_branch(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"{k}.csv").write_text(f"Id,c{k}\n{k},v{k}\n")
    got = readers.read_csv(spark, str(tmp_path), infer=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and len(got.columns) == 13
    assert {(r.Id, r.c3) for r in got.collect()} == {
        (str(k), "v3" if k == 3 else None) for k in range(12)}


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.csv").write_text("\n\n")
    assert readers.read_csv(spark, str(tmp_path)).count() == 0
    (tmp_path / "c.csv").write_text("A,B\n")
    got = readers.read_csv(spark, str(tmp_path))
    assert got.columns == ["A", "B"] and got.count() == 0


def test_files_are_cut_once_however_often_records_are_read(spark, tmp_path):
    """A header of two lines and fields across blocks: headers, whole records
    and joined ones all come from what one pass has cut."""
    from bidscope.sources import csv_records
    (tmp_path / "a.csv").write_bytes(b'"x\ny",z\n' + b"".join(
        b'"%d\n\nq",%d\n' % (i, i) for i in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        lines = csv_records.raw_lines(spark, str(tmp_path))
        facts = csv_records.block_facts(lines).cache()
        found = csv_records.records(lines, facts, True)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan
        rows = found.orderBy("block", "row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.header for r in rows].count(True) == 1
    assert sorted(bytes(r.record) for r in rows) == sorted(
        [b'"x\ny",z', *(b'"%d\n\nq",%d' % (i, i) for i in range(400))])


def test_types_by_digits_without_a_cast_per_value(spark, tmp_path):
    """Whole numbers at the edges of 64 bits; counting casts no value, as a
    cast that fails costs an exception."""
    fits = ["9223372036854775807", "-9223372036854775808", " +0000000000000000000000012 ", "-0",
            "\t09223372036854775807"]
    beyond = ["9223372036854775808", "-9223372036854775809", "+99999999999999999999", "1" * 40]
    df = spark.createDataFrame([(v,) for v in fits + beyond], "v string")
    got = df.select("v", readers._beyond_64_bits(df.v).alias("b"),
                    df.v.try_cast("bigint").isNull().alias("want")).collect()
    assert [r.b for r in got] == [r.want for r in got] == [False] * 5 + [True] * 4
    counted = df.agg(*readers._fit_counts(["v"]))
    assert "cast" not in counted._jdf.queryExecution().optimizedPlan().toString()
    for name, values, kind in (("f", fits, "bigint"), ("b", ["1", *beyond], "string"),
                               ("m", ["x", *beyond], "string"), ("d", ["1.5", *beyond], "double")):
        path = tmp_path / f"{name}.csv"
        path.write_text("k,v\n" + "".join(f"a,{v}\n" for v in values))
        assert dict(readers.read_csv(spark, str(path)).dtypes)["v"] == kind
