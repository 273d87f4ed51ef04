import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from bidscope.operators.profile import (candidate_columns, first_distinct_values,
                                        profile_counts, profile_document, sample_rows)


def brute_first_distinct(rows, ncols, n=10):
    out = {}
    for c in range(ncols):
        seen = []
        for r in sorted(rows, key=lambda r: r[0]):
            v = r[c + 1]
            if v is not None and str(v) not in seen:
                seen.append(str(v))
        out[c] = seen[:n]
    return out


def spark_first_distinct(spark, rows, partitions):
    df = spark.createDataFrame(rows, "k long, a string, b long").repartition(partitions)
    got = first_distinct_values(df, 10, order_by="k").collect()
    out = {0: [], 1: []}
    for r in sorted(got, key=lambda r: (r["name"], r["example_rank"])):
        if r["name"] != "k":
            out[{"a": 0, "b": 1}[r["name"]]].append(r["example_value"])
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y", "z", None, "w", "v"] + list("abcdefghij")),
                          st.one_of(st.none(), st.integers(0, 30))), min_size=1, max_size=60),
       st.sampled_from([1, 3, 8]))
def test_first_distinct_matches_brute_force(spark, data, partitions):
    rows = [(i * 7919 % 1000003, a, b) for i, (a, b) in enumerate(data)]
    assert spark_first_distinct(spark, rows, partitions) == brute_first_distinct(rows, 2)


def test_scan_order_examples(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "b", None, "c"]], "v string").coalesce(1)
    got = [r["example_value"] for r in first_distinct_values(df).orderBy("example_rank").collect()]
    assert got == ["b", "a", "c"]


def test_profile_counts_and_document(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (2, None, 1.5), (None, "a", None)],
                               "i long, s string, d double")
    rows = {r["name"]: r for r in profile_counts(df).collect()}
    assert rows["i"]["non_null_count"] == 2 and rows["s"]["non_null_count"] == 2
    assert rows["d"]["non_null_count"] == 1  # NaN counts as missing
    assert rows["i"]["row_count"] == 3 and rows["i"]["column_count"] == 3
    doc = json.loads(profile_document(df).first()["profile"])
    assert doc["row_count"] == 3 and [c["name"] for c in doc["columns"]] == ["i", "s", "d"]
    assert doc["columns"][1]["example_values"] == ["a"]


def test_candidates(spark):
    df = spark.createDataFrame([("2024-01-02", "SDVOSB set-aside", "541512", "Solicitation"),
                                ("02/03/2024", "women owned", "541511", "RFI"),
                                ("x", "none", "12", "award")],
                               "d string, s string, n string, t string")
    roles = {r["name"]: r["candidate_role"] for r in candidate_columns(df).collect()}
    assert roles == {"d": "date", "s": "set_aside", "n": "naics", "t": "type"}


def test_sample_is_repeatable(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 3)
    a = sorted(r["id"] for r in sample_rows(df, n=7, seed=3).collect())
    b = sorted(r["id"] for r in sample_rows(df.repartition(5), n=7, seed=3).collect())
    assert a == b and len(a) == 7
    assert 0 < sample_rows(df, fraction=0.1, seed=1).count() < 300


def test_best_candidates(spark):
    from bidscope.operators.profile import best_candidates
    df = spark.createDataFrame([("2024-01-02", "x", "2024-01-05"), ("02/03/2024", "y", None),
                                ("bad", "z", "2024-02-01")], "a string, b string, c string")
    ranked = best_candidates(candidate_columns(df)).where("role = 'date'").orderBy("rank").collect()
    assert [r["name"] for r in ranked] == ["c", "a"]  # 2/2 beats 2/3


def test_scan_order_key_matches_row_ids(spark, tmp_path):
    rows = [(f"v{(i * 37) % 23}", i % 5 if i % 4 else None) for i in range(300)]
    spark.createDataFrame(rows, "a string, b long").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    implicit = sorted(map(tuple, first_distinct_values(df).collect()))
    explicit = first_distinct_values(df.withColumn("_row", F.monotonically_increasing_id()),
                                     order_by="_row").where("name != '_row'")
    assert implicit == sorted(map(tuple, explicit.collect()))


def test_profile_reads_once_and_agrees(spark, tmp_path):
    from bidscope.operators.profile import profile
    rows = [(i, f"t{i % 13}" if i % 5 else None, float(i % 4) if i % 6 else float("nan"))
            for i in range(400)]
    spark.createDataFrame(rows, "k long, t string, x double").repartition(4) \
        .write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    got = {r["name"]: r for r in profile(df, order_by="k").collect()}
    counts = {r["name"]: r["non_null_count"] for r in profile_counts(df).collect()}
    ex = {}
    for r in first_distinct_values(df, order_by="k").collect():
        ex.setdefault(r["name"], []).append((r["example_rank"], r["example_value"]))
    for name, r in got.items():
        assert r["non_null_count"] == counts[name] and r["row_count"] == 400
        assert r["example_values"] == [v for _, v in sorted(ex[name])]
    plan = profile(df, order_by="k")
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1
