import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidscope.llm import ann

from conftest import SF001

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("key", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("code", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, v, "k", "s", "c") for i, v in rows], SCHEMA)


def brute(rows, is_query, k=5):
    """Exact neighbours: {query: [(vec_id, score)]}."""
    by = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None for x in v):
            continue
        x = np.array(v, np.float32).astype(np.float64)
        if np.isfinite(x).all() and x.any() and (i not in by or tuple(v) < tuple(by[i])):
            by[i] = x
    out = {}
    for q, a in by.items():
        if is_query(q):
            near = [(-float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), i)
                    for i, b in by.items() if i != q and len(b) == len(a)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in want[q]} & {r.vec_id for r in got if r.query_id == q})
              for q in want)
    return hit / max(1, sum(len(x) for x in want.values()))


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_against_brute_force(spark, clustered):
    rng = np.random.default_rng(5)
    if clustered:
        centre = rng.standard_normal((20, 24))
        x = centre[rng.integers(0, 20, 1500)] + rng.standard_normal((1500, 24)) * 0.2
    else:
        x = rng.standard_normal((1500, 24))
    rows = [(i, [float(y) for y in v.astype(np.float32)]) for i, v in enumerate(x)]
    got = ann.search(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, lambda i: i % 50 == 0)
    assert recall(got, want) >= 0.9
    for r in got:
        a, b = (np.array(rows[i][1]) for i in (r.query_id, r.vec_id))
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    for q in want:
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert mine == sorted(mine, key=lambda m: (-m[1], m[2]))


def test_awkward_rows(spark):
    same = [0.5, 0.25, -1.0]
    rows = [(i, same) for i in range(0, 240)]
    rows += [(300, [1.0, 2.0, 3.0]), (300, [1.0, 2.0, 3.0]), (350, [0.0, 0.0, 0.0]), (400, None),
             (450, []), (500, [1.0, None, 2.0]), (550, [float("nan"), 1.0, 1.0]), (None, same),
             (600, [1.0, 1.0]), (601, [2.0, 2.0]), (650, [1.0, 2.0, float("inf")]),
             (700, [-0.0, 1.0, 0.0]), (701, [0.0, 1.0, 0.0])]
    got = ann.search(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, lambda i: i % 50 == 0)
    assert {r.query_id for r in got} == {q for q, n in want.items() if n}
    for q, near in want.items():
        mine = [(r.vec_id, r.score) for r in sorted(
            (r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert [m[0] for m in mine] == [n[0] for n in near]
        assert [m[1] for m in mine] == pytest.approx([n[1] for n in near])


def test_empty_and_tiny(spark):
    assert ann.search(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(table(spark, [(50, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]
    got = ann.search(docs, F.col("vec_id") % 50 == 0).collect()
    assert recall(got, brute(rows, lambda i: i % 50 == 0)) >= 0.9
