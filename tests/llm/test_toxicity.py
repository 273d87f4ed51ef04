import random
import zlib

import pytest
from pyspark.sql import functions as F

from bidscope.llm import toxicity

from llm_rows import AWKWARD, LONG, documents

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=600):
    rng = random.Random(4)
    parts = ["ba", "lo", "mi", "ter", "sen", "ka", "du", "ri", "po", "ne"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        text = [word() for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["vexroth", "grimzod", "plaxug"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic), "x"))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = documents(spark, rows + AWKWARD[2:])
    table = spark.createDataFrame(labels + [(None, 1, 1, "x"), (3, 1, None, "x")], LABELS)
    out = toxicity.score(docs, toxicity.train(docs, table)).collect()
    assert len(out) == docs.count()
    truth = {i: t for i, _, t, _ in labels}
    unique = [r for r in out if r.doc_id is not None and r.doc_id > 10]
    held = [r for r in unique if r.held_out]
    assert {r.doc_id for r in held} == {
        i for i in truth if i > 10 and zlib.crc32(str(i).encode()) % 5 == 0}
    hit = sum(truth[r.doc_id] == r.predicted for r in held)
    assert hit / len(held) > 0.97
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    # Labels of held-out rows change nothing.
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, x)
             for i, q, t, x in labels]
    again = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(other, LABELS)))
    key = lambda r: (str(r.doc_id), r.score)
    assert sorted(map(key, again.collect())) == sorted(map(key, out))


def test_no_labels_and_empty(spark):
    docs = documents(spark, AWKWARD)
    none = spark.createDataFrame([], LABELS)
    out = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(out) == len(AWKWARD) and {r.score for r in out} == {0.5}
    one = spark.createDataFrame([(i, 1, 0, "x") for i in range(40)], LABELS)
    model = toxicity.train(docs, one)
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}
    assert toxicity.score(documents(spark, []), model).count() == 0


@pytest.mark.parametrize("stretch", [64, 1 << 20])
def test_features_do_not_depend_on_stretches(monkeypatch, stretch):
    want = sorted(toxicity.Features()(LONG).tolist())
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    assert sorted(toxicity.Features()(LONG).tolist()) == want
    assert len(set(want)) == len(want)


def test_sample_is_bounded(spark):
    rows, labels = corpus(200)
    got = toxicity.training_sample(documents(spark, rows), spark.createDataFrame(labels, LABELS), 9)
    assert {r.toxic: r.n for r in got.groupBy("toxic").agg(F.count("*").alias("n")).collect()} == {
        0: 9, 1: 9}
