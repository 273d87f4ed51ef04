from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bidscope.llm import pii

from llm_rows import AWKWARD, documents


def planted(copies):
    """One context with five e-mails, beside ``copies`` of seeds in another."""
    rows = [(i, f"some words then write to: user{i}@mail.example.com and more") for i in range(5)]
    rows += [(50 + i, f"some words then write to: ID-{i}-{7700 + i} and more") for i in range(2)]
    return rows + [(100, "the log says from 10.0.0.1 again " * copies)] + AWKWARD


def spans(rows):
    return Counter((r.doc_id, r.spans) for r in rows)


def test_a_rare_context_counts_on_a_table_of_many_seeds(spark, monkeypatch):
    docs = documents(spark, planted(1))
    found = pii.find_entities(docs)
    # Six million seed occurrences more: five are less than a millionth of them.
    hot = spark.range(6_000_000).select(F.lit(1).cast("long").alias("context"), F.lit(
        b"one").alias("item"), F.lit(True).alias("seed"))
    monkeypatch.setattr(pii, "find_entities", lambda _: found.union(hot))
    contexts = pii.learn_contexts(docs)
    got = {r.doc_id: r.spans for r in pii.find_spans(docs, contexts).collect()}
    assert got[50].startswith("context:") and got[51].startswith("context:")


def test_join_equals_broadcast(spark):
    docs = documents(spark, planted(3))
    contexts = pii.learn_contexts(docs)
    assert contexts.count() > 0
    joined = pii.learn_contexts(docs, limit=0)
    assert {r.context for r in joined.collect()} == {r.context for r in contexts.collect()}
    edges = pii.find_entities(docs).select("context").distinct()
    want = pii.count_contexts(docs, edges)
    assert want.count() > 3
    assert Counter(pii.count_contexts(docs, edges, limit=0).collect()) == Counter(want.collect())
    held = np.array([r.context for r in contexts.collect()], np.int64)
    want = spans(pii.find_spans(docs, held).collect())
    assert sum("context" in s for _, s in want) == 2
    assert spans(pii.find_spans(docs, contexts).collect()) == want
    assert spans(pii.find_spans(docs, contexts, limit=0).collect()) == want
    clean = pii.redact(docs, contexts, limit=0)
    assert clean.columns == docs.columns
    assert Counter(clean.collect()) == Counter(pii.redact(docs, held).collect())
