import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from bidscope.llm import quality, queries
from tools.oracle_check import canon

from conftest import SF001
from llm_rows import AWKWARD, PROSE, documents
from test_pipeline import breaks_a_rule


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    many = Counter(zip(words, words[1:], words[2:]))
    repeat = {p for i, run in enumerate(zip(words, words[1:], words[2:])) if many[run] > 1
              for p in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(repeat), failed,
            not failed and not breaks_a_rule(text))


ROWS = AWKWARD + [
    (20, "a b c " * 40), (21, " ".join(f"w{i}" for i in range(200))), (22, PROSE * 3),
    (23, f"{PROSE}\n" * 2), (24, " ".join(f"the of x{i} #|" for i in range(60))),
    (25, " ".join(f"The Of y{i}" for i in range(60))), (26, "x y"), (27, "x y z x y z"),
    (28, " ".join(f"the of LOUD{i}!!" for i in range(60)).upper()),
    (29, "\n".join(f"- the of item {i}" for i in range(60))),
    (30, "\n".join(f"the of item {i} ..." for i in range(60)))]


def test_counts_and_verdicts(spark):
    got = quality.score_documents(documents(spark, ROWS)).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                    r.n_repeat_words, r.base_failed, r.kept) for r in got), key=key) == sorted(
        ((i, *brute(t)) for i, t, *_ in ROWS), key=key)
    assert {r.doc_id for r in got if r.kept} == {25}


def test_empty_and_columns(spark):
    assert quality.score_documents(documents(spark, [])).count() == 0
    docs = documents(spark, ROWS)
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [25]


def test_table_of_rules(spark):
    rules = (("few", "n_words", 150, None),)
    got = quality.score_documents(documents(spark, ROWS), rules).where("kept").collect()
    assert {r.doc_id for r in got} == {
        i for i, t, *_ in ROWS if brute(t)[0] >= 150 and not brute(t)[5]}
    assert all(r.broken == [] for r in got)


def test_plan_is_native(spark):
    plan = quality.score_documents(documents(spark, []))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = E.queries()[name](spark, SF001)
    res = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(names, res.fetchall())


def test_windows_with_equal_hashes_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F
    # Three hashes for all windows: most neighbours in the order differ.
    monkeypatch.setattr(quality, "_window_hash", lambda *w: F.xxhash64(*w) % 3)
    rows = [r for r in ROWS if r[0] != 6]
    got = quality.score_documents(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_repeat_words) for r in got) == sorted(
        (str(i), brute(t)[4]) for i, t, *_ in rows)
