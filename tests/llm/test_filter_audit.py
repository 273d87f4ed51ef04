import itertools
import re

import duckdb
import pytest

from bidscope.llm import filter_audit

from llm_rows import AWKWARD, documents

LABELS = "doc_id long, quality int, toxic int, part string"
KINDS = [
    "plain word here " * 90, "Good Words Only " * 80, "price $5 & more * stuff " * 60,
    " ".join(f"w{i}" for i in range(260)), " ".join(f"W{i}" for i in range(260)) + " #",
    "short", "", None, "é ß " * 120]


def by_hand(rows, labels):
    """Every order, document by document."""
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        text = text or ""
        if i is not None:
            first[text] = min(i, first.get(text, i))
    docs = {}
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {x for x, bad in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)),
            ("D", re.search(r"[#$%&*|]", text)), ("E", i is not None and i > first[text])) if bad}
        docs.setdefault(source or "", []).append((i, fails))
    found = {}
    for part, members in docs.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                shapley[letter] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone),
                    sum(letter in f for _, f in members) - len(gone),
                    sum(f == {letter} for _, f in members),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), values in found.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in found.items()}


def table():
    rows = [(i, KINDS[i % len(KINDS)], f"s{i % 2}") for i in range(60)]
    rows += [(500 + i, KINDS[0], "hot") for i in range(40)]
    rows += [(70, KINDS[3], None), (71, KINDS[3], ""), (72, KINDS[3] + " ", "s0")]
    # The same row twice, and rows without doc_id.
    rows += [(0, KINDS[0], "s0"), (None, KINDS[0], "s0"), (None, "only here", "s1")]
    rows += [(r[0], r[1], "src1") for r in AWKWARD]
    labels = [(i, i % 3 == 0, i % 5 == 0, "x") for i in range(0, 80, 2)]
    labels = [(i, int(q), int(t), x) for i, q, t, x in labels] + [
        (2, 1, None, "x"), (2, None, 0, "x"), (None, 1, 1, "x"), (501, 1, 1, "x")]
    return rows, labels


def test_equals_all_orders_by_hand(spark):
    rows, labels = table()
    out = filter_audit.audit(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) == 600 * len({r[2] or "" for r in rows})
    assert set(got) == by_hand(rows, labels)
    assert dict(out.dtypes)["step"] == "int" and dict(out.dtypes)["shapley"] == "bigint"


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(documents(spark, []), none).count() == 0
    only = filter_audit.audit(documents(spark, [(1, "a b", "s")]), none).collect()
    assert len(only) == 600 and {r.good_lost + r.toxic_lost for r in only} == {0}


def test_more_parts_than_the_recursion_limit_allows(spark):
    before = spark.conf.get(filter_audit.ROW_LIMIT)
    spark.conf.set(filter_audit.ROW_LIMIT, "1000")
    try:
        cells = spark.createDataFrame([(f"p{i}", i % 32, 2, 1, 0) for i in range(40)],
                                      "part string, mask int, n long, good long, toxic long")
        walk = filter_audit.prefixes(cells)
        assert walk.count() == 40 * 325
        assert spark.conf.get(filter_audit.ROW_LIMIT) == "1000"
    finally:
        spark.conf.set(filter_audit.ROW_LIMIT, before)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_its_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(filter_audit.ORACLE).fetchall()
    out = filter_audit.op13_filter_orders(spark, folder)
    assert sorted(map(tuple, out.collect())) == sorted(want)
