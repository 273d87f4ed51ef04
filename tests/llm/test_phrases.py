import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bidscope.llm import phrases
from bidscope.llm import quotient_filter as qf

from llm_rows import AWKWARD, CLASH, DOCS, LONG

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 25), st.integers(2, 5), st.integers(0, 8), st.integers(0, 400),
       st.integers(0, 2 ** 30))
def test_filters_lose_nothing(bits, n, shard_bits, size, seed):
    rng = np.random.default_rng(seed)
    half = qf.half_bits(bits, n)
    shard_bits = min(shard_bits, half)
    ids = [rng.integers(0, 1 << bits, size) for _ in range(n)]
    # Some keys many times.
    ids = [np.concatenate([c, np.repeat(c[:2], 300)]) for c in ids]
    high, low = qf.pack(ids, bits)
    mixed = qf.permute(high, low, half)
    back = qf.restore(*mixed, half)
    assert (back[0] == high).all() and (back[1] == low).all()
    assert all((a == b).all() for a, b in zip(qf.unpack(high, low, bits, n), ids))
    cut = len(high) // 3
    parts = [qf.count(mixed[0][s], mixed[1][s], half) for s in (slice(cut), slice(cut, None))]
    found = {}
    for k in range(1 << shard_bits):
        shard = []
        for part in parts:
            ends = qf.shard_ends(part, shard_bits)
            if ends[k + 1] > ends[k]:
                own = part.slice(ends[k], ends[k + 1])
                again = qf.decode(qf.encode(own, shard_bits))
                assert all((getattr(own, c) == getattr(again, c)).all() for c in ("high", "low", "n"))
                shard.append(again)
        if shard:
            total = qf.merge(shard)
            columns = qf.unpack(*qf.restore(total.high, total.low, half), bits, n)
            found |= dict(zip(zip(*[c.tolist() for c in columns]), total.n.tolist()))
    assert found == dict(Counter(zip(*[c.tolist() for c in ids])))


def test_keys_beyond_the_width_are_an_error():
    assert qf.half_bits(25, 5) == 63
    with pytest.raises(ValueError):
        qf.half_bits(26, 5)


def by_hand(rows, least, top):
    counts, total = {}, Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang or "und"] += len(words)
            for n in range(1, 6):
                own.update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        often = {g: f for g, f in own.items() if f >= least}
        covered = {g[s:e] for g, f in often.items() for s in range(len(g))
                   for e in range(s + 2, len(g) + 1) if e - s < len(g) and f >= often[g[s:e]]}
        rows = []
        for g, a in often.items():
            if len(g) > 1 and g not in covered:
                score, _, l, r = min((1000 * a * total[lang] // (own[g[:k]] * own[g[k:]]), k,
                                      own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
                rows.append((lang, " ".join(g), a, l, r, total[lang], score))
        rows.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], k, *x[1:]) for k, x in enumerate(rows[:top], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, *CLASH) for i, (t, lang) in enumerate(rows)],
                                 DOCS)


def corpus():
    rng = random.Random(6)
    words = ["the", "of", "New", "york", "city", "a", "Él", "x#y", "été", "b"]
    rows = []
    for i in range(80):
        text = "".join(rng.choices(words, weights=range(10, 0, -1))[0] + rng.choice(
            [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!"]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de", None, "und", "en us"])))
    # One text many times, one long run, no text, only breaks.
    rows += [("new york city of the a b", "en")] * 30 + [("a a a a a a a", "de"), (LONG, "long"),
                                                         (None, "en"), ("", None), (" .\n,", "en")]
    return rows + [(r[1], "en") for r in AWKWARD]


def test_equals_counts_by_hand_and_both_ways_to_ids(spark):
    rows = corpus()
    want = by_hand(rows, 3, 40)
    docs = table(spark, rows)
    got = phrases.collocations(docs, 3, 40)
    assert got.columns == list(COLUMNS)
    assert sorted(map(tuple, got.collect())) == want
    joined = phrases.collocations(docs, 3, 40, broadcast_words=0)
    assert sorted(map(tuple, joined.collect())) == want


def test_small_filters_and_shards_give_the_same(spark, monkeypatch):
    rows = corpus()[:60]
    want = by_hand(rows, 2, 2000)
    for name, value in (("ENTRIES", 16), ("SHARD_WORDS", 8), ("ROW_IDS", 4), ("TABLE_BITS", 16)):
        monkeypatch.setattr(phrases, name, value)
    out = phrases.collocations(table(spark, rows).coalesce(2), 2)
    assert sorted(map(tuple, out.collect())) == want


def test_products_beyond_64_bits(spark):
    n = 10 ** 12
    found = spark.createDataFrame([([1, 2], n)], "ids array<bigint>, n long")
    words = spark.createDataFrame([("en", "a", n + 7, 1), ("en", "b", n + 9, 2)],
                                  "lang string, word string, n long, id long")
    totals = spark.createDataFrame([("en", 10 ** 13)], "lang string, n long")
    row = phrases._ranked(found, words, totals, 5).first()
    assert row.score == 1000 * n * 10 ** 13 // ((n + 7) * (n + 9))


def test_empty_and_nothing_frequent(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [("a b a b", "en"), (None, None)])).count() == 0


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(phrases.ORACLE).fetchall()
    out = phrases.op12_quotient_phrases(spark, folder)
    assert sorted(map(tuple, out.collect())) == sorted(want)
