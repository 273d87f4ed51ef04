import random
from collections import Counter

import pytest

from bidscope.llm import ngram_join

from conftest import SF001
from llm_rows import AWKWARD, documents


def words_of(text):
    return [w for w in (text or "").replace("\n", " ").replace("\t", " ").replace(
        "\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]


def runs_of(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """[(doc_id, class_id, text_class, n_links, n_text_links)] by all pairs."""
    texts = sorted({t or "" for _, t in rows})
    ids = {t: [i for i, x in rows if (x or "") == t] for t in texts}
    sets = {t: runs_of(t) for t in texts}
    near = {t: [u for u in texts if u != t and sets[t] and
                len(sets[t] & sets[u]) * 5 >= 4 * len(sets[t] | sets[u])] for t in texts}
    group, out = {}, []
    for t in texts:
        if t not in group:
            todo, group[t] = [t], t
            while todo:
                for u in near[todo.pop()]:
                    if u not in group:
                        group[u] = t
                        todo.append(u)
    least = lambda xs: min((i for i in xs if i is not None), default=None)
    for i, x in rows:
        t = x or ""
        out.append((i, least(j for u in texts if group[u] == group[t] for j in ids[u]),
                    least(ids[t]), len(ids[t]) - 1 + sum(len(ids[u]) for u in near[t]),
                    len(near[t])))
    return out


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def corpus():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(150)]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(20, 200))]
        texts += near_copies(rng, base, rng.randint(2, 8), 3)
    texts += near_copies(rng, [word() for _ in range(120)], 300, 2)  # a large group
    passage = " ".join(word() for _ in range(60))
    texts += [f"{passage} {' '.join(word() for _ in range(100))}" for _ in range(40)]
    texts += rng.choices(texts, k=80) + ["the same"] * 200
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [64, 256])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus()
    got = [tuple(r) for r in ngram_join.linked_documents(documents(spark, rows)).collect()]
    want = brute(rows)
    assert len(got) == len(want)
    missing = sum((Counter(want) - Counter(got)).values())
    # Links are found with a chance, verified without.
    assert missing <= 0.003 * len(want)
    by = {w[0]: w for w in want}
    assert all(g[3] <= by[g[0]][3] and g[4] <= by[g[0]][4] for g in got)


def test_awkward_rows(spark):
    rows = [(i, t) for i, t, *_ in AWKWARD]
    got = [tuple(r) for r in ngram_join.linked_documents(documents(spark, AWKWARD)).collect()]
    assert Counter(got) == Counter(brute(rows))
    kept = ngram_join.one_of_each_group(documents(spark, AWKWARD))
    assert kept.columns == documents(spark, []).columns
    firsts = {(c if c is not None else w) for w, c, *_ in brute(rows)}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(firsts)


def test_empty(spark):
    docs = documents(spark, [])
    assert ngram_join.linked_documents(docs).count() == 0
    assert ngram_join.one_of_each_group(docs).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in ngram_join.linked_documents(docs).collect()]
    assert Counter(got) == Counter(brute(rows))
