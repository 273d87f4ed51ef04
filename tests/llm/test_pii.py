import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bidscope.llm import pii

from conftest import SF001
from llm_rows import AWKWARD, documents


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c)
        if i % 2:
            d = d * 2 if d < 5 else d * 2 - 9
        total += d
    return total % 10 == 0


def brute(text):
    """The four patterns, straight from their definition."""
    out = {k: [] for k in ("email", "ip", "card", "phone")}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(int(p) for p in m.group().split(".")) <= 255:
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out["phone"].append(m.span())
    return out


NASTY = ["a@b.c", "x a.b+c@d-e.f.g, @b.c a@ a@b a@b. a@@b.c a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1",
         "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111111111111112", "+1 (743) 555-3824",
         "+12345678 +1234567 ++1 22 33 44 55", "\U0001F600 a@b.cd \U0001F600 1.2.3.4", "٣.٣.٣.٣",
         "a@b.c" * 3, "0000.000.00.0255", "000256.1.1.1"]


@given(st.text(alphabet="a1.@+- ()49%\U0001F600", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_equals_patterns(text):
    want = brute(text)
    got = {k: [] for k in want}
    for kind, s, e in pii.base_spans(text):
        got[pii.KINDS[kind]].append((s, e))
    assert got == want


def check(rows, docs, out):
    want = Counter()
    for i, text, *_ in rows:
        b = brute(text or "")
        shown = ",".join(f"{k}:{s}:{e}" for k in b for s, e in b[k])
        want[(i, *[len(b[k]) for k in b], hashlib.sha256(shown.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
                   for r in out) == want
    for r in out:
        parts = [x for x in r.spans.split(",") if x]
        base = [x for x in parts if not x.startswith("context")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_awkward_rows(spark):
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(NASTY)]
    docs = documents(spark, rows)
    check(rows, docs, pii.find_spans(docs, pii.learn_contexts(docs)).collect())
    clean = pii.redact(docs, np.zeros(0, np.int64))
    assert clean.columns == docs.columns and clean.count() == len(rows)
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[100] == "<EMAIL>" and got[3] is None and got[106] == "<PHONE>"
    assert got[1] == AWKWARD[0][1]


def test_empty(spark):
    docs = documents(spark, [])
    assert pii.find_spans(docs, pii.learn_contexts(docs)).count() == 0
    assert pii.redact(docs, np.zeros(0, np.int64)).count() == 0


def test_contexts_reveal_identifiers(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "to"])
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        mail = f"user{i}@mail{i % 7}.example.com"
        rows.append((i, f"{filler(20)} please write to: {mail} {filler(10)}"))
        rows.append((100 + i, f"{filler(20)} the of {i}@x.example.com {filler(30)} the of part12345"))
    for i in range(20):
        rows.append((200 + i, f"{filler(20)} please write to: ID-{i}-{7700 + i} {filler(10)}"))
        rows.append((300 + i, f"{filler(10)} room 1234567 {filler(10)} the of model99887"))
    docs = documents(spark, rows)
    contexts = pii.learn_contexts(docs)
    out = pii.find_spans(docs, contexts).collect()
    check(rows, docs, out)
    texts = dict(rows)
    found = {}
    for r in out:
        for part in r.spans.split(","):
            if part.startswith("context"):
                _, s, e = part.split(":")
                found[r.doc_id] = texts[r.doc_id][int(s):int(e)]
    assert found == {200 + i: f"ID-{i}-{7700 + i}" for i in range(20)}
    clean = {r.doc_id: r.text for r in pii.redact(docs, contexts).collect()}
    assert "write to: <CONTEXT> " in clean[200] and "<EMAIL>" in clean[0]
    assert clean[300] == texts[300]


@pytest.mark.parametrize("text", ["a b 'x12345", "tel:555123 x", "\n\n9988776", "w (id=123456)"])
def test_context_counts_agree(spark, text):
    docs = documents(spark, [(1, text), (2, text)])
    start = pii.identifiers(text, [])[0][0]
    context = pii.context_of(text, start)
    if context is not None:
        got = pii.count_contexts(docs, np.array([context], np.int64)).collect()
        assert [(r.context, r.n) for r in got] == [(context, 2)]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, docs, pii.find_spans(docs, pii.learn_contexts(docs)).collect())


def plain_contexts(texts, min_seeds, accept, rounds, generations):
    """The bootstrapping without Spark, one occurrence after another."""
    edges, seeds, words = Counter(), set(), Counter()
    for text in texts:
        base = pii.base_spans(text)
        found = [(s, e, True) for _, s, e in base] + [
            (s, e, False) for s, e in pii.identifiers(text, base)]
        for s, e, seed in found:
            context = pii.context_of(text, s)
            if context is not None:
                edges[context, text[s:e].lower()] += 1
                seeds |= {text[s:e].lower()} if seed else set()
        for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text):
            lead = len(pii._lead(m.group()))
            words[pii.context_of(text, m.start() + lead)] += 1
    score = {item: float(item in seeds) for _, item in edges}
    counted, s, quiet = set(), {}, 0
    for _ in range(generations):
        known = {i for i, x in score.items() if x >= accept}
        new = {c for c, n in Counter(c for c, i in edges if i in known).items() if n >= min_seeds}
        quiet = 0 if new - counted else quiet + 1
        if not counted | new or quiet >= rounds:
            break
        counted |= new
        s = {c: min(sum(n * score[i] for (d, i), n in edges.items() if d == c)
                    / (words[c] + pii.DOUBT), 0.999999) for c in counted}
        for item in score:
            miss = 1.0
            for (c, i) in edges:
                if i == item and c in s:
                    miss *= 1 - s[c]
            score[item] = max(float(item in seeds), 1 - miss)
    return {c for c, x in s.items() if x >= accept}


def generations_of_contexts():
    """Mail addresses, identifiers behind the same words, and identifiers
    that only stand behind words before those."""
    texts = []
    for i in range(40):
        texts.append(f"please mail to u{i}@x.example.org now or the of {i}55123 it")
        texts.append(f"please mail to ID{i:05d}A now")
        texts.append(f"the ref code ID{i:05d}A is here")
        texts.append(f"a ref code ZZ{i:05d}Q is here")
        texts.append(f"your tax number: ZZ{i:05d}Q or tax number: YY{i:05d}K too")
        texts.append(f"room of size {i}4455 and the of {i}99 of the of the of")
    return texts


def test_later_generations_are_found_as_in_plain_python(spark):
    texts = generations_of_contexts()
    docs = documents(spark, list(enumerate(texts)))
    learned = pii.learn_contexts(docs)
    accepted = {r.context for r in learned.collect()}
    assert accepted == plain_contexts(texts, pii.MIN_SEEDS, pii.ACCEPT, pii.ROUNDS, pii.GENERATIONS)
    shown = {r.doc_id: r.spans for r in pii.find_spans(docs, learned).collect()}
    for i in (1, 2, 3):  # first, second and later generations
        assert "context" in shown[i], texts[i]
    assert shown[4].count("context") == 2
    assert all("context" not in shown[6 * i + 5] for i in range(40))


def test_contexts_from_real_word_starts_and_nested_spans():
    far = " " * 5000
    for text in ("mail to x12345", f"mail{far}to{far}x12345", "w" * 9000 + " mail to x12345"):
        assert pii.context_of(text, text.index("x12345")) == pii.context_of("mail to x12345", 8)
    # One long span, many short ones inside, then the identifier inside the long one.
    taken = [(0, 0, 100)] + [(0, k, k + 1) for k in range(1, 30)]
    assert pii.identifiers("x" * 40 + " ab12345 " + "y" * 60 + " cd12345", taken) == [(110, 117)]
