import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as E
import corpus_pipeline
from bidscope.llm import quality, tokens

from conftest import SF001
from llm_rows import AWKWARD, PROSE, documents
from test_ngram_join import brute as brute_groups
from test_pii import brute as brute_spans

TAGS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


def breaks_a_rule(text):
    """The table of rules, by plain Python."""
    import re
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(runs)
    repeat = {p for i, r in enumerate(runs) if many[r] > 1 for p in (i, i + 1, i + 2)}
    n, chars = max(1, len(words)), sum(map(len, words))
    upper = sum(len(re.findall(r"\w", c)) for c in text if c.isupper())
    lead = [x.lstrip(" ") for x in lines]
    return (len(words) < 50 or len(repeat) / n > 0.5 or not 2 <= chars / n <= 12
            or len(re.findall("[#*$%&|<>]", text)) / n > 0.1
            or len(set(words) & set(quality.STOP_FORMS)) < 2
            or (len(lines) - len(set(lines))) / max(1, len(lines)) > 0.6
            or upper / max(1, chars) > 0.3 or text.count("!") / n > 0.2
            or sum(bool(re.match(r"[-*•] |[0-9]+[.)] ", x)) for x in lead) / max(1, len(lines)) > 0.9
            or sum(x.rstrip(" ").endswith(("...", "…")) for x in lines) / max(1, len(lines)) > 0.3)


def mask(text):
    spans = sorted((s, e, k) for k, found in brute_spans(text).items() for s, e in found)
    out, done, end = "", 0, -1
    for s, e, k in spans:
        if s >= end:
            out += text[done:s] + TAGS[k]
        end = max(end, e)
        done = end
    return out + text[done:]


def steps(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF001))
    return out


def check(spark, docs):
    from tokenizers import Tokenizer
    _, kept, single, clean, mixed, packed = steps(spark, docs)
    for step in (kept, single, clean, mixed):
        assert step.columns == docs.columns
    rows = [r for r in docs.collect() if not breaks_a_rule(r.text)]
    assert Counter(kept.collect()) == Counter(rows)
    stay = Counter(c if c is not None else i for i, c, *_ in {
        (c, c) if c is not None else (i, c) for i, c, *_ in brute_groups(
            [(r.doc_id, r.text) for r in rows])})
    assert Counter(r.doc_id for r in single.collect()) == stay
    left = {r.doc_id: r for r in single.collect()}
    want = Counter((i, mask(r.text)) for i, r in left.items())
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == want
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == want
    library = Tokenizer.from_file(tokens.vocabulary_path())
    pieces = Counter()
    for (i, text), n in want.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s:s + 2048], "<u4")
            pieces[(i, p, s, len(part), zlib.crc32(part.tobytes()))] += n
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    load = Counter()
    for r in got:
        load[r.sequence_id] += r.length
    assert max(load.values(), default=0) <= 2048
    return got


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = check(spark, docs)
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    run = corpus_pipeline.run(spark, SF001).collect()
    assert Counter(map(key, run)) == Counter(map(key, got))


def test_awkward_rows_and_empty(spark):
    fine = " ".join(f"{PROSE} unlike{i}" for i in range(2))
    rows = [(1, fine + " mail a@b.co now"), (2, fine + " mail a@b.co now"),
            (2, fine + " mail a@b.co now"), (3, fine.replace("river", "lake")), *AWKWARD[3:]]
    check(spark, documents(spark, rows))
    for step in steps(spark, documents(spark, []))[1:]:
        assert step.count() == 0


def test_registered_queries():
    names = set(E.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(E.oracle_sql()) <= names
