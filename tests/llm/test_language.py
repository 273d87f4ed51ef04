import random
import zlib

import pytest
import zstandard

from bidscope.llm import language
from bidscope.llm.common import read

from llm_rows import CLASH, DOCS, LONG

PARTS = {"aa": ["ba", "lo", "mi", "ter"], "bb": ["zük", "ßan", "ör", "eich"],
         "cc": ["ción", "ña", "que", "los"]}


def table(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, "s", None if t is None else len(t), *CLASH) for i, t, lang in rows], DOCS)


def corpus(n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = "aabbcc"[2 * (i % 3):2 * (i % 3) + 2]
        word = lambda: "".join(rng.choices(PARTS[lang], k=rng.randint(1, 3)))
        rows.append((i, " ".join(word() for _ in range(rng.randint(10, 90))), lang))
    return rows


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


AWKWARD = [(900, None, "aa"), (901, "", "bb"), (902, "12 $ 34 _", None), (903, "́", "aa"),
           (None, "balomi terba lomi", "aa"), (904, LONG, None), (905, "BALOMI, TERBA! LOLOMI (TERMI) BATERLO MILO", None),
           (1, "x", "aa"), (1, "x", "aa")]


def test_equals_plain_version_and_finds_languages(spark):
    rows = corpus() + AWKWARD
    docs = table(spark, rows)
    learned = language.learn(docs)
    assert set(learned) == set(PARTS)
    out = language.identify(docs, learned).collect()
    assert sorted((str(r.doc_id), r.held_out) for r in out) == sorted(
        (str(i), is_held(i)) for i, _, _ in rows)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert held and all(r.lang_pred == truth[r.doc_id] for r in held)
    found = {r.doc_id: r for r in out}
    for i in (900, 901, 902, 903):
        assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, False)
    assert found[905].lang_pred == "aa"
    # Each text by itself: every piece compressed with every dictionary.
    names = list(learned)
    for i, text, _ in rows[:30] + [(904, LONG, None)]:
        if i == 1:
            continue
        plain = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()
        sizes = []
        for name in names:
            options = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_GREEDY, window_log=17, chain_log=16, hash_log=16,
                search_log=4, min_match=4, target_length=16, write_content_size=0,
                write_checksum=0, write_dict_id=0)
            content = zstandard.ZstdCompressionDict(
                learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(dict_data=content, compression_params=options)
            sizes.append(sum(len(c.compress(plain[k:k + 2048])) for k in range(0, len(plain), 2048)))
        best = min(range(3), key=lambda k: sizes[k])
        assert found[i].lang_pred == names[best]
        assert found[i].score == pytest.approx(1 - sizes[best] / sorted(sizes)[1])
        assert found[i].rejected == (found[i].score < language.MIN_MARGIN)


def test_held_out_rows_and_inputs_do_not_matter(spark):
    rows = corpus()
    key = lambda r: (r.doc_id, r.lang_pred, r.score)
    docs = table(spark, rows)
    learned = language.learn(docs)
    other = table(spark, [(i, "zük" if is_held(i) else t, "xx" if is_held(i) else lang)
                          for i, t, lang in rows])
    assert language.learn(other) == learned
    blind = docs.drop("lang", "source")
    assert sorted(map(key, language.identify(blind, learned).collect())) == sorted(
        map(key, language.identify(docs, learned).collect()))


def test_sample_is_bounded_and_copies_count_once(spark, monkeypatch):
    rows = corpus(90) + [(7, "balomi " * 50, "aa")] * 40
    learned = language.learn(table(spark, rows), per_language=5)
    assert set(learned) == set(PARTS)
    monkeypatch.setattr(language, "DICTIONARY_BYTES", 100)
    assert max(map(len, language.learn(table(spark, rows)).values())) == 100
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language.learn(table(spark, rows))


def test_nothing_learned_one_language_and_empty(spark):
    none = table(spark, [(2, "abc", None), (None, "abc", "aa")])
    assert language.learn(none) == {}
    assert {r.lang_pred for r in language.identify(none, {}).collect()} == {"und"}
    alone = language.identify(none, {"aa": b"abc def ghi"}).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("aa", 1.0)}
    # No text to learn from: both languages compress alike, the first wins.
    bare = language.identify(none, {"bb": b"", "aa": b""}).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in bare} == {("bb", 0.0, True)}
    assert language.identify(table(spark, []), {"aa": b"abc"}).count() == 0
    assert language.learn(table(spark, [])) == {}


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in read(spark, folder, "documents").collect()}
    out = language.op11_zstd_language(spark, folder).collect()
    held = [r for r in out if r.held_out and truth[r.doc_id]]
    assert len(out) == len(truth)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
