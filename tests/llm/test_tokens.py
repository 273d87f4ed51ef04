import zlib

import numpy as np
import pyarrow as pa
import pytest

from bidscope.llm import packing, token_store, tokens

from conftest import SF001
from llm_rows import AWKWARD, documents


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.vocabulary_path())


def ids_of(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(library, spark):
    texts = [r[1] for r in AWKWARD] + [
        "don't I'LL we've 's 'S x2y33 ² Ǆ Ⱥ", "a b c　d\x85e f",
        "́start 가 ạ̇ <|startoftext|><|endoftext|>", "''' ... !!! $%&"]
    texts += [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    ids, offsets = tokens.ChunkEncoder().encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == ids_of(library, text, 0)[:-1]


def check_store(spark, library, docs, out):
    manifest = token_store.write_tokens(docs, out)
    found = token_store.with_global_start(token_store.read_documents(manifest), manifest)
    rows = sorted(found.collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, ids_of(library, r.text, 1)) for r in docs.collect()),
                  key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r.doc_id for r in rows] == [w[0] for w in want]
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=key) == sorted(
        ((d, len(i), crc(i)) for d, i in want), key=key)
    return manifest, rows


def test_store_awkward_rows(spark, library, tmp_path):
    manifest, rows = check_store(spark, library, documents(spark, AWKWARD), str(tmp_path / "o"))
    file = manifest.orderBy("n_ids", ascending=False).first()
    reader, ids = token_store.open_file(file.path)
    assert len(ids) == file.n_docs
    inside = []
    for k in range(file.n_sequences):
        a, mask = token_store.sequence(reader, k)
        assert len(a) == len(mask) == token_store.SEQUENCE
        assert a.base is not None  # a view, not a copy
        inside += a[mask.to_numpy(zero_copy_only=False)].tolist()
    assert len(inside) == file.n_ids


def test_store_whole_table(spark, library, tmp_path):
    check_store(spark, library, spark.read.parquet(f"{SF001}/documents.parquet").coalesce(1),
                f"file://{tmp_path}/o")


def test_store_empty(spark, tmp_path):
    manifest = token_store.write_tokens(documents(spark, []), str(tmp_path / "o"))
    found = token_store.with_global_start(token_store.read_documents(manifest), manifest)
    assert found.count() == 0


def check_pack(library, docs, packed, capacity):
    rows = packed.collect()
    want = []
    for r in docs.collect():
        ids = ids_of(library, r.text, 0)
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want.append((r.doc_id, p, s, len(part), crc(part)))
    key = lambda x: tuple((y is not None, y or 0) for y in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows),
                  key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(w[3] for w in want) // capacity)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack_awkward_rows(spark, library, capacity):
    docs = documents(spark, AWKWARD)
    check_pack(library, docs, packing.pack_documents(docs, capacity), capacity)


def test_pack_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    used, least = check_pack(library, docs, packing.pack_documents(docs), 2048)
    assert used <= least + 1


def test_pack_empty(spark):
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_sequences_hold_the_ids(spark, library):
    docs = documents(spark, AWKWARD)
    packed = packing.pack_documents(docs, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert max(len(r.ids) for r in rows) <= 2048
    assert sorted(i for r in rows for i in r.ids) == sorted(
        i for r in docs.collect() for i in ids_of(library, r.text, 0))


def test_search_beats_best_fit():
    rng = np.random.default_rng(3)
    for spread in ((200, 1200), (500, 900), (1, 2048)):
        lengths = rng.integers(*spread, 3000)
        first = packing.best_fit(lengths, 2048)
        search = packing.SwapSearch(lengths, first.copy(), 2048)
        before = (search.fill.astype(float) ** 2).sum()
        after = search.run()
        fill = np.bincount(after, lengths)
        assert fill.max() <= 2048 and fill.sum() == lengths.sum()
        assert (fill ** 2).sum() >= before
        assert len(np.unique(after)) <= len(np.unique(first))


def test_ids_beyond_16_bits_are_kept(tmp_path):
    import numpy as np
    import pyarrow as pa
    from bidscope.llm import token_store
    for n_ids, kind in ((1 << 16, pa.uint16()), ((1 << 16) + 1, pa.uint32())):
        path = str(tmp_path / f"{n_ids}.arrow")
        ids = np.array([0, 1, n_ids - 1] * 1000, "<u4")
        with pa.OSFile(path, "wb") as sink:
            out = token_store.SequenceWriter(sink, n_ids)
            out.add(ids, np.ones(len(ids), np.uint8))
            out.close()
        table = pa.ipc.open_file(path).read_all()
        assert table.schema.field("ids").type.value_type == kind
        flat = table["ids"].combine_chunks().flatten().to_numpy()
        assert (flat[:len(ids)] == ids).all() and out.written == len(ids)
