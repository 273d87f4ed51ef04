import pathlib
import shutil
from collections import Counter

import corpus_pipeline
from bidscope.llm import mixing, packing

from llm_rows import documents

TEXT = "some words of a text that is short "


def mixed_table(spark):
    """Two sources, 8 to 1 in rows: mixing gives them about 2.8 to 1."""
    rows = [(i, TEXT * (1 + i % 5), "small" if i % 9 == 0 else "big") for i in range(18_000)]
    return documents(spark, rows)


def share_of_small(docs):
    share = {r.key: r.share / r.period for r in mixing.shares(docs).collect()}
    return share["vsmall"]


def groups_of(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id >> 32, []).append(r)
    return [by[k] for k in sorted(by)]


def test_prefixes_of_the_sequences_hold_the_target_shares(spark):
    docs = mixed_table(spark)
    want = share_of_small(docs)
    assert want > 0.25 > 1 / 9
    # The order of the rows read does not matter.
    rows = corpus_pipeline.pack(spark, docs.orderBy("text", "doc_id"), "").collect()
    assert Counter(r.doc_id for r in rows) == Counter(range(18_000))
    groups = groups_of(rows)
    assert len(groups) == 3 and max(map(len, groups)) <= packing.GROUP_PIECES
    first = [r.doc_id % 9 == 0 for r in groups[0]]
    # Less than one block off, and one block cut by the group's end.
    assert abs(sum(first) - want * len(first)) < 2 * mixing.BLOCK_ROWS
    position = {r.doc_id: r.position for r in mixing.with_position(
        mixing.interleave(docs)).collect()}
    ends = [max(position[r.doc_id] for r in g) for g in groups]
    starts = [min(position[r.doc_id] for r in g) for g in groups]
    assert starts == [0, ends[0] + 1, ends[1] + 1] and ends[2] == 17_999


def test_long_documents_and_order_inside_a_group(spark):
    long = "word " * 700
    rows = [(i, long * (1 + i % 3), f"s{i % 4 == 0}") for i in range(40)] * 2 + [
        (None, None, None), (1000, "", None)]
    docs = documents(spark, rows)
    got = packing.pack_mixed(docs, capacity=512, group_pieces=32).collect()
    want = packing.pack_documents(docs, capacity=512).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, got)) == Counter(map(key, want))
    load = Counter()
    for r in got:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= 512
    position = {}
    for r in mixing.with_position(mixing.interleave(docs)).collect():
        position.setdefault(r.doc_id, []).append(r.position)
    ends = -1
    for g in groups_of(got):
        assert len(g) <= 32
        low = min(min(position[r.doc_id]) for r in g)
        assert low >= ends - 1  # twins of one document are neighbours
        ends = max(max(position[r.doc_id]) for r in g)
    # Full sequences of one piece come in the order of their documents.
    full = sorted((r.sequence_id, min(position[r.doc_id])) for r in got if r.length == 512)
    assert [p for _, p in full] == sorted(p for _, p in full)


def test_empty(spark):
    assert packing.pack_mixed(documents(spark, [])).count() == 0


def test_last_stage_follows_the_rows_as_mixing_wrote_them(spark, tmp_path):
    docs = mixed_table(spark).repartition(4)
    *_, (_, mix), (_, last) = corpus_pipeline.STAGES
    mixed = mix(spark, docs, "")
    # Files of very unequal size, so that they are read in another order.
    at = {r.doc_id: i for i, r in enumerate(mixed.select("doc_id").collect())}
    for turned in (False, True):
        place = {i: 17_999 - p if turned else p for i, p in at.items()}
        order = spark.createDataFrame(list(place.items()), "doc_id long, p long")
        rows = docs.join(order, "doc_id").orderBy("p")
        path = str(tmp_path / f"t{turned}")
        for n in (100, 17_000, 18_000):
            low = {100: 0, 17_000: 100, 18_000: 17_000}[n]
            rows.where(f"p >= {low} and p < {n}").drop("p").select(*docs.columns).coalesce(1) \
                .write.mode("append").parquet(f"{path}/{low}")
        flat = tmp_path / f"f{turned}"
        flat.mkdir()
        for i, low in enumerate((0, 100, 17_000)):
            [file] = pathlib.Path(f"{path}/{low}").glob("*.parquet")
            shutil.copy(file, flat / f"part-{i:05d}-x.parquet")
        groups = groups_of(last(spark, spark.read.parquet(str(flat)), "").collect())
        assert len(groups) == 3
        done = 0
        for g in groups:
            assert sorted(place[r.doc_id] for r in g) == list(range(done, done + len(g)))
            done += len(g)
        assert done == 18_000
    # The stages as they run: the rows of the mixing stage, written and read.
    mixed.write.parquet(str(tmp_path / "mixed"))
    groups = groups_of(last(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect())
    assert [sorted(at[r.doc_id] for r in g) for g in groups] == [
        list(range(a, a + len(g))) for a, g in zip((0, len(groups[0]), sum(map(len, groups[:2]))),
                                                   groups)]
