import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bidscope.llm import mixing, sharding

from conftest import SF001
from llm_rows import AWKWARD, documents


def brute_schedule(share, period):
    """Earliest deadline first, slot by slot."""
    done, out = Counter(), []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // q), s) for s, q in sorted(share.items())
                 if done[s] < q and done[s] * period // q <= t]
        _, pick = min(ready)
        out.append(pick)
        done[pick] += 1
    return out


def check_mix(docs, target=None, period=50, block_rows=2):
    rows = [r.asDict() for r in mixing.with_position(
        mixing.interleave(docs, target, period, block_rows)).collect()]
    assert Counter(r["doc_id"] for r in rows) == Counter(r.doc_id for r in docs.collect())
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    share = {r.key: r.share for r in mixing.shares(docs, target, period).collect()}
    if not rows:
        return rows, share
    period = rows[0]["period"]
    assert sum(share.values()) == period and min(share.values()) >= 1
    slots = brute_schedule(share, period)
    at = defaultdict(list)
    for t, s in enumerate(slots):
        at[s].append(t)
    seen = defaultdict(set)
    for r in rows:
        key = "n" if r["source"] is None else "v" + r["source"]
        turn = at[key][r["block"] % share[key]]
        assert r["slot"] == r["block"] // share[key] * period + turn
        assert r["release"] <= r["slot"] < r["deadline"]
        seen[key].add((r["block"], r["place"]))
    for key, places in seen.items():
        assert places == {divmod(i, block_rows) for i in range(len(places))}
    # Less than one block off the target at every slot.
    for s, q in share.items():
        ran = 0
        for t, x in enumerate(slots):
            ran += x == s
            assert abs(ran - (t + 1) * q / period) < 1
    return rows, share


def test_mix_sources(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else f"s{i % 7}") for i in range(200)]
    rows += [(5, "again", "big"), (5, "again", "big"), (None, None, None), (None, "x", None)]
    docs = documents(spark, rows)
    check_mix(docs)
    _, share = check_mix(docs, {"big": 0.5, "s0": 0.3, "s3": 0.2})
    assert share["vbig"] > share["vs0"] > share["vs3"] > share["vs6"]
    check_mix(docs, {"nobody": 1.0})


def test_mix_awkward_and_empty(spark):
    check_mix(documents(spark, AWKWARD))
    check_mix(documents(spark, []))


def test_mixed_order_keeps_documents(spark):
    docs = documents(spark, AWKWARD * 3)
    mixed = mixing.mixed_order(docs)
    assert mixed.columns == docs.columns
    assert Counter(mixed.collect()) == Counter(docs.collect())


def test_mix_is_native(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = mixing.with_position(mixing.interleave(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def check_shards(docs, shards=8, **kw):
    out = sharding.assign(sharding.records(docs), shards, **kw).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1,
                    zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    slots, load = defaultdict(list), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    for s, found in slots.items():
        assert 0 <= s < shards and sorted(found) == list(range(len(found)))
    return out, load


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_even(spark, hot):
    rows = [(i, f"text {i} " * (1 + i % 13)) for i in range(4000)]
    if hot:
        rows += [(10_000 + i, "the same text again and again") for i in range(2000)]
    out, load = check_shards(documents(spark, rows))
    total = sum(load.values())
    most = max(r["size"] for r in out)
    assert len(load) == 8
    assert max(load.values()) - min(load.values()) <= 2 * (total / 8 * 0.01 + most)
    shards = defaultdict(set)
    for r in out:
        shards[r.grp].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= hot


def test_shards_awkward_and_empty(spark):
    check_shards(documents(spark, AWKWARD * 5))
    check_shards(documents(spark, []))
    check_shards(documents(spark, [(1, None)]))


def test_shards_identical_rows(spark):
    _, load = check_shards(documents(spark, [(1, "one row")] * 3000 + [(2, "x")] * 10))
    assert max(load.values()) - min(load.values()) <= 20


def test_shard_files(spark, tmp_path):
    docs = documents(spark, AWKWARD)
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(back.select("document.*").collect()) == Counter(docs.collect())
    assert back.select(F.countDistinct("shard")).first()[0] <= 3
