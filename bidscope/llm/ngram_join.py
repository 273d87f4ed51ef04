"""N-gram Jaccard join (operator 1): MinHash LSH forest and exact checks.

A text's set holds its runs of ``WORDS`` words (a shorter text: the run of
all its words).  Equal texts are one class, joined through a representative.
Each of ``TREES`` trees sorts the representatives by a string of minima, a
prefix of which is a node of the tree.  The join starts at prefixes of
``LENGTHS[0]`` minima in all trees and shortens them together: each length
checks the pairs that meet there for the first time.  What a length adds
tells what is still missing (a link of the threshold's similarity that was
missed at ``x`` is seen at ``y`` with a known chance); shortening ends when
the texts with a link still missing are at most ``1 - RECALL`` of all texts
with links.

Every pair that meets is verified on its whole texts' sets.  Nodes with the
same members are checked once, and a pair in the first tree where it meets.
A large node is dealt in blocks: a task checks one pair of blocks, by a
product of incidence matrices, and returns for each member its number of
links and one edge, never the pairs.  Links connect classes into groups.

Result: one row per document: ``class_id`` (least doc_id of its group),
``text_class`` (least doc_id with an equal text), ``n_links`` (other
documents at or above the threshold, copies one by one), ``n_text_links``
(other texts at or above it).

Defined results: null text counts as empty; texts without words are linked
to copies only; a null doc_id takes part, its rows just name no class unless
all others are null too; repeated rows are copies; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, materialize, read, split_words, string_array, text_of

WORDS = 5
THRESHOLD = Fraction(4, 5)
TREES = 16
# Prefix lengths, longest first.
LENGTHS = (6, 5, 4, 3)
RECALL = 0.999
# Members, and bytes of their texts, per block of a node; a task holds two.
BLOCK, BLOCK_BYTES = 768, 16 << 20
# Shingles per product of incidence matrices.
COLUMNS = 4096

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def shingles(column: pa.Array, n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all texts' word runs, repeats included; offsets)."""
    words, index, offsets = split_words(column)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64,
                    len(words))[index]
    count = np.diff(offsets)
    runs = np.where(count >= n_words, count - n_words + 1, np.minimum(count, 1))
    ends = np.concatenate([[0], np.cumsum(runs)])
    if len(h) >= n_words:
        rolled = h[:len(h) - n_words + 1].copy()
        for k in range(1, n_words):
            rolled = rolled * _STEP + h[k:len(h) - n_words + 1 + k]
    else:
        rolled = np.zeros(0, np.uint64)
    out = np.empty(ends[-1], np.uint64)
    full = count >= n_words
    start = offsets[:-1]
    at = np.repeat(np.where(full, start, 0) - ends[:-1], runs) + np.arange(ends[-1])
    whole = np.repeat(full, runs)
    out[whole] = rolled[at[whole]]
    for i in np.flatnonzero((count > 0) & ~full).tolist():
        value = int(count[i])
        for x in h[start[i]:offsets[i + 1]].tolist():
            value = (value * int(_STEP) + x) & 0xFFFFFFFFFFFFFFFF
        out[ends[i]] = value
    return _mixed(out), ends


def _nodes(runs: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each prefix length the node of every text in every tree."""
    depth = max(LENGTHS)
    factors = np.random.default_rng(11).integers(
        0, 1 << 63, TREES * depth, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    starts = ends[:-1]
    minima = np.empty((TREES, depth, len(starts)), np.uint64)
    for k, factor in enumerate(factors):
        minima[k // depth, k % depth] = np.minimum.reduceat(runs * factor, starts)
    out = {}
    path = np.repeat(np.arange(1, TREES + 1, dtype=np.uint64)[:, None], len(starts), 1) * _STEP
    for d in range(depth):
        path = _mixed(path * _STEP + (minima[:, d] >> np.uint64(16)))
        out[d + 1] = path.T.astype(np.int64)
    return [out[x] for x in LENGTHS]


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bytes, paths): the text's hash and size and, per prefix
    length, the nodes of its prefixes (null for texts without words)."""
    paths = pa.list_(pa.list_(pa.int64()))

    def sign(batches):
        for batch in batches:
            texts = string_array(batch.column("text"))
            found = []
            for first, last in byte_slices(texts):
                runs, ends = shingles(texts.slice(first, last - first))
                some = np.flatnonzero(np.diff(ends) > 0)
                rows = [None] * (last - first)
                if len(some):
                    levels = _nodes(runs, np.append(ends[some], ends[-1]))
                    for j, i in enumerate(some.tolist()):
                        rows[i] = [level[j] for level in levels]
                found += rows
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "key": batch.column("key"),
                                   "bytes": batch.column("bytes"), "paths": pa.array(found, paths)})

    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(text).alias("key"),
                       F.octet_length(text).cast("long").alias("bytes"),
                       text.alias("text")).mapInArrow(
        sign, "doc_id long, key binary, bytes long, paths array<array<long>>")


def _chance(length: int, similarity: float) -> float:
    return 1 - (1 - similarity ** length) ** TREES


class Item:
    """A representative in a node's block."""

    def __init__(self, row: dict):
        self.key, self.block, self.copies = row["key"], row["b"], row["copies"]
        self.nodes, self.before, self.text = row["nodes"], row["before"], row["text"]


def _linked(items: list[Item], node: int, across: bool) -> np.ndarray:
    """Which pairs of a block pair (i before j) this node has to report."""
    n = len(items)
    nodes = np.array([x.nodes for x in items], np.int64)
    check = np.triu(np.ones((n, n), bool), 1)
    if across:
        block = np.array([x.block for x in items])
        check &= block[:, None] != block[None]
    # The first tree in which a pair meets has to be this node's.
    met = np.zeros((n, n), bool)
    for t in range(nodes.shape[1]):
        same = nodes[:, t][:, None] == nodes[:, t][None]
        check &= ~(same & ~met & (nodes[:, t] != node)[:, None])
        met |= same
    if items[0].before is not None:
        before = np.array([x.before for x in items], np.int64)
        for t in range(before.shape[1]):
            check &= before[:, t][:, None] != before[:, t][None]
    if not check.any():
        return check
    runs, ends = shingles(pa.array([x.text for x in items], pa.large_string()))
    sets = [np.unique(runs[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    size = np.array([len(s) for s in sets])
    up, down = THRESHOLD.numerator, THRESHOLD.denominator
    check &= (np.minimum.outer(size, size) * down >= np.maximum.outer(size, size) * up)
    shared = np.zeros((n, n))
    if check.sum() <= 4 * n and n <= 64:
        for i, j in zip(*np.nonzero(check)):
            shared[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True,
                                           return_counts=True)
        owner = np.repeat(np.arange(n), size)
        # Only runs of two texts or more can be shared.
        number = np.cumsum(count > 1) - 1
        common = count[inverse] > 1
        owner, inverse = owner[common], number[inverse[common]]
        order = np.argsort(inverse, kind="stable")
        owner, inverse = owner[order], inverse[order]
        total = int((count > 1).sum())
        for first in range(0, total, COLUMNS):
            a, b = np.searchsorted(inverse, [first, first + COLUMNS])
            part = np.zeros((n, min(COLUMNS, total - first)), np.float32)
            part[owner[a:b], inverse[a:b] - first] = 1
            shared += part @ part.T
    return check & (shared * (up + down) >= up * np.add.outer(size, size))


def _report(items: list[Item], node: int, across: bool):
    """(key, other, texts, documents) of every item with a link: one edge to
    the root of what it is connected to here."""
    linked = _linked(items, node, across)
    if not linked.any():
        return
    linked |= linked.T
    copies = np.array([x.copies for x in items], np.int64)
    texts, documents = linked.sum(1), linked @ copies
    root = np.arange(len(items))
    while True:  # least index that can be reached
        lower = np.minimum(root, np.where(linked, root[None], len(items)).min(1))
        if (lower == root).all():
            break
        root = lower
    for i in np.flatnonzero(texts).tolist():
        yield items[i].key, items[root[i]].key, int(texts[i]), int(documents[i])


LINKS = "key binary, other binary, texts long, documents long"


def _checked(level: int, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of one prefix length.  ``members``: node, n, bytes and key."""
    blocks = members.withColumn("nb", F.greatest(
        F.ceil(F.col("n") / BLOCK), F.least(F.ceil(F.col("bytes") / BLOCK_BYTES), "n"))
        .cast("int")).withColumn(
        "b", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    dealt = blocks.select("node", "key", "b", F.explode(
        F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")).select(
        "node", "key", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    before = F.lit(None).cast("array<long>") if level == 0 else F.col("paths")[level - 1]
    rows = dealt.join(texts, "key").select(
        "node", "i", "j", "b", "key", "copies", F.col("paths")[level].alias("nodes"),
        before.alias("before"), "text")
    rows = rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "key")

    def check(batches):
        at, items = None, []

        def report():
            out = list(_report(items, at[0], at[1] != at[2])) if len(items) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 4, (
                    pa.binary(), pa.binary(), pa.int64(), pa.int64()))],
                names=["key", "other", "texts", "documents"])

        for batch in batches:
            for row in batch.to_pylist():
                here = row["node"], row["i"], row["j"]
                if here != at:
                    if len(items) > 1:
                        yield report()
                    at, items = here, []
                items.append(Item(row))
        if len(items) > 1:
            yield report()

    return rows.mapInArrow(check, LINKS)


def _spread(level: int, reps: DataFrame) -> DataFrame:
    return reps.where(F.col("paths").isNotNull()).select(
        "key", "bytes", F.posexplode(F.col("paths")[level]).alias("tree", "node"))


def _meeting(level: int, reps: DataFrame) -> DataFrame:
    """Keys in nodes of two members or more."""
    spread = _spread(level, reps).select("key", "node")
    shared = spread.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    return spread.join(shared, "node").select("key").distinct()


def _members(level: int, reps: DataFrame) -> DataFrame:
    """(node, n, bytes, key) of the nodes with two members or more; of nodes
    with the same members only the one in the first tree."""
    spread = _spread(level, reps)
    nodes = spread.groupBy("node").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("tree").alias("tree"),
        F.bit_xor(F.xxhash64("key")).alias("x"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where("n > 1")
    kept = nodes.groupBy("n", "bytes", "x", "y").agg(F.min(F.struct("tree", "node")).alias(
        "m")).select("n", "bytes", "m.node")
    return spread.select("node", "key").join(kept, "node")


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the least key that each key is connected to.  Every
    round takes the least label of all neighbours, then the label's label."""
    both = materialize(edges.select("key", "other").unionByName(
        edges.select(F.col("other").alias("key"), F.col("key").alias("other"))).distinct(),
        "join-edges")
    labels = materialize(both.groupBy("key").agg(F.min("other").alias("m")).select(
        "key", F.least("key", "m").alias("label")), "join-labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("other"), "label"), "other").groupBy(
            "key").agg(F.min("label").alias("m"))
        lower = labels.join(near, "key").select("key", F.col("label").alias("was"),
                                                F.least("label", "m").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("next"))
        lower = materialize(lower.join(jump, "label", "left").select(
            "key", "was", F.coalesce(F.least("label", "next"), "label").alias("label")),
            "join-labels")
        if lower.where("was <> label").isEmpty():
            return lower.select("key", "label")
        labels = lower.select("key", "label")


def join(docs: DataFrame, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id and key; classes: key, low, copies, class_key,
    class_id, texts, documents), both stored."""
    rows = materialize(signatures(docs), "join-signatures")
    reps = materialize(rows.groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("m"),
        F.count("*").alias("copies"), F.max("bytes").alias("bytes"),
        F.max("paths").alias("paths")).select(
        "key", F.col("m.doc_id").alias("low"), "copies", "bytes", "paths"), "join-classes")
    # Whole texts of the representatives that meet another at all; prefixes
    # longer than the shortest are only shared by these.
    wanted = reps.join(_meeting(len(LENGTHS) - 1, reps), "key")
    text = text_of()
    texts = docs.select(F.col("doc_id").cast("long").alias("low_id"), _key(text).alias("key"),
                        text.alias("text")).join(wanted, "key").where(
        F.col("low_id").eqNullSafe(F.col("low")))
    texts = materialize(texts.groupBy("key").agg(F.max(F.struct(
        "text", "copies", "bytes", "paths")).alias("x")).select("key", "x.*"), "join-texts")
    members = texts.select("key", "bytes", "paths")
    texts = texts.drop("bytes")
    found = None
    for level, length in enumerate(LENGTHS):
        links = materialize(_checked(level, _members(level, members), texts), "join-links")
        found = links if found is None else found.unionByName(links)
        if level:
            # Counted by texts: the links of one large group are many.
            new, total = (x.select("key").distinct().count() for x in (links, found))
            now, was = (_chance(x, float(THRESHOLD)) for x in (length, LENGTHS[level - 1]))
            if new * (1 - now) / (now - was) <= (1 - recall) * total:
                break
    label = components(found.where("key <> other").select("key", "other"))
    counts = found.groupBy("key").agg(F.sum("texts").alias("texts"),
                                      F.sum("documents").alias("documents"))
    classes = reps.drop("paths", "bytes").join(label, "key", "left").join(counts, "key", "left").select(
        "key", "low", "copies", F.coalesce("label", "key").alias("label"),
        F.coalesce("texts", F.lit(0)).alias("texts"),
        F.coalesce("documents", F.lit(0)).alias("documents"))
    groups = classes.groupBy("label").agg(F.min(F.struct(
        F.col("low").isNull().alias("none"), "low", "key")).alias("m")).select(
        "label", F.col("m.key").alias("class_key"), F.col("m.low").alias("class_id"))
    classes = materialize(classes.join(groups, "label").drop("label"), "join-result")
    return rows.select("doc_id", "key"), classes


def linked_documents(docs: DataFrame) -> DataFrame:
    """One row per document with its class and its number of links."""
    rows, classes = join(docs)
    return rows.join(classes, "key").select(
        "doc_id", "class_id", F.col("low").alias("text_class"),
        (F.col("copies") - 1 + F.col("documents")).alias("n_links"),
        F.col("texts").alias("n_text_links"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns: of each group the document
    with the least doc_id stays, once."""
    rows, classes = join(docs)
    stay = classes.where("key = class_key").select("key", "low")
    # How often the row that stays is repeated, with id and text.
    times = rows.join(stay, "key").where(F.col("doc_id").eqNullSafe(F.col("low"))).groupBy(
        "key", "low").agg(F.count("*").alias("times")).select(
        F.col("key").alias("k"), F.col("low").alias("l"), "times")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = docs.select(whole.alias("carry"), F.col("doc_id").cast("long").alias("i"),
                       _key(text_of()).alias("k")).join(times, "k").where(
        F.col("i").eqNullSafe(F.col("l")))
    # Only rows that repeat id and text need a choice.
    once = kept.where("times = 1").select("carry.*")
    again = kept.where("times > 1").dropDuplicates(["k"]).select("carry.*")
    return once.unionByName(again)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document."""
    return linked_documents(read(spark, sf_dir, "documents"))
