"""Phrase collocations (operator 12), counted by quotient filters.

Phrases are runs of two to five words inside pieces of text, counted per
language.  A phrase seen ``MIN_COUNT`` times consists of words, and of word
pairs, seen as often, so three counts follow each other, each exact:

1. words, by one aggregate; frequent ones get dense ids;
2. pairs of frequent words;
3. runs of three to five words all of whose pairs can be frequent.  Which can
   is told by a bit table over the mixed pairs, of at most ``2 **
   TABLE_BITS`` bits: it may let others through, which only costs counting.

Pairs and longer runs are packed word ids in counting quotient filters
(``quotient_filter``).  A task keeps one sorted filter per length, merges into
it and writes it out by shards of the key space when it holds ``ENTRIES``
keys; shards, numbered by the leading bits of the mixed keys, are merged after
one shuffle.  There are so many shards that the keys of one are bounded
whatever the input, and a phrase that fills a third of all text is one entry
of each filter.

The words' ids reach the tasks as a broadcast dictionary while it has at most
``DICTIONARY_WORDS`` words, and by a join of single words above; both give the
same ids.  Keys have at most 128 bits: more than 33 million (language, word)s
that are each seen ``MIN_COUNT`` times are an error.

A phrase's score is the lowest over its cuts of ``1000 * a * n / (l * r)``,
worked out with 38-digit decimals.  A candidate that is part of a longer one
with the same count is dropped: any longer one that holds it implies one that
is longer by one word, so only those are looked up.

Defined results: null text counts as empty, null language as ``und``; rows
without doc_id count like others, repeated rows as often as they stand; texts
without words give nothing; very long texts are cut at pieces only, and one
without any break is one run; ties are ranked by the phrase's bytes; empty
table, no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .common import byte_slices, materialize, read, string_array, text_of

MIN_COUNT = 100
TOP = 2000
LONGEST = 5
COVER_PERCENT = 100
DICTIONARY_WORDS = 1 << 20
TABLE_BITS = 29
# Keys a task holds per length before it writes its filter out.
ENTRIES = 1 << 21
# Words of text per shard, one key or fewer each.
SHARD_WORDS = 1 << 22
# Word ids per stored row; runs longer than this stay whole.
ROW_IDS = 1 << 11
NO_LANGUAGE = "und"

# Byte classes: word, blank between words, break between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a slice of rows: ``distinct`` words, and per occurrence
    its ``word``, ``row`` and ``piece`` (numbered through the slice)."""

    def __init__(self, texts: pa.Array):
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        data = np.zeros(0, np.uint8)
        if len(ends) and ends[-1]:
            start = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]
            data = np.frombuffer(texts.buffers()[2], np.uint8)[start:start + ends[-1]]
        # A break behind every row keeps rows apart.
        row_of_break = np.zeros(len(data) + len(lengths), np.uint8)
        marks = ends + np.arange(len(lengths))
        row_of_break[marks] = 1
        plain = np.full(len(row_of_break), 0x0A, np.uint8)
        plain[row_of_break == 0] = _LOWER[data]
        kind = _KIND[plain]
        inside = kind == 0
        first = np.flatnonzero(inside[:-1] < inside[1:]) + 1
        if len(inside) and inside[0]:
            first = np.concatenate([[0], first])
        last = np.flatnonzero(inside[:-1] > inside[1:]) + 1
        size = last - first
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        array = pa.LargeStringArray.from_buffers(
            len(size), pa.py_buffer(offsets), pa.py_buffer(plain[inside].tobytes()))
        coded = array.dictionary_encode()
        self.distinct = coded.dictionary
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.searchsorted(marks, first, "right")
        breaks = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(breaks, first)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, list[str]]]:
    """(texts, language number of every row, languages) of each byte slice."""
    texts = string_array(batch.column("text"))
    coded = batch.column("lang").dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for first, last in byte_slices(texts):
        yield texts.slice(first, last - first), number[first:last], coded.dictionary.to_pylist()


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                       text_of().alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): every word of every language."""

    def count(batches):
        for batch in batches:
            for texts, lang, names in _slices(batch):
                words = Words(texts)
                size = max(1, len(words.distinct))
                pair, n = np.unique(lang[words.row] * size + words.word, return_counts=True)
                yield pa.record_batch({
                    "lang": pa.array([names[k] for k in (pair // size).tolist()], pa.string()),
                    "word": words.distinct.take(pa.array(pair % size)).cast(pa.string()),
                    "n": pa.array(n, pa.int64())})

    return _plain(docs).mapInArrow(count, "lang string, word string, n long").groupBy(
        "lang", "word").agg(F.sum("n").alias("n"))


def with_ids(frequent: DataFrame, n_words: int) -> DataFrame:
    """(lang, word, n, id): ids from 1, without a hole, from the rows alone:
    numbered within hash buckets of about 100,000 words."""
    buckets = 1 + n_words // 100_000
    rows = frequent.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).withColumn(
        "before", F.sum("size").over(Window.orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, -1))).select(
        "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return rows.withColumn("place", place).join(sizes, "bucket").select(
        "lang", "word", "n", (F.col("before") + F.col("place")).alias("id"))


def _runs(ids: np.ndarray, apart: np.ndarray) -> Iterator[bytes]:
    """Stored rows of the runs of two and more neighbouring frequent words.
    ``ids``: 0 for other words; ``apart``: not in one piece with the word
    before.  Runs follow each other with a 0 between."""
    if not len(ids):
        return
    cut = apart | (ids == 0)
    cut[0] = True
    cut[1:] |= ids[:-1] == 0
    begins = np.flatnonzero(cut)
    sizes = np.diff(np.concatenate([begins, [len(ids)]]))
    keep = (sizes > 1) & (ids[begins] > 0)
    # Every kept run gets one place more, for the 0 behind it.
    ends = np.cumsum(sizes[keep] + 1)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    spread = np.ones(len(out), bool)
    spread[ends - 1] = False
    out[spread] = ids[np.repeat(keep, sizes)]
    first = 0
    while first < len(out):
        at = int(np.searchsorted(ends, first + ROW_IDS, "right"))
        last = int(ends[max(at - 1, int(np.searchsorted(ends, first, "right")))])
        yield out[first:last].astype("<i4").tobytes()
        first = last


def encoded(docs: DataFrame, dictionary: DataFrame, n_words: int,
            broadcast_words: int = DICTIONARY_WORDS) -> DataFrame:
    """(ids): the runs of frequent words of all texts as little-endian 32-bit
    ids, 0 between runs."""
    if n_words > broadcast_words:
        return _encoded_by_join(docs, dictionary)
    # At most ``broadcast_words`` words; a word holds no blank.
    known = dictionary.select(F.concat_ws(" ", "lang", "word").alias("key"), "id").toArrow()
    model = docs.sparkSession.sparkContext.broadcast(
        (known.column("key").combine_chunks(), known.column("id").to_numpy()))

    def encode(batches):
        keys, numbers = model.value
        numbers = np.concatenate([numbers, [0]])
        for batch in batches:
            for texts, lang, names in _slices(batch):
                words = Words(texts)
                if not len(words.word):
                    continue
                size = len(words.distinct)
                pair, where = np.unique(lang[words.row] * size + words.word, return_inverse=True)
                spelled = pc.binary_join_element_wise(
                    pa.array(names, pa.string()).take(pa.array(pair // size)),
                    words.distinct.take(pa.array(pair % size)).cast(pa.string()), " ")
                at = pc.index_in(spelled, value_set=keys.cast(pa.string()))
                ids = numbers[pc.fill_null(at, -1).to_numpy(zero_copy_only=False)][where]
                apart = np.diff(words.piece, prepend=-1) != 0
                yield pa.record_batch({"ids": pa.array(_runs(ids, apart), pa.binary())})

    return _plain(docs).mapInArrow(encode, "ids binary")


def _encoded_by_join(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same from single words joined with the dictionary."""
    rows = materialize(_plain(docs).withColumn("row", F.monotonically_increasing_id()),
                       "phrases-rows")

    def spell(batches):
        for batch in batches:
            number = batch.column("row").to_numpy()
            done = 0
            for texts, lang, names in _slices(batch):
                words = Words(texts)
                spelled = words.distinct.take(pa.array(words.word)).cast(pa.string())
                apart = np.diff(words.piece, prepend=-1) != 0
                # One place more at every break: only neighbours are one apart.
                place = np.arange(len(words.word)) + np.cumsum(apart)
                named = pa.array([names[k] for k in lang[words.row].tolist()], pa.string())
                row = number[done:done + len(texts)][words.row]
                done += len(texts)
                for first in range(0, len(place), 1 << 16):
                    part = slice(first, first + (1 << 16))
                    yield pa.record_batch({
                        "row": pa.array(row[part]), "place": pa.array(place[part]),
                        "lang": named[part], "word": spelled[part]})

    words = rows.mapInArrow(spell, "row long, place long, lang string, word string")
    texts = words.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).groupBy(
        "row").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("x")).select(
        F.col("x.place").alias("place"), F.col("x.id").alias("id"))

    def join(batches):
        for batch in batches:
            out = []
            for place, ids in zip(batch.column("place"), batch.column("id")):
                place, ids = place.values.to_numpy(), ids.values.to_numpy()
                apart = np.diff(place, prepend=-1) != 1
                out += _runs(ids, apart)
            yield pa.record_batch({"ids": pa.array(out, pa.binary())})

    return texts.mapInArrow(join, "ids binary")


def windows(ids: np.ndarray, n: int) -> list[np.ndarray]:
    """The columns of all windows of ``n`` ids without a 0."""
    if len(ids) < n:
        return [np.zeros(0, np.int64)] * n
    columns = [ids[k:len(ids) - n + 1 + k] for k in range(n)]
    whole = columns[0] > 0
    for column in columns[1:]:
        whole = whole & (column > 0)
    return [column[whole] for column in columns]


def without_rare_pairs(ids: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """``ids`` with a 0 put in at every pair that is not in the bit table."""
    if len(ids) < 2:
        return ids
    inner = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    where = pair_place(ids[inner], ids[inner + 1], bits, len(table).bit_length() + 2)
    rare = table[where >> 3] >> (where & 7).astype(np.uint8) & 1 == 0
    return np.insert(ids, inner[rare] + 1, 0)


def pair_place(left: np.ndarray, right: np.ndarray, bits: int, table_bits: int) -> np.ndarray:
    """A pair's place in a table of ``2 ** table_bits`` bits."""
    half = qf.half_bits(bits, 2)
    high, low = qf.permute(*qf.pack([left, right], bits), half)
    mixed = ((high << np.uint64(64 - half)) ^ (low << np.uint64(64 - half) >> np.uint64(half % 64))
             if half < 64 else high)
    return (mixed >> np.uint64(64 - table_bits)).astype(np.int64)


class Counter:
    """One task's filters, by length."""

    def __init__(self, bits: int, lengths: tuple[int, ...], shard_bits: int):
        self.bits, self.lengths, self.shard_bits = bits, lengths, shard_bits
        self.raw: dict[int, list] = {n: [] for n in lengths}
        self.held = dict.fromkeys(lengths, 0)
        self.sums: dict[int, qf.Counts | None] = dict.fromkeys(lengths)

    def _bits_of_shard(self, n: int) -> int:
        return min(self.shard_bits, qf.half_bits(self.bits, n))

    def add(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for n in self.lengths:
            columns = windows(ids, n)
            self.raw[n].append(columns)
            self.held[n] += len(columns[0])
            if self.held[n] >= ENTRIES:
                self._settle(n)
                if len(self.sums[n]) >= ENTRIES:
                    yield self._out(n)

    def _settle(self, n: int) -> None:
        half = qf.half_bits(self.bits, n)
        columns = [np.concatenate(c) for c in zip(*self.raw[n])]
        self.raw[n], self.held[n] = [], 0
        if len(columns[0]):
            fresh = qf.count(*qf.permute(*qf.pack(columns, self.bits), half), half)
            old = self.sums[n]
            self.sums[n] = fresh if old is None else qf.merge([old, fresh])

    def _out(self, n: int) -> pa.RecordBatch:
        counts, self.sums[n] = self.sums[n], None
        shard_bits = self._bits_of_shard(n)
        ends = qf.shard_ends(counts, shard_bits)
        full = np.flatnonzero(np.diff(ends))
        return pa.record_batch({
            "length": pa.array(np.full(len(full), n, np.int32)), "shard": pa.array(full, pa.int64()),
            "filter": pa.array([qf.encode(counts.slice(ends[k], ends[k + 1]), shard_bits)
                                for k in full], pa.binary())})

    def rest(self) -> Iterator[pa.RecordBatch]:
        for n in self.lengths:
            if self.raw[n]:
                self._settle(n)
            if self.sums[n] is not None and len(self.sums[n]):
                yield self._out(n)


def count_runs(runs: DataFrame, bits: int, lengths: tuple[int, ...], n_words: int,
               min_count: int, table: bytes | None = None) -> DataFrame:
    """(ids, n): the runs of ``lengths`` words seen ``min_count`` times."""
    shard_bits = max(0, (n_words // SHARD_WORDS).bit_length())
    sent = None if table is None else runs.sparkSession.sparkContext.broadcast(table)

    def count(batches):
        counter = Counter(bits, lengths, shard_bits)
        pairs = None if sent is None else np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for row in batch.column("ids"):
                ids = np.frombuffer(row.as_buffer(), "<i4")
                if pairs is not None:
                    ids = without_rare_pairs(ids, pairs, bits)
                yield from counter.add(ids)
        yield from counter.rest()

    def add_up(key: tuple[pa.Scalar, ...],
               filters: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = key[0].as_py()
        parts, held, total = [], 0, 0
        for batch in filters:
            for row in batch.column("filter"):
                parts.append(qf.decode(row.as_py()))
                held += len(parts[-1])
                # Merged when as many keys came as the sum holds.
                if held - total >= max(total, ENTRIES):
                    parts = [qf.merge(parts)]
                    held = total = len(parts[0])
        total = qf.merge(parts)
        keep = total.n >= min_count
        high, low = qf.restore(total.high[keep], total.low[keep], total.half)
        ids = np.stack(qf.unpack(high, low, bits, n), axis=1)
        yield pa.record_batch({
            "ids": pa.ListArray.from_arrays(
                pa.array(np.arange(0, ids.size + 1, n), pa.int32()), pa.array(ids.reshape(-1))),
            "n": pa.array(total.n[keep], pa.int64())})

    filters = runs.mapInArrow(count, "length int, shard long, filter binary")
    return filters.groupBy("length", "shard").applyInArrow(add_up, "ids array<bigint>, n long")


def pair_table(pairs: DataFrame, bits: int, n_pairs: int) -> bytes:
    """The bit table of the frequent pairs: 16 bits per pair as long as that
    is no more than ``2 ** TABLE_BITS`` bits (64 MB)."""
    table_bits = min(TABLE_BITS, max(16, (16 * n_pairs).bit_length()))

    def places(batches):
        for batch in batches:
            ids = batch.column("ids").flatten().to_numpy().reshape(-1, 2)
            yield pa.record_batch({"place": pa.array(
                pair_place(ids[:, 0], ids[:, 1], bits, table_bits))})

    def block(key: tuple[pa.Scalar, ...],
              batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(8192, bool)
        for batch in batches:
            own[batch.column("place").to_numpy() & 8191] = True
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int64()),
                               "bits": pa.array([np.packbits(own, bitorder="little").tobytes()],
                                                pa.binary())})

    rows = pairs.mapInArrow(places, "place long").distinct().withColumn(
        "block", F.shiftright("place", 13)).groupBy("block").applyInArrow(
        block, "block long, bits binary").collect()
    table = bytearray(1 << (table_bits - 3))
    for r in rows:
        table[r.block << 10:(r.block + 1) << 10] = r.bits
    return bytes(table)


def _score() -> Column:
    wide = "cast({} as decimal(19,0))".format
    return F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP,
                 broadcast_words: int = DICTIONARY_WORDS) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n,
    score."""
    words = materialize(word_counts(docs), "phrases-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= min_count)
    known, n_words = words.agg(F.count(F.when(F.col("n") >= min_count, 1)),
                               F.coalesce(F.sum("n"), F.lit(0))).first()
    dictionary = materialize(with_ids(frequent, known), "phrases-dictionary")
    bits = max(1, int(known).bit_length())
    runs = materialize(encoded(docs, dictionary, known, broadcast_words), "phrases-runs")
    pairs = materialize(count_runs(runs, bits, (2,), n_words, min_count), "phrases-pairs")
    table = pair_table(pairs, bits, pairs.count())
    longer = count_runs(runs, bits, tuple(range(3, LONGEST + 1)), n_words, min_count, table)
    found = materialize(pairs.unionByName(longer), "phrases-found")
    return _ranked(found, dictionary, totals, top)


def _ranked(found: DataFrame, dictionary: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """``found`` (ids, n) holds every run of two and more words seen often."""
    size = F.size("ids")
    all_counts = found.unionByName(dictionary.select(F.array("id").alias("ids"), "n"))
    # Parts of a longer phrase with the same count.
    parts = found.where(size > 2).select("n", F.explode(F.array(
        F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"))
    longest = parts.groupBy("ids").agg(F.max("n").alias("longer"))
    kept = found.join(longest, "ids", "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < COVER_PERCENT * F.col("n"))).select(
        "ids", F.col("n").alias("a"))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "*", F.slice("ids", F.lit(1), F.col("k")).alias("left"),
        F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    cuts = cuts.join(all_counts.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left")
    cuts = cuts.join(all_counts.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right")
    # Every word of a phrase is of one language: that of the first.
    lang = dictionary.select(F.col("id").alias("head"), "lang").join(totals, "lang")
    cuts = cuts.withColumn("head", F.element_at("ids", 1)).join(lang, "head")
    best = cuts.withColumn("score", _score()).groupBy("ids").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "n", "lang")).alias("x")).select("ids", "x.*")
    # Spell the phrases out.
    spelled = best.select("*", F.posexplode("ids").alias("at", "id")).join(
        dictionary.select("id", "word"), "id").groupBy("ids", "lang", "a", "l", "r", "n", "score").agg(
        F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelled = spelled.withColumn("phrase", F.array_join("w.word", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return spelled.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[
            F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


def op12_quotient_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of every language of the documents."""
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH piece AS (
  SELECT lang, row_number() OVER () AS pid,
    list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
total AS (SELECT lang, sum(len(w)) AS n FROM piece GROUP BY lang),
gram AS (
  SELECT lang, len, w[i:i + len - 1] AS g, count(*) AS f
  FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i
    FROM piece, (SELECT unnest([1, 2, 3, 4, 5]) AS len))
  GROUP BY ALL HAVING count(*) >= 100),
part AS (
  SELECT DISTINCT lang, f, g[s:e] AS g
  FROM (SELECT lang, f, g, s, unnest(range(s + 1, len + 1)) AS e, len
    FROM (SELECT lang, f, g, len, unnest(range(1, len)) AS s FROM gram WHERE len > 2))
  WHERE e - s + 1 < len),
kept AS (
  SELECT lang, len, g, f AS a FROM gram WHERE len > 1 AND NOT EXISTS (
    SELECT 1 FROM part WHERE part.lang = gram.lang AND part.g = gram.g
      AND 100 * part.f >= 100 * gram.f)),
cut AS (
  SELECT k.lang, k.g, k.a, c.k, x.f AS l, y.f AS r, t.n,
    (1000::HUGEINT * k.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM kept k JOIN (SELECT unnest([1, 2, 3, 4]) AS k) c ON c.k < k.len
  JOIN gram x ON x.lang = k.lang AND x.g = k.g[1:c.k]
  JOIN gram y ON y.lang = k.lang AND y.g = k.g[c.k + 1:]
  JOIN total t ON t.lang = k.lang),
best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (
    PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
  score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
