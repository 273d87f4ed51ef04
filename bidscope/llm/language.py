"""Language identification (operator 11) by compression.

For every learned language a raw-content zstandard dictionary is made of
text in it.  A text is cut into pieces of ``PIECE_BYTES``; each piece is
compressed with each dictionary, and the language whose dictionary gives the
fewest bytes over all pieces of the whole text is chosen.  Pieces keep the
dictionary in use all through a very long text (one stream would soon learn
the text itself) and bound memory.  Only letters count: text is lower-cased
and every run of other characters becomes one blank.

``score`` is the margin, the share by which the chosen language's size stays
below the next one's; below ``MIN_MARGIN`` the row is ``rejected``.  A learned
language alone has score 1.  Sizes that tie go to the language with more
training documents, then to the smaller name.

Learning: rows with a language whose crc32(doc_id as text) modulo 4 is not 2.
Of each language at most ``SAMPLE_DOCS`` documents, those with the smallest
hashes of their ids, give at most ``DOC_BYTES`` each (a stretch whose place
the id's hash chooses) until the dictionary holds ``DICTIONARY_BYTES``; a
language with less text has a smaller dictionary.  At most ``MAX_LANGUAGES``
are learned, more are an error: every text is compressed once per language.
That bounds what the driver holds and sends to tasks (16 MB).  Prediction is
one scan without a shuffle.  Language, source and id are no input of it.

Defined results: text that is null or has no letter is ``und`` with score 0,
not rejected; with nothing learned every text is ``und``; a null doc_id is
never learned from and not held out; rows that repeat a doc_id count once in
learning and are predicted one by one; empty table, no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import byte_slices, read, string_array, text_of

DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS = 400
DOC_BYTES = 4000
MAX_LANGUAGES = 256
PIECE_BYTES = 2048
MIN_MARGIN = 0.02
UNKNOWN = "und"
# Held out: rows whose CRC-32 of the id, modulo the first, is the second.
FOLDS, HELD = 4, 2

Learned = dict[str, bytes]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD,
                      F.lit(False))


def letters(texts: pa.Array) -> pa.Array:
    """Lower-cased letters (with their marks), runs of others as one blank."""
    lower = pc.utf8_lower(texts)
    return pc.utf8_trim(pc.replace_substring_regex(lower, r"[^\p{L}\p{M}]+", " "), " ")


def _training_rows(docs: DataFrame) -> DataFrame:
    place = F.xxhash64(F.col("doc_id").cast("long"))
    return docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"),
        place.alias("place"), text_of().alias("text"))


def training_sample(docs: DataFrame, counts: DataFrame, per_language: int) -> DataFrame:
    """(lang, place, text): at most ``per_language`` documents of each
    language, by the smallest hashes.  ``counts`` (lang, n) has at most
    ``MAX_LANGUAGES`` rows; it thins the rows to about four times the number
    wanted before anything is grouped or sorted."""
    share = F.least(F.lit(1.0), 4.0 * per_language / F.col("n"))
    near = F.pmod("place", F.lit(1 << 32)) < share * (1 << 32)
    rows = _training_rows(docs).join(F.broadcast(counts), "lang").where(near)
    rows = rows.groupBy("lang", "doc_id", "place").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 32)), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= per_language).select("lang", "rank", "place", "text")


def learn(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> Learned:
    """The dictionary of every language, the one with most documents first."""
    counts = _training_rows(docs).groupBy("lang").agg(
        F.count_distinct("doc_id").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    if not counts:
        return {}
    spark = docs.sparkSession

    def stretches(batches):
        for batch in batches:
            texts = letters(string_array(batch.column("text"))).to_pylist()
            plain = []
            for place, text in zip(batch.column("place").to_pylist(), texts):
                text = text.encode()
                first = place % max(1, len(text) - DOC_BYTES)
                plain.append(text[first:first + DOC_BYTES])
            yield pa.record_batch({"lang": batch.column("lang"), "rank": batch.column("rank"),
                                   "part": pa.array(plain, pa.binary())})

    table = spark.createDataFrame([(r.lang, r.n) for r in counts], "lang string, n long")
    parts = training_sample(docs, table, per_language).mapInArrow(
        stretches, "lang string, rank int, part binary").collect()
    found: dict[str, list[bytes]] = {}
    for row in sorted(parts, key=lambda r: (r.lang, r.rank)):
        found.setdefault(row.lang, []).append(bytes(row.part))
    order = sorted(counts, key=lambda r: (-r.n, r.lang))
    learned = {r.lang: b" ".join(dict.fromkeys(found.get(r.lang, [])))[:DICTIONARY_BYTES]
               for r in order}
    return learned


class Sizes:
    """Compressed sizes of texts under each language's dictionary."""

    def __init__(self, learned: Learned):
        self.compress = []
        for content in learned.values():
            options = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_GREEDY, window_log=17, chain_log=16, hash_log=16,
                search_log=4, min_match=4, target_length=16, write_content_size=0,
                write_checksum=0, write_dict_id=0)
            if len(content) >= 8:
                dictionary = zstandard.ZstdCompressionDict(
                    content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(compression_params=options)
            else:  # too short to be one
                dictionary = None
            self.compress.append(zstandard.ZstdCompressor(
                dict_data=dictionary, compression_params=options).compress)

    def __call__(self, text: bytes) -> list[int]:
        pieces = [text[k:k + PIECE_BYTES] for k in range(0, len(text), PIECE_BYTES)]
        return [sum([len(compress(p)) for p in pieces]) for compress in self.compress]


def _choose(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the smallest, first if tied; its margin) of every row."""
    best = sizes.argmin(axis=1)
    smallest = sizes[np.arange(len(sizes)), best]
    if sizes.shape[1] == 1:
        return best, np.ones(len(sizes))
    return best, 1.0 - smallest / np.partition(sizes, 1, axis=1)[:, 1]


def identify(docs: DataFrame, learned: Learned, min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row."""
    model = docs.sparkSession.sparkContext.broadcast(learned)

    def predicted(batches):
        sizes = Sizes(model.value)
        names = list(model.value)
        for batch in batches:
            texts = string_array(batch.column("text"))
            chosen, score = [], []
            for first, last in byte_slices(texts):
                part = texts.slice(first, last - first)
                known = pc.match_substring_regex(part, r"\p{L}").to_numpy(zero_copy_only=False)
                known &= bool(names)
                found = np.full(last - first, None, object)
                margin = np.zeros(last - first)
                rows = np.flatnonzero(known)
                if len(rows):
                    plain = letters(part.take(pa.array(rows))).to_pylist()
                    best, margin[rows] = _choose(np.array([sizes(t.encode()) for t in plain]))
                    found[rows] = [names[k] for k in best]
                chosen += found.tolist()
                score.append(margin)
            score = np.concatenate(score) if score else np.zeros(0)
            unknown = np.array([c is None for c in chosen], bool)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array([UNKNOWN if c is None else c for c in chosen], pa.string()),
                "score": pa.array(score),
                "rejected": pa.array((score < min_margin) & ~unknown)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       text_of().alias("text")).mapInArrow(
        predicted, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op11_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = read(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
