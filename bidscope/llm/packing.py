"""Best-fit packing (operator 6): documents into sequences of bounded length.

A document's ids (with an end id) are one piece, or, if longer than a
sequence, pieces of exactly that length and a last shorter one.  Pieces are
dealt into groups of bounded size; a group packs its own pieces: best fit by
decreasing length first, then local search.  The search takes the emptiest
bin and moves its pieces into other bins, or exchanges one for one, two for
one or one for two, always so that the fuller bin gains: the sum of squared
fills grows with each step, until the bin is empty or no step is left.  Work
is spread by groups; each group can waste part of one bin, which is a share
of 1 / (bins of a group) of the whole.

``pack_in_order`` keeps the order in which the documents stand (files by their
part numbers): pieces are numbered in that order, a group is a run of
consecutive numbers, and sequences are numbered by group and in a group by the
mean number of what they hold.  Sequences read in order of their ids therefore
hold, up to the end of each group, exactly the documents that stand there.
``pack_mixed`` does so with the order of mixing, for documents in any order.

Defined results: null text counts as empty (one end id, a piece of length
1); rows with a null or repeated doc_id are packed as rows of their own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import mixing
from .common import materialize, read, text_of
from .tokens import encoder, slices_of, with_end

CAPACITY = 2048
END_ID = 0
# Pieces packed together by one task; bounds its memory.
GROUP_PIECES = 8192
# Donor bins tried in a row without success before the search stops.
PATIENCE = 24

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None,
               end_id: int = END_ID, with_ids: bool = False, carry: dict | None = None) -> DataFrame:
    """The pieces of every document, with their ids when asked for, and the
    columns of ``carry`` (names to expressions) of the documents."""
    carried = docs.select(*[c.alias(name) for name, c in (carry or {}).items()]).schema.fields

    def cut(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            for rows, texts in slices_of(batch):
                ids, offsets = with_end(*encode(texts), end_id)
                size = np.diff(offsets)
                per = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                first = offsets[doc] + start
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a:4 * b])
                       for a, b in zip(first.tolist(), (first + length).tolist())]
                out = {"doc_id": rows.column("doc_id").take(pa.array(doc)),
                       "piece": pa.array(piece.astype(np.int32)),
                       "start": pa.array(start), "length": pa.array(length),
                       "ids_crc32": pa.array(np.array(crc, np.int64))}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.append(first, offsets[-1]).astype(np.int32)),
                        pa.array(ids.astype(np.int32)))
                for field in carried:
                    out[field.name] = rows.column(field.name).take(pa.array(doc))
                yield pa.record_batch(out)

    return docs.select(
        F.col("doc_id").cast("long"), text_of().alias("text"),
        *[c.alias(name) for name, c in (carry or {}).items()]).mapInArrow(
        cut, ", ".join([PIECES, *(["ids array<int>"] if with_ids else []),
                        *[f"{f.name} {f.dataType.simpleString()}" for f in carried]]))


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: the fullest bin that still takes it, longest first."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_free = 0  # bit f: a bin with f free places exists
    bins = 0
    out = np.empty(len(lengths), np.int64)
    sizes = lengths.tolist()
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[item]
        fitting = open_free >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                open_free &= ~(1 << free)
        else:
            at, free = bins, capacity
            bins += 1
        out[item] = at
        free -= size
        by_free[free].append(at)
        open_free |= 1 << free
    return out


class SwapSearch:
    """Empties bins by exchanges that raise the sum of squared fills."""

    def __init__(self, lengths: np.ndarray, bin_of: np.ndarray, capacity: int):
        self.size, self.bin_of, self.capacity = lengths, bin_of, capacity
        self.fill = np.bincount(bin_of, lengths).astype(np.int64)
        order = np.argsort(bin_of, kind="stable")
        self.items = [x.tolist() for x in np.split(
            order, np.cumsum(np.bincount(bin_of, minlength=len(self.fill)))[:-1])]

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Two pieces each of one underfull bin (neighbours in its list)."""
        left, right = [], []
        for at in np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist():
            inside = self.items[at]
            left += inside[:-1]
            right += inside[1:]
        return np.array(left, np.int64), np.array(right, np.int64)

    def _best(self, gain: np.ndarray, free: np.ndarray) -> tuple[int, int, bool]:
        """Of the exchanges that fit: (place, gain, whether it fills the bin),
        full bins first, then the largest gain."""
        fits = (gain > 0) & (gain <= free)
        if not fits.any():
            return -1, 0, False
        rank = np.where(fits, gain + (gain == free) * (self.capacity + 1), 0)
        at = int(rank.argmax())
        return at, int(gain[at]), bool(gain[at] == free[at])

    def _exchange(self, donor: int, out: list[int], into: int, back: list[int]) -> None:
        for item in out:
            self.items[donor].remove(item)
            self.items[into].append(item)
        for item in back:
            self.items[into].remove(item)
            self.items[donor].append(item)
        self.bin_of[out], self.bin_of[back] = into, donor
        moved = int(self.size[out].sum() - self.size[back].sum())
        self.fill[into] += moved
        self.fill[donor] -= moved

    def _step(self, donor: int, pairs: tuple[np.ndarray, np.ndarray]) -> bool:
        """The best exchange out of ``donor``, if there is one."""
        size, free = self.size, self.capacity - self.fill
        free[donor] = 0
        free[self.fill == 0] = 0
        own = self.items[donor]
        found = []  # (fills a bin, gain, out, into, back)
        for item in own:
            roomy = np.where(free >= size[item], free, self.capacity + 1)
            into = int(roomy.argmin())
            if roomy[into] <= self.capacity:
                found.append((True, int(size[item]), [item], into, []))
        if not found:
            item_free = free[self.bin_of]
            left, right = pairs
            same = (self.bin_of[left] == self.bin_of[right]) if len(left) else left
            pair_size, pair_free = size[left] + size[right], (free[self.bin_of[left]] * same)
            for k, item in enumerate(own):
                at, gain, full = self._best(size[item] - size, item_free)
                if at >= 0:
                    found.append((full, gain, [item], int(self.bin_of[at]), [at]))
                if len(left):
                    at, gain, full = self._best(size[item] - pair_size, pair_free)
                    if at >= 0:
                        found.append((full, gain, [item], int(self.bin_of[left[at]]),
                                      [int(left[at]), int(right[at])]))
                for other in own[k + 1:k + 4]:
                    at, gain, full = self._best(size[item] + size[other] - size, item_free)
                    if at >= 0:
                        found.append((full, gain, [item, other], int(self.bin_of[at]), [at]))
        if not found:
            return False
        _, _, out, into, back = max(found, key=lambda x: x[:2])
        self._exchange(donor, out, into, back)
        return True

    def run(self, patience: int = PATIENCE) -> np.ndarray:
        least = -(-int(self.size.sum()) // self.capacity)
        failed: set[int] = set()
        while len(failed) < patience and int((self.fill > 0).sum()) > least:
            standing = np.where(self.fill > 0, self.fill, self.capacity)
            if failed:
                standing[list(failed)] = self.capacity
            donor = int(standing.argmin())
            if standing[donor] >= self.capacity:
                break
            pairs = self._pairs()
            while self.fill[donor] and self._step(donor, pairs):
                pass
            if self.fill[donor]:
                failed.add(donor)
        return self.bin_of


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each length: full ones alone, the others packed and improved."""
    bin_of = np.arange(len(lengths))
    short = np.flatnonzero(lengths < capacity)
    if len(short):
        rest = lengths[short]
        bin_of[short] = len(lengths) + SwapSearch(rest, best_fit(rest, capacity), capacity).run()
    return np.unique(bin_of, return_inverse=True)[1]


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
         number: str | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored ``pieces`` (read from a
    table, so that a retried task sees the same rows in the same order).  With
    a column ``number`` (gapless from 0), groups and sequences follow it."""
    count = pieces.count()
    groups = max(1, -(-count // group_pieces))
    names = [c for c in pieces.columns if c != number]

    def place(group: pd.DataFrame) -> pd.DataFrame:
        if number:
            group = group.sort_values(number, ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        bin_of = pack_lengths(lengths, capacity)
        if number:
            at = group[number].to_numpy(np.int64)
            mean = np.bincount(bin_of, (at - at[0]) * lengths) / np.bincount(bin_of, lengths)
            bin_of = np.argsort(np.argsort(mean, kind="stable"), kind="stable")[bin_of]
        order = np.argsort(bin_of, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.searchsorted(bin_of[order], bin_of[order])
        offset = np.empty(len(group), np.int64)
        offset[order] = ends - lengths[order] - (ends - lengths[order])[first]
        out = group[names].copy()
        out["sequence_id"] = (np.int64(group["deal"].iloc[0]) << 32) + bin_of
        out["offset"] = offset
        return out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields
                       if f.name != number)
    dealt = pieces.withColumn(
        "deal", F.expr(f"({number} * {groups}L) div {max(1, count)}L") if number else
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("deal").applyInPandas(
        place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None,
                   with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their sequence and their place in it."""
    return pack(materialize(cut_pieces(docs, capacity, vocabulary, with_ids=with_ids), "pieces"),
                capacity)


def pack_mixed(docs: DataFrame, target: dict[str, float] | None = None,
               capacity: int = CAPACITY, vocabulary: str | None = None,
               with_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of ``docs`` packed in the order that mixing gives the documents.
    The order comes from ids, sources and hashes of texts, so ``docs`` may
    stand in any order; of the texts, only their pieces are moved."""
    names = [x.split()[0] for x in PIECES.split(", ")] + (["ids"] if with_ids else [])
    cut = materialize(cut_pieces(docs, capacity, vocabulary, with_ids=with_ids, carry={
        "source": F.col("source").cast("string"), "text_md5": mixing.text_hash(),
        "row": F.monotonically_increasing_id()}), "pieces")
    sizes = cut.groupBy("row").agg(F.count("*").alias("n"))
    rows = cut.where("piece = 0").select("doc_id", "source", "text_md5", "row").join(sizes, "row")
    placed = mixing.interleave(rows, target, carry=F.struct("row", "n"),
                               text_md5=F.col("text_md5"))
    first = mixing.with_position(placed, F.col("carry.n")).select("carry.row", "position")
    numbered = cut.join(first, "row").select(
        *names, (F.col("position") + F.col("piece")).alias("number"))
    return pack(materialize(numbered, "numbered-pieces"), capacity, group_pieces, "number")


def pack_in_order(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None,
                  with_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of ``docs`` packed in the order in which the rows stand: of
    tables read, the order of files (by part number, then name) and of the rows
    in each; else that of partitions."""
    names = [x.split()[0] for x in PIECES.split(", ")] + (["ids"] if with_ids else [])
    # Which task reads a block does not matter: blocks are put in order here.
    stand = {"file": F.input_file_name(), "block": F.input_file_block_start()}
    try:
        docs.select(*stand.values())
    except AnalysisException as e:
        if "MULTI_SOURCES" not in str(e):
            raise
        # Rows of a join stand in no file.
        stand = {"file": F.lit(""), "block": F.lit(-1).cast("long")}
    cut = materialize(cut_pieces(docs, capacity, vocabulary, with_ids=with_ids, carry=stand)
                      .withColumn("at", F.monotonically_increasing_id()), "pieces")
    block = ["file", "block", "task"]
    cut = cut.withColumn("task", F.shiftright("at", 33))
    part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    before = Window.orderBy(part, *block).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each block of a file.
    first = cut.groupBy(*block).agg(F.count("*").alias("n"), F.min("at").alias("first")).select(
        *block, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = cut.join(first, block).select(*names, (F.col("at") + F.col("shift")).alias("number"))
    return pack(materialize(numbered, "numbered-pieces"), capacity, group_pieces, "number")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (``packed`` with ids): one row each,
    ids in order of their offsets, at most a sequence's length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return pack_documents(read(spark, sf_dir, "documents"))
