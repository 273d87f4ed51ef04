"""Quoted CSV cut into records in parallel.

Files are read as lines of raw bytes, so every file splits at any size of
block, whatever newlines its quoted fields hold and whatever its encoding.

A line is a function of the state it starts in (outside or inside a quoted
field) to the state it ends in: the same state, the other one, or always one
and the same.  Such functions chain in any grouping, like prefix sums, so one
aggregate gives the function of each block, a window over the blocks gives
the state that each block starts in, and the records are then cut block by
block in one scan in file order.  Records that cross a block's edge leave
fragments.  Where there are any, what is cut is written once to the scratch
folder, so headers and fragments are taken from there and no file is cut again.

The same aggregate (``block_facts``) tells whether a file is valid UTF-8 and
what its first line is; blank lines outside quotes are skipped as a CSV
reader does.  Only hashes of the few exceptional blocks and files reach the
tasks: blocks that start inside a field (8 bytes per block), files that are
not UTF-8 and files with another header than the first.

Lines end at ``\\n`` (a ``\\r`` before it is dropped outside quotes).  A quote
opens a field only at its start; quotes elsewhere are text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialize

BOM = b"\xef\xbb\xbf"
# States between two quotes of a line.
_OUTSIDE, _INSIDE, _CLOSED, _START = 0, 1, 2, 3


def _ends_inside(segments: Column, start: int) -> Column:
    """Whether a line ends inside a quoted field; ``segments``: its text
    before each of its quotes."""
    def step(state: Column, before: Column) -> Column:
        opens = before.endswith(",")
        fresh = F.when(opens, _INSIDE).otherwise(_OUTSIDE)
        return (F.when(state == _INSIDE, _CLOSED)
                 .when((state != _OUTSIDE) & (before == ""), _INSIDE).otherwise(fresh))
    return F.aggregate(segments, F.lit(start), step) == _INSIDE


def raw_lines(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False,
              pattern: str | None = None) -> DataFrame:
    """path, block, line (bytes), and where the line ends when it starts
    outside (``from_out``) or inside (``from_in``) a quoted field."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(paths)
    # A byte that is no UTF-8 would swallow the quote behind it.
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    parts = F.split(text, '"')
    before = F.slice(parts, F.lit(1), F.size(parts) - 1)
    quoted = F.contains(text, F.lit('"'))
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), "value",
        F.when(quoted, _ends_inside(before, _START)).otherwise(False).alias("from_out"),
        F.when(quoted, _ends_inside(before, _INSIDE)).otherwise(True).alias("from_in"))


def block_facts(lines: DataFrame) -> DataFrame:
    """One row per (path, block): ``utf8``, ``opens`` (a line that starts
    outside ends inside), the block's function (``fixed``: the state it always
    ends in, if any; ``swaps``: 1 if it then changes state) and ``first``, the
    first line that is not blank, with ``first_opens``."""
    at = F.monotonically_increasing_id()
    rows = lines.select("*", at.alias("at"))
    fixed = F.col("from_out") == F.col("from_in")
    blank = F.col("value").isin("", "\r")
    facts = rows.groupBy("path", "block").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or("from_out").alias("opens"),
        F.max(F.when(fixed, F.struct("at", F.col("from_out").alias("state")))).alias("last"),
        F.collect_list(F.when(F.col("from_out") & ~F.col("from_in"), F.col("at"))).alias("swap"),
        F.min(F.when(~blank, F.struct("at", F.col("value").cast("binary").alias("line"),
                                      F.col("from_out").alias("opens")))).alias("first"))
    after = F.filter("swap", lambda x: F.col("last").isNull() | (x > F.col("last.at")))
    return facts.select("path", "block", "utf8", "opens", F.col("last.state").alias("fixed"),
                        (F.size(after) % 2).alias("swaps"), F.col("first.line").alias("first"),
                        F.col("first.opens").alias("first_opens"))


def inside_blocks(facts: DataFrame) -> DataFrame:
    """(path, block) of the blocks that start inside a quoted field."""
    order = Window.partitionBy("path").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swaps = facts.withColumn("turned", F.sum("swaps").over(upto))
    # The state after a block is its ``fixed`` turned ``swaps`` times; taken
    # back by all turns so far, it can be carried over the blocks behind it.
    base = F.when(F.col("fixed").isNotNull(),
                  (F.col("fixed").cast("int") + F.col("turned") + F.col("swaps")) % 2)
    states = swaps.withColumn("base", base).withColumn(
        "ends", (F.coalesce(F.last("base", True).over(upto), F.lit(0)) + F.col("turned")) % 2)
    return states.withColumn("starts", F.lag("ends", 1, 0).over(order)).where(
        "starts = 1").select("path", "block")


def _key(*columns: str) -> Column:
    return F.xxhash64(*columns)


class Cutter:
    """Cuts the lines of one task, in file order, into records."""

    def __init__(self, inside: np.ndarray, late: dict[int, int]):
        self.inside, self.late = set(inside.tolist()), late
        self.file = self.block = None
        self.open: list[bytes] = []

    def _emit(self, head: bool, tail: bool, text: bytes) -> None:
        header = False
        if not head:
            if text in (b"", b"\r") and not tail:
                return
            header = self.wants_header
            self.wants_header = False
            if header:
                return self._keep(head, tail, text, True)
        self._keep(head, tail, text, header)

    def _keep(self, head: bool, tail: bool, text: bytes, header: bool) -> None:
        self.out.append((self.file, self.block, self.row, head, tail, header, text))
        self.row += 1

    def finish(self) -> None:
        """The block is over: its open record is a fragment."""
        if self.block is not None and (self.open or self.head):
            self._emit(self.head, not self.head, b"\n".join(self.open))
        self.open, self.head = [], False

    def _begin(self, file: int, block: int, key: int) -> None:
        self.finish()
        self.file, self.block, self.row = file, block, 0
        self.head = key in self.inside
        self.wants_header = block == self.late.get(file, 0)

    head = wants_header = False
    row = 0
    out: list = []

    def batch(self, file: np.ndarray, block: np.ndarray, key: np.ndarray, lines: pa.Array,
              from_out: np.ndarray, from_in: np.ndarray) -> list:
        self.out = []
        n = len(file)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else []
        ends = [*starts[1:], n] if n else []
        for first, last in zip(starts, ends):
            if (int(file[first]), int(block[first])) != (self.file, self.block):
                self._begin(int(file[first]), int(block[first]), int(key[first]))
            self._stretch(lines.slice(first, last - first), from_out[first:last],
                          from_in[first:last])
        return self.out

    def _stretch(self, lines: pa.Array, from_out: np.ndarray, from_in: np.ndarray) -> None:
        """Lines of one block: states by chaining, then whole records at once."""
        n = len(lines)
        state = bool(self.open) or self.head
        # States after each line: the last fixed one, turned by later swaps.
        turned = np.cumsum(from_out & ~from_in)
        fixed = from_out == from_in
        place = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))
        base = np.where(place >= 0, from_out[place] ^ (turned[place] & 1).astype(bool), state)
        after = base ^ (turned & 1).astype(bool)
        begin = np.concatenate([[not state], ~after[:-1]])
        first = np.flatnonzero(begin)
        text = lines.to_pylist()
        done = int(first[0]) if len(first) else n
        if state:
            self.open += text[:done]
            if len(first) or not after[-1]:
                self._emit(self.head, False, b"\n".join(self.open))
                self.open, self.head = [], False
        if not len(first):
            return
        last = np.concatenate([first[1:], [n]])
        tail = bool(after[-1])
        for a, b in zip(first.tolist()[:-1] if tail else first.tolist(), last.tolist()):
            self._emit(False, False, text[a] if b == a + 1 else b"\n".join(text[a:b]))
        if tail:
            self.open = text[int(first[-1]):]


_CUT = ("file long, block long, row long, head boolean, tail boolean, header boolean, "
        "record binary")


def _cut(lines: DataFrame, inside: np.ndarray, late: dict[int, int]) -> DataFrame:
    sent = lines.sparkSession.sparkContext.broadcast((inside, late))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(*sent.value)

        def table(rows: list) -> Iterator[pa.RecordBatch]:
            if rows:
                names = [f.split(" ")[0] for f in _CUT.split(", ")]
                kinds = [pa.int64()] * 3 + [pa.bool_()] * 3 + [pa.binary()]
                yield pa.record_batch({name: pa.array(c, kind) for name, kind, c in zip(
                    names, kinds, zip(*rows))})

        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            yield from table(cutter.batch(
                *(column[c].to_numpy() for c in ("file", "block", "key")), column["line"],
                *(column[c].to_numpy(zero_copy_only=False) for c in ("from_out", "from_in"))))
        cutter.out = []
        cutter.finish()
        yield from table(cutter.out)

    plain = lines.select(_key("path").alias("file"), "block", _key("path", "block").alias("key"),
                         F.col("value").cast("binary").alias("line"), "from_out", "from_in")
    return plain.mapInArrow(cut, _CUT)


def records(lines: DataFrame, facts: DataFrame, headers: bool = False) -> DataFrame:
    """(file, block, row, header, record): every record that is not blank, as
    bytes; ``file`` is the hash of its path, and (block, row) is its place in
    the file.  ``header`` marks the first record of each file; with ``headers``
    they are looked up, beside the records."""
    inside = inside_blocks(facts)
    keys = np.array([r.key for r in inside.select(_key("path", "block").alias("key")).collect()],
                    np.int64)
    late = {r.file: r.block for r in facts.where("first is not null").groupBy("path").agg(
        F.min("block").alias("block")).where("block > 0").select(
        _key("path").alias("file"), "block").collect()}
    cut = _cut(lines, keys, late)
    if not len(keys) and not headers:
        return cut.select("file", "block", "row", "header", "record")
    cut = materialize(cut, "csv-records")
    whole = cut.where("not head and not tail").select("file", "block", "row", "header", "record")
    if not len(keys):
        return whole
    parts = cut.where("head or tail")
    # A record is its tail fragment and the heads behind it.
    order = Window.partitionBy("file").orderBy("block", "row")
    parts = parts.withColumn("group", F.sum(F.col("tail").cast("int")).over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        "block", "row", F.col("record").cast("string").alias("t")))), lambda x: x.t), "\n")
    joined = parts.groupBy("file", "group").agg(
        F.min("block").alias("block"), F.min_by("row", "block").alias("row"),
        F.bool_or("header").alias("header"), text.cast("binary").alias("record"))
    # A tail stands behind all whole records of its block.
    return whole.unionByName(joined.select("file", "block", (F.col("row") + (1 << 40)).alias("row"),
                                           "header", "record"))
