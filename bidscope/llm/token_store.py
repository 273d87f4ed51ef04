"""Token-id output (operator 10): Arrow files of equal-length sequences.

Documents are range-partitioned by id, encoded in order, and each partition
writes one Arrow file: record batches whose rows are fixed-size lists of
``SEQUENCE`` ids (16 bits each, or 32 if the vocabulary has larger ids), of as
many bits ``mask`` (an id, or padding at a file's
end) and of bits ``first`` (a document starts).  A reader maps the file and
finds sequence ``k`` of it in batch ``k // BATCH_ROWS``, row
``k % BATCH_ROWS``, without copying.  Documents are found again from the
file itself; their doc_ids stand in a second Arrow file beside it.

Files go to ``out_dir`` through Arrow's own file systems (``file:``, ``s3:``,
``hdfs:`` ...).  A task writes under a name of its attempt and moves the
file into place, so a retried or speculative task leaves one whole file.

Defined results: null text counts as empty (one end id); rows with one
doc_id follow each other by their text's hash; rows with a null doc_id come
first; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialize, read, text_of
from .tokens import encoder, slices_of, with_end

END_ID = 1
SEQUENCE = 2048
BATCH_ROWS = 256

MANIFEST = "part int, path string, n_docs long, n_ids long, n_sequences long"
DOCUMENTS = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"



def id_type(n_ids: int) -> pa.DataType:
    """The narrowest type that holds ``n_ids`` different ids."""
    return pa.uint16() if n_ids <= 1 << 16 else pa.uint32()


def sequence_schema(ids: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(ids, SEQUENCE)),
                      pa.field("mask", pa.list_(pa.bool_(), SEQUENCE)),
                      pa.field("first", pa.list_(pa.bool_(), SEQUENCE))])


INDEX = pa.schema([pa.field("doc_id", pa.int64())])


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        fs.LocalFileSystem(), path)


FIRST = 2


class SequenceWriter:
    """Cuts a stream of ids into full record batches of one Arrow file."""

    def __init__(self, sink, n_ids: int):
        self.type = id_type(n_ids)
        self.number = np.dtype(self.type.to_pandas_dtype())
        self.schema = sequence_schema(self.type)
        self.file = ipc.new_file(sink, self.schema)
        self.ids, self.mask = [], []
        self.held = self.written = self.sequences = 0

    def add(self, ids: np.ndarray, mask: np.ndarray) -> None:
        """``mask``: FIRST for a document's first id, 1 for the others."""
        self.ids.append(ids.astype(self.number))
        self.mask.append(mask)
        self.held += len(ids)
        self.written += len(ids)
        if self.held >= SEQUENCE * BATCH_ROWS:
            self._put(self.held - self.held % (SEQUENCE * BATCH_ROWS))

    def _put(self, n: int) -> None:
        ids, mask = np.concatenate(self.ids), np.concatenate(self.mask)
        for first in range(0, n, SEQUENCE * BATCH_ROWS):
            last = min(n, first + SEQUENCE * BATCH_ROWS)
            self.file.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(ids[first:last], self.type), SEQUENCE),
                *[pa.FixedSizeListArray.from_arrays(pa.array(bits), SEQUENCE)
                  for bits in (mask[first:last] > 0, mask[first:last] == FIRST)]],
                schema=self.schema))
            self.sequences += (last - first) // SEQUENCE
        self.ids, self.mask = [ids[n:]], [mask[n:]]
        self.held -= n

    def close(self) -> None:
        if self.held:
            pad = -self.held % SEQUENCE
            self.ids.append(np.zeros(pad, self.number))
            self.mask.append(np.zeros(pad, np.uint8))
            self.held += pad
            self._put(self.held)
        self.file.close()


def write_tokens(docs: DataFrame, out_dir: str, vocabulary: str | None = None,
                 end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into ``out_dir``; returns the manifest,
    one row per file in the order of the documents."""

    def write(batches):
        part = TaskContext.get().partitionId()
        name = posixpath.join(out_dir, f"part-{part:07d}.arrow")
        store, path = _file_system(name)
        trial = f"{path}.{uuid.uuid4().hex}"
        known = encoder(vocabulary)
        encode, out, index = known.encode, None, None
        for batch in batches:
            for rows, texts in slices_of(batch):
                if out is None:
                    store.create_dir(posixpath.dirname(path), recursive=True)
                    sink, index_sink = (store.open_output_stream(trial + end)
                                        for end in (".ids", ".docs"))
                    largest = max(known.library.get_vocab(True).values(), default=0)
                    out = SequenceWriter(sink, 1 + max(largest, end_id))
                    index = ipc.new_file(index_sink, INDEX)
                    n_docs = 0
                ids, offsets = with_end(*encode(texts), end_id)
                mask = np.ones(len(ids), np.uint8)
                mask[offsets[:-1]] = FIRST
                out.add(ids, mask)
                index.write_batch(pa.record_batch([rows.column("doc_id")], schema=INDEX))
                n_docs += len(texts)
        if out is None:
            return
        out.close()
        index.close()
        sink.close()
        index_sink.close()
        for end in (".ids", ".docs"):
            store.move(trial + end, path + end)
        yield pa.RecordBatch.from_pylist([{
            "part": part, "path": name, "n_docs": n_docs, "n_ids": out.written,
            "n_sequences": out.sequences}], schema=pa.schema([
                ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
                ("n_ids", pa.int64()), ("n_sequences", pa.int64())]))

    ordered = (docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie").drop("tie"))
    return materialize(ordered.mapInArrow(write, MANIFEST), "token-files")


def open_file(path: str):
    """(reader of a token file, its doc_ids): the file is mapped where the
    file system allows it, so ids and masks are views of it."""
    store, at = _file_system(path)
    local = isinstance(store, fs.LocalFileSystem)
    source = pa.memory_map(at + ".ids") if local else store.open_input_file(at + ".ids")
    with store.open_input_file(at + ".docs") as f:
        ids = ipc.open_file(f).read_all().column("doc_id").combine_chunks()
    return ipc.open_file(source), ids


def sequence(reader, k: int) -> tuple[np.ndarray, pa.Array]:
    """Ids and mask of one sequence: views of the file."""
    batch = reader.get_batch(k // BATCH_ROWS)
    row = k % BATCH_ROWS * SEQUENCE
    return (batch.column(0).values.to_numpy()[row:row + SEQUENCE],
            batch.column(1).values.slice(row, SEQUENCE))


def documents_in(path: str):
    """The documents of one file, batch by batch: (first, counts, crcs), as
    positions of documents in the file.  Holds one batch and the part of a
    document that goes on in the next."""
    reader, _ = open_file(path)
    count = crc = 0
    doc = -1
    for b in range(reader.num_record_batches):
        batch = reader.get_batch(b)
        ids = batch.column(0).flatten().to_numpy()
        mask, begins = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
        real = int(np.count_nonzero(mask))
        ids, starts = ids[:real], np.flatnonzero(begins)
        data, bounds = memoryview(ids.astype("<u4")).cast("B"), [*starts.tolist(), real]
        crc = zlib.crc32(data[:4 * bounds[0]], crc)
        count += bounds[0]
        done, counts, crcs = doc, [], []
        for first, last in zip(bounds, bounds[1:]):
            if doc >= 0:
                counts.append(count)
                crcs.append(crc)
            doc += 1
            count, crc = last - first, zlib.crc32(data[4 * first:4 * last])
        if counts:
            yield max(done, 0), counts, crcs
    if doc >= 0:
        yield doc, [count], [crc]


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document of the files: part, start in the part, count and CRC-32
    of its ids, read from the files."""

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, doc_ids = open_file(row["path"])
                start = 0
                for first, counts, crcs in documents_in(row["path"]):
                    n = np.array(counts, np.int64)
                    yield pa.record_batch({
                        "doc_id": doc_ids.slice(first, len(n)),
                        "part": pa.array(np.full(len(n), row["part"], np.int32)),
                        "start_in_part": pa.array(start + np.cumsum(n) - n),
                        "n_tokens": pa.array(n),
                        "ids_crc32": pa.array(np.array(crcs, np.int64))})
                    start += int(n.sum())

    # A file a task: the manifest has one row per file.
    files = manifest.repartition(max(1, manifest.count()), "part")
    return files.mapInArrow(scan, DOCUMENTS)


def with_global_start(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents in earlier files and before it in
    its own.  The window runs over one row per file."""
    before = manifest.select("part", F.coalesce(F.sum("n_ids").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("before"))
    return found.join(before, "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest, read back from the token files."""
    manifest = write_tokens(read(spark, sf_dir, "documents"), scratch_path(spark, "llm-tokens"))
    return with_global_start(read_documents(manifest), manifest).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "part")
