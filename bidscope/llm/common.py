"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# A word is a run of characters other than space, tab, \n, \v, \f and \r.
WORD_BREAKS = " \t\n\x0b\x0c\r"

# Texts handed to one numpy / Arrow pass, in bytes: bounds a task's memory
# whatever the batch size the session sets.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: cuts the
    lineage and fixes values that a recomputation could change."""
    path = scratch_path(df.sparkSession, f"llm-{kind}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def string_array(column) -> pa.Array:
    """One contiguous Arrow string array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text each (one row at least)."""
    if not len(column):
        return
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield first, last
        first = last


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of every text: (distinct words, the index of each word into
    them, offsets of each text's words).  Empty words are left out."""
    lists = pc.ascii_split_whitespace(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary
    offsets = offsets - offsets[0]
    blank = np.flatnonzero(pc.equal(words, "").to_numpy(zero_copy_only=False))
    if len(blank):
        keep = index != blank[0]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        index = index[keep]
    return words, index, offsets
