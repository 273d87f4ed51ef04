"""Sharding (operator 3): size-weighted sampled splitters.

Law: ``bytes``.  Records are ordered by their text's hash (equal texts stand
together) and cut into ranges at the quantiles of a sample that draws each
record with a chance in proportion to its size.  Exact range sizes follow
from one aggregate; ranges over twice the mean are drawn from again and
subdivided.  Prefix sums over the ranges give every record its global byte
position, and its shard is that position's share of the total.  A group of
equal texts goes whole to the shard in which it starts, unless it holds more
than ``SPLIT_SHARE`` of a shard's target; such groups (at most
``shards / SPLIT_SHARE`` of them) are cut wherever a boundary falls.  So
shards differ by at most twice that share and one document.

Only ids, sizes and hashes move; texts never do until ``write_shards``.

Defined results: null text has size 1 and CRC 0; a null doc_id is a row like
any other; repeated rows are kept and get slots of their own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import materialize, read

SHARDS = 8
# Records a range holds on average at most, and least number of ranges; a
# range is the unit of work, and the driver sees one row per range.
RANGE_ROWS = 250_000
RANGES = 64
# Sampled records per range.
OVERSAMPLE = 16
# Share of a shard's target beyond which a group of equal texts may be cut.
SPLIT_SHARE = 0.01
# Ranges over so many times the mean are drawn from again.
OVERFULL = 2.0


def records(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """Narrow records of ``docs``, stored: doc_id, size, text_crc32, the
    group's hash, and ``uid``, a number of the row that orders equal texts."""
    text = F.col("text").cast("string")
    kept = [] if carry is None else [carry.alias("carry")]
    bits = F.xxhash64(F.monotonically_increasing_id())
    return materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *kept,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.xxhash64(text).alias("grp"), bits.alias("uid")), "shard-records")


def _sampled(rows: DataFrame, total: int, want: int, salt: int) -> list[tuple[int, int]]:
    """About ``want`` keys, each record drawn with a chance of
    ``want * size / total`` by a hash of its own; sorted."""
    draw = F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return sorted((r.grp, r.uid) for r in rows.where(
        draw * float(total) < F.col("size") * float(want)).select("grp", "uid").collect())


def _range_of(splitters: list[tuple[int, int]]):
    """A function column: number of splitters at or below (grp, uid)."""
    groups = np.array([s[0] for s in splitters], np.int64)
    uids = np.array([s[1] for s in splitters], np.int64)

    @F.pandas_udf("long")
    def number(grp: pd.Series, uid: pd.Series) -> pd.Series:
        g, u = grp.to_numpy(np.int64), uid.to_numpy(np.int64)
        low, high = np.searchsorted(groups, g, "left"), np.searchsorted(groups, g, "right")
        out = low.astype(np.int64)
        for i in np.flatnonzero(high > low).tolist():  # a group that has been cut
            out[i] += np.searchsorted(uids[low[i]:high[i]], u[i], "right")
        return pd.Series(out)

    return number(F.col("grp"), F.col("uid"))


LEAST_UID = -(1 << 63)


def assign(rows: DataFrame, shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``records`` with ``shard`` and ``slot`` (gapless in each shard)."""
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    split_above = max(1, int(total / shards * SPLIT_SHARE))
    # Groups that may be cut: fewer than total / split_above of them.
    large = [r.grp for r in rows.groupBy("grp").agg(F.sum("size").alias("b"), F.count("*").alias(
        "n")).where((F.col("b") > split_above) & (F.col("n") > 1)).select("grp").collect()]
    cuttable = set(large)
    want = min(count, max(RANGES, shards, -(-count // range_rows)))
    range_rows = -(-count // want)

    def splitter(key: tuple[int, int]) -> tuple[int, int]:
        return key if key[0] in cuttable else (key[0], LEAST_UID)

    sample = _sampled(rows, total, want * OVERSAMPLE, 0)
    splitters = sorted({splitter(sample[i * len(sample) // want])
                        for i in range(1, want)} if sample else set())
    for salt in range(1, 64):
        ranged = rows.withColumn("rng", _range_of(splitters))
        sizes = ranged.groupBy("rng").agg(
            F.sum("size").alias("b"), F.count("*").alias("n"),
            F.min("grp").alias("low"), F.max("grp").alias("high"))
        bounds = sizes.orderBy("rng").collect()  # one row per range
        over = {r.rng: r for r in bounds if r.n > range_rows * OVERFULL
                and (r.low != r.high or r.low in cuttable)}
        if not over:
            break
        # Draw again inside the overfull ranges only.
        inside = ranged.where(F.col("rng").isin(list(over))).drop("rng")
        share = sum(r.b for r in over.values())
        more = _sampled(inside, share, OVERSAMPLE * sum(
            -(-r.n // range_rows) for r in over.values()), salt)
        new = {splitter(k) for k in more[OVERSAMPLE - 1::OVERSAMPLE]} - set(splitters)
        if not new:
            break
        splitters = sorted({*splitters, *new})
    before, offsets = 0, []
    for r in bounds:
        offsets.append((r.rng, before))
        before += r.b
    spark = rows.sparkSession
    starts = F.broadcast(spark.createDataFrame(offsets, "rng long, range_start long"))
    in_range = Window.partitionBy("rng").orderBy("grp", "uid")
    placed = ranged.join(starts, "rng").withColumn(
        "at", F.col("range_start") + F.sum("size").over(in_range) - F.col("size"))
    whole = F.min("at").over(Window.partitionBy("rng", "grp"))
    position = F.col("at") if not large else F.when(
        F.col("grp").isin(large), F.col("at"))
    position = F.coalesce(position, whole) if large else whole
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(
        position * F.lit(shards) / F.lit(total)).cast("int")))
    in_shard = Window.partitionBy("rng", "shard").orderBy("grp", "uid")
    placed = materialize(placed.withColumn("k", F.row_number().over(in_shard) - 1)
                         .drop("range_start", "at"), "shard-places")
    # Rows of each shard in earlier ranges: a row per range and shard.
    per = placed.groupBy("shard", "rng").agg(F.count("*").alias("n"))
    earlier = per.select("shard", "rng", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("earlier"))
    return placed.join(F.broadcast(earlier), ["shard", "rng"]).withColumn(
        "slot", F.col("earlier") + F.col("k")).drop("earlier", "k", "rng")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    return assign(records(docs), shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents themselves, with all their columns, as one folder per
    shard; a folder's files hold its slots in ascending order."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    placed = assign(records(docs, carry=whole), shards)
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .select("shard", "slot", F.col("carry").alias("document"))
     .write.partitionBy("shard").parquet(path))


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
