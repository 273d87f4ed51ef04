"""Mixing sources to target weights (operator 5) by Pfair scheduling.

Time is a row of slots, each holding one block of ``block_rows`` documents
of one source.  A source's weight becomes ``share`` of every ``period``
slots (largest remainders, one slot at least).  Its block ``j`` may run from
``release = floor(j * period / share)`` and has to run before
``deadline = ceil((j + 1) * period / share)``; in every slot the released
block with the earliest deadline runs.  The shares fill the period, so every
deadline is met and at each slot a source is less than one block off its
target.  The schedule repeats after a period, so it is worked out for one
period (one small row, by ``aggregate``) and read off for any block.

A source that has run out leaves its slots idle; the others keep theirs, so
the bound goes on to hold on the slot clock.  ``position`` counts the
documents without the idle slots.  No document is dropped or repeated.

Built-in functions only.  A source's documents are ordered by a hash of their
ids, in buckets of that hash's prefix, so a source with most of the rows is
ranked by many tasks.

Defined results: a null source is a source of its own; null ids and null
texts are ordered as empty ones; repeated rows are placed one by one; an
empty table gives no rows; other columns pass through ``mixed_order``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import read

PERIOD = 1000
BLOCK_ROWS = 64
# Rows of a source that one hash bucket holds, about.
BUCKET_ROWS = 4096


def source_key(source: str = "source") -> Column:
    """A key that is never null: ``n`` for a null source, else ``v`` + name."""
    name = F.col(source).cast("string")
    return F.when(name.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), name))


def text_hash(text: str = "text") -> Column:
    """Orders the documents of a source that have the same id."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def shares(docs: DataFrame, target: dict[str, float] | None = None,
           period: int = PERIOD) -> DataFrame:
    """One row per source: key, n (rows), share, period.

    ``target`` gives weights by source; a source it leaves out gets the
    smallest share.  Without it a weight is the square root of the rows.
    """
    counted = docs.groupBy(source_key().alias("key")).agg(F.count("*").alias("n"))
    if target is None:
        weight = F.sqrt("n")
    else:
        given = [x for name, w in target.items() for x in (F.lit("v" + name), F.lit(float(w)))]
        weight = F.coalesce(F.element_at(F.create_map(*given), F.col("key")), F.lit(0.0))
    every = Window.partitionBy()
    sized = counted.withColumn("weight", F.round(weight * 1000000).cast("long")).withColumn(
        "sources", F.count("*").over(every)).withColumn(
        "period", F.greatest(F.lit(period).cast("long"), 4 * F.col("sources"))).withColumn(
        "total", F.greatest(F.sum("weight").over(every), F.lit(1).cast("long")))
    # What is left of the period after a slot for each source.
    part = sized.withColumn("whole", F.expr("(period - sources) * weight")).withColumn(
        "base", F.expr("whole div total")).withColumn("rest", F.expr("whole % total"))
    ranked = part.withColumn("spare", F.expr("period - sources") - F.sum("base").over(every)) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rest"), "key")))
    # Weights of 0 altogether leave more spare slots than sources: deal them in turn.
    return ranked.select(
        "key", "n", (1 + F.col("base") + F.expr("spare div sources")
                     + F.when(F.col("rank") <= F.expr("spare % sources"), 1).otherwise(0))
        .alias("share"), "period")


_EARLIEST_DEADLINE_FIRST = """
aggregate(
  sequence(0L, period - 1),
  named_struct('done', transform(share, x -> 0L), 'out', cast(array() as array<int>)),
  (s, t) -> transform(
    array(array_min(filter(
      transform(share, (x, i) -> named_struct(
        'deadline', ((s.done[i] + 1) * period + x - 1) div x, 'source', i,
        'release', (s.done[i] * period) div x, 'left', x - s.done[i])),
      c -> c.left > 0 and c.release <= t)).source),
    p -> named_struct(
      'done', transform(s.done, (v, j) -> if(j = p, v + 1, v)),
      'out', concat(s.out, array(p))))[0]).out
"""


def schedule(shared: DataFrame) -> DataFrame:
    """One period: (key, turn, slot, share, period); ``turn`` numbers a
    source's blocks in the period.  At most ``period`` rows."""
    one = shared.groupBy("period").agg(F.sort_array(F.collect_list(
        F.struct("key", "share"))).alias("of")).select(
        "period", "of", F.expr("transform(of, x -> x.share)").alias("share"))
    slots = one.select("period", "of", F.posexplode(F.expr(_EARLIEST_DEADLINE_FIRST))
                       .alias("slot", "at"))
    slots = slots.select("period", F.col("slot").cast("long"), F.col("of")[F.col("at")]["key"]
                         .alias("key"), F.col("of")[F.col("at")]["share"].alias("share"))
    return slots.withColumn("turn", F.row_number().over(
        Window.partitionBy("key").orderBy("slot")).cast("long") - 1)


def interleave(docs: DataFrame, target: dict[str, float] | None = None, period: int = PERIOD,
               block_rows: int = BLOCK_ROWS, carry: Column | None = None,
               text_md5: Column | None = None) -> DataFrame:
    """Every document with its source's block, the block's slot, release and
    deadline, and its place in the block.  ``text_md5`` stands for the hash of
    a text that ``docs`` no longer hold."""
    kept = [] if carry is None else [carry.alias("carry")]
    # Order of a source's documents: a hash of the id, then one of the text.
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), *kept,
        source_key().alias("key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
        (text_hash() if text_md5 is None else text_md5).alias("th"))
    digits = max(1, math.ceil(math.log(max(1, docs.count() / BUCKET_ROWS), 16)))
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    narrow = docs.select(source_key().alias("key"), F.substring(
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, digits)
        .alias("bucket"))
    earlier = narrow.groupBy("key", "bucket").agg(F.count("*").alias("c")).select(
        "key", "bucket", F.coalesce(F.sum("c").over(
            Window.partitionBy("key").orderBy("bucket").rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = rows.withColumn("r", F.row_number().over(
        Window.partitionBy("key", "bucket").orderBy("h", "th")).cast("long") - 1)
    ranked = ranked.join(earlier, ["key", "bucket"]).withColumn("r", F.col("r") + F.col("earlier"))
    planned = shares(docs, target, period)
    blocks = ranked.withColumn("block", F.expr(f"r div {block_rows}")) \
        .withColumn("place", F.expr(f"r % {block_rows}")) \
        .join(F.broadcast(planned.select("key", "share", "period")), "key") \
        .withColumn("turn", F.expr("block % share"))
    # At most one row per slot of a period.
    slots = F.broadcast(schedule(planned).select("key", "turn", F.col("slot").alias("in_period")))
    return blocks.join(slots, ["key", "turn"]).select(
        "doc_id", "source", *(["carry"] if kept else []), "block",
        F.expr("(block div share) * period + in_period").alias("slot"), "place",
        F.expr("(block * period) div share").alias("release"),
        F.expr("((block + 1) * period + share - 1) div share").alias("deadline"),
        "share", "period")


def with_position(placed: DataFrame, size: Column | None = None) -> DataFrame:
    """Add ``position``: gapless from 0 in the order of slots and places.
    Counts by slot are summed over a period's slots and over periods, so no
    task ranks documents.  With a ``size`` (1 or more) of each document,
    position is the sum of the sizes before it."""
    one = F.lit(1) if size is None else size
    slots = placed.groupBy("slot", "period").agg(F.sum(one).alias("c")).withColumn(
        "cycle", F.expr("slot div period"))
    periods = slots.groupBy("cycle").agg(F.sum("c").alias("c"))
    before = periods.select("cycle", F.coalesce(F.sum("c").over(Window.orderBy("cycle").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("cycle").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    earlier = slots.withColumn("inside", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(
        before, "cycle").select("slot", (F.col("before") + F.col("inside")).alias("earlier"))
    in_slot = F.col("place") if size is None else F.coalesce(F.sum(size).over(
        Window.partitionBy("slot").orderBy("place").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(earlier, "slot").withColumn(
        "position", F.col("earlier") + in_slot).drop("earlier")


def mixed_order(docs: DataFrame, target: dict[str, float] | None = None,
                period: int = PERIOD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with their columns, ordered by slot and place."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    placed = interleave(docs, target, period, block_rows, carry=whole)
    return placed.select("carry", "slot", "place").orderBy("slot", "place").select("carry.*")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS key,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, md5(coalesce(text, '')) AS th FROM documents),
c AS (SELECT key, count(*) AS n, CAST(round(sqrt(count(*)) * 1000000) AS BIGINT) AS weight
      FROM d GROUP BY key),
s AS (SELECT key, weight, count(*) OVER () AS sources, sum(weight) OVER () AS total FROM c),
p AS (SELECT *, greatest(1000, 4 * sources) AS period FROM s),
b AS (SELECT *, ((period - sources) * weight) // total AS base,
        ((period - sources) * weight) % total AS rest FROM p),
f AS (SELECT *, period - sources - sum(base) OVER () AS spare,
        row_number() OVER (ORDER BY rest DESC, key) AS rnk FROM b),
sh AS (SELECT key, period, CAST(1 + base + spare // sources
         + CASE WHEN rnk <= spare % sources THEN 1 ELSE 0 END AS BIGINT) AS share FROM f),
a AS (SELECT any_value(period) AS period, list(key ORDER BY key) AS ks,
        list(share ORDER BY key) AS q FROM sh),
e AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS done,
    CAST(NULL AS BIGINT) AS pick FROM a
  UNION ALL
  SELECT t + 1, list_transform(done, lambda v, j: CASE WHEN j = p THEN v + 1 ELSE v END), p
  FROM (SELECT t, done, list_min(list_filter(list_transform(q, lambda x, i: {
            'deadline': ((done[i] + 1) * period + x - 1) // x, 'source': i,
            'release': (done[i] * period) // x, 'left': x - done[i]}),
          lambda z: z['left'] > 0 AND z['release'] <= t))['source'] AS p
        FROM e, a WHERE t < period)),
sl AS (SELECT ks[pick] AS key, t - 1 AS in_period,
         row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn
       FROM e, a WHERE pick IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY h, th) - 1 AS r FROM d),
o AS (
  SELECT doc_id, source, r // 64 AS block, (r // 64 // share) * period + in_period AS slot,
    r % 64 AS place, ((r // 64) * period) // share AS release,
    ((r // 64 + 1) * period + share - 1) // share AS deadline
  FROM r JOIN sh USING (key) JOIN sl ON sl.key = r.key AND sl.turn = (r // 64) % share)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot,
  CAST(place AS BIGINT) AS place, CAST(release AS BIGINT) AS release,
  CAST(deadline AS BIGINT) AS deadline,
  CAST(row_number() OVER (ORDER BY slot, place) - 1 AS BIGINT) AS position FROM o
"""


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, slot and position of every document."""
    return with_position(interleave(read(spark, sf_dir, "documents"))).select(
        "doc_id", "source", "block", "slot", "place", "release", "deadline", "position")
