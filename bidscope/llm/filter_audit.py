"""Filter interaction audit (operator 13): what each filter removes, after
every possible order of the filters, by a recursive common table expression.

One scan marks each document with the filters that it fails (a bit mask).
Documents are then added up into mask cells: per part (source) and mask their
number, and how many are labelled good or toxic.  A part's cells become one
row, and the recursive query starts from the empty prefix of every part:
each level extends each prefix by every filter that it does not hold, joins
the part's cells, and works out what that filter removes after the filters
of the prefix.  325 prefixes of five filters give the 600 steps of all 120
orders, since orders that begin alike share their prefixes.

Copies (filter E) are found by the SHA-256 of the text: the smallest doc_id
of each text comes from one aggregate, the number of rows that hold it from
another, and only these sums are joined, so a text that fills a third of the
table is one row per task before any shuffle.

Defined results: null text counts as empty (fails A; D, B and C hold no
counts to fail by); a null source is the part ``''``; a row without doc_id
never fails E and is nobody's smaller doc_id; repeated rows with one doc_id
and text are counted one by one and are not copies of each other; a document
labelled more than once is good (toxic) when any of its labels says so; very
long texts are measured whole; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, text_of

# The filters, in the order of their bits.
LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SYMBOLS = "[#$%&*|]"

_COPY = LETTERS.index("E")
_BREAKS = "\t\n\x0b\x0c\r"


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def text_mask() -> Column:
    """Bits of the filters that the text ``txt`` with words ``w`` fails
    (all but E)."""
    words, code_points = F.size("w"), F.length("txt")
    fails = {
        "A": words < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct("w")) < MIN_DISTINCT_PERCENT * words,
        "C": 100 * F.regexp_count("txt", F.lit("[A-Z]")) > MAX_UPPER_PERCENT * code_points,
        "D": F.col("txt").rlike(SYMBOLS),
    }
    total = F.lit(0)
    for letter, failed in fails.items():
        total = total + F.when(failed, F.lit(_bit(letter))).otherwise(F.lit(0))
    return total


def _label(name: str) -> Column:
    return F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0)).alias(name)


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, key, mask, quality, toxic, doc_id, n): equal rows added up;
    ``key`` is the text's digest, ``mask`` lacks E."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                        text_of().alias("txt"))
    # A one-element explode stores the words: three measures read them.
    spaced = F.translate("txt", _BREAKS, " " * len(_BREAKS))
    plain = plain.select("*", F.explode(F.array(F.array_remove(F.split(spaced, " "), ""))).alias("w"))
    rows = plain.select("doc_id", "part", F.unhex(F.sha2("txt", 256)).alias("key"),
                        text_mask().alias("mask"))
    rows = rows.groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(_label("quality"), _label("toxic"))
    return rows.join(known, "doc_id", "left").na.fill(0, ["quality", "toxic"])


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the whole
    set of filters that they fail."""
    rows = materialize(marked(docs, labels), "audit-marks")
    groups = rows.groupBy("part", "key", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"),
        # Rows that stand at the group's smallest doc_id, and without one.
        F.min_by("n", F.col("doc_id")).alias("at_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first_of_all = rows.groupBy("key").agg(F.min("doc_id").alias("smallest"))
    groups = groups.join(first_of_all, "key")
    spared = F.col("no_id") + F.when(F.col("first") == F.col("smallest"),
                                     F.col("at_first")).otherwise(0)
    copies = F.col("n") - spared
    split = groups.select("part", "quality", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), spared.alias("n")),
        F.struct((F.col("mask") + (1 << _COPY)).alias("mask"), copies.alias("n")))).alias("x"))
    return split.where("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("quality")).alias("good"),
        F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


# One level of the recursion: every prefix of a part meets the part's cells
# and each filter that it does not hold yet.
WALK = """
WITH RECURSIVE
filters AS (
  SELECT * FROM VALUES {filters} AS t(letter, bit)),
cells AS (
  SELECT part, collect_list(struct(mask, n, good, toxic)) AS cell FROM {cells} GROUP BY part),
walk AS (
  SELECT part, '' AS prefix, 0 AS applied, 0 AS step, 0L AS kept, 0L AS removed, 0L AS redundant,
         0L AS unique_fails, 0L AS good_lost, 0L AS toxic_lost
  FROM cells
  UNION ALL
  SELECT w.part, concat(w.prefix, f.letter), w.applied | f.bit, w.step + 1,
    aggregate(c.cell, 0L, (s, x) -> s + if(x.mask & (w.applied | f.bit) = 0, x.n, 0L)),
    aggregate(c.cell, 0L, (s, x) -> s + if(x.mask & (w.applied | f.bit) = f.bit, x.n, 0L)),
    aggregate(c.cell, 0L, (s, x) ->
      s + if(x.mask & f.bit > 0 AND x.mask & w.applied > 0, x.n, 0L)),
    aggregate(c.cell, 0L, (s, x) -> s + if(x.mask = f.bit, x.n, 0L)),
    aggregate(c.cell, 0L, (s, x) -> s + if(x.mask & (w.applied | f.bit) = f.bit, x.good, 0L)),
    aggregate(c.cell, 0L, (s, x) -> s + if(x.mask & (w.applied | f.bit) = f.bit, x.toxic, 0L))
  FROM walk w JOIN cells c ON c.part = w.part
  JOIN filters f ON w.applied & f.bit = 0
  WHERE w.step < {levels})
SELECT * FROM walk WHERE step > 0
"""

ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def prefixes(cells: DataFrame) -> DataFrame:
    """One row per part and prefix of one to five filters, with the metrics
    of its last filter.  Written out: the session's limit of recursive rows
    is lifted while the query runs, as their number is parts x 326."""
    spark = cells.sparkSession
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return materialize(spark.sql(WALK.format(
            cells="{cells}", levels=len(LETTERS),
            filters=", ".join(f"('{x}', {_bit(x)})" for x in LETTERS)), cells=cells), "audit-walk")
    finally:
        if before is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, before)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Metrics of every step of every order of the filters, per part."""
    spark = docs.sparkSession
    walk = prefixes(materialize(mask_cells(docs, labels), "audit-cells"))
    letter = F.substring("prefix", -1, 1)
    # A prefix of k filters begins (5 - k)! orders.
    orders_of = F.factorial(len(LETTERS) - F.col("step"))
    shapley = walk.groupBy("part", letter.alias("letter")).agg(
        F.sum(F.col("removed") * orders_of).alias("shapley"))
    orders = spark.sql("SELECT explode(array({})) AS filter_order".format(
        ", ".join(f"'{''.join(p)}'" for p in itertools.permutations(LETTERS))))
    steps = orders.select("filter_order", F.explode(F.sequence(
        F.lit(1), F.lit(len(LETTERS)))).alias("place")).withColumn(
        "prefix", F.expr("substring(filter_order, 1, place)"))
    # 600 rows, whatever the tables.
    return walk.join(F.broadcast(steps), "prefix").withColumn("letter", letter).join(
        shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", *[F.col(name).cast("long").alias(name) for name in (
            "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def op13_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on the documents in all 120 orders, per source."""
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS txt FROM documents),
measured AS (
  SELECT doc_id, part, txt,
    list_filter(regexp_split_to_array(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM doc),
copies AS (SELECT txt, min(doc_id) AS smallest FROM doc GROUP BY txt),
label AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::int) AS good,
    max((coalesce(toxic, 0) = 1)::int) AS tox FROM labels GROUP BY doc_id),
failed AS (
  SELECT m.part, coalesce(good, 0) AS good, coalesce(tox, 0) AS tox, [
    len(w) < 200,
    100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(m.txt, '[^A-Z]', '', 'g')) > 2 * length(m.txt),
    regexp_matches(m.txt, '[#$%&*|]'),
    coalesce(m.doc_id > smallest, false)] AS f
  FROM measured m JOIN copies USING (txt) LEFT JOIN label ON label.doc_id = m.doc_id),
cells AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(tox) AS tox FROM failed GROUP BY part, f),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l)
  WHERE len(o) < 5 AND NOT contains(o, l)),
steps AS (
  SELECT o AS filter_order, k AS step, list_position(['A', 'B', 'C', 'D', 'E'], o[k]) AS mine,
    [list_position(['A', 'B', 'C', 'D', 'E'], x) FOR x IN string_split(o[1:k - 1], '') IF x <> '']
      AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(o) = 5),
met AS (
  SELECT c.*, s.*, f[mine] AS hit, len([1 FOR e IN earlier IF f[e]]) > 0 AS gone,
    len([1 FOR x IN f IF x]) AS n_failed
  FROM cells c, steps s),
found AS (
  SELECT part, filter_order, step, any_value(mine) AS mine,
    sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN hit AND n_failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN hit AND NOT gone THEN tox ELSE 0 END)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails,
  good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, mine))::BIGINT AS shapley
FROM found
"""
