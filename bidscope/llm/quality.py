"""Quality rules (operator 8): a table of thresholds compiled into one
projection of built-in functions.

A rule is a row ``(name, measure, low, high)``: a document passes when the
measure lies in ``[low, high]`` (None: open end).  ``measures`` computes the
raw counts in one scan, ``verdict`` compiles the table over them.  No Python
runs on the executors.

Defined results: null text counts as empty (all measures 0, rejected); very
long texts are measured whole and exactly;
repeated rows are judged row by row; an empty table gives no rows; other
columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, text_of

# Frequent function words of English, German, French, Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on by at from are this be or an "
    "der die das und ist nicht von zu mit auf ein eine den dem für im des sich "
    "le la les et de un une est que dans qui pour par sur du au pas plus "
    "el los las y en es una del se por con para su al como lo").split()

# A stop word counts in lower case or with a capital first letter.
STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize())})

# Characters that count as symbols.
SYMBOL = "[#*$%&|<>]"

# name, measure, lowest, highest accepted value.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("length", "n_words", 50, None),
    ("repeats", "repeat_share", None, 0.5),
    ("word_length", "mean_word_chars", 2.0, 12.0),
    ("symbols", "symbols_per_word", None, 0.1),
    ("stop_words", "n_stop_words", 2, None),
    ("duplicate_lines", "dup_line_share", None, 0.6),
    ("upper_case", "upper_share", None, 0.3),
    ("exclamations", "exclaims_per_word", None, 0.2),
    ("bullet_lines", "bullet_line_share", None, 0.9),
    ("ellipsis_lines", "ellipsis_line_share", None, 0.3),
)

# The two rules every verdict contains, whatever table is given.
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50

_BREAK = r"[\x20\x09-\x0D]+"


def _shift(way: str, value: Column, bits: Column) -> Column:
    return F.call_function(way, value, bits)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a stored column: a one-element explode keeps the
    optimizer from copying the expression into every place (and into every
    step of a lambda) that reads it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _window_hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def _equal_windows(n: Column) -> Column:
    """The places of all three-word windows of ``w`` that stand there twice or
    more, found by sorting the words themselves."""
    ordered = F.sort_array(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(
        F.slice("w", i, F.lit(3)).alias("words"), i.alias("i"))))
    return F.flatten(F.filter(F.zip_with(
        ordered, F.slice(ordered, F.lit(2), n - 3),
        lambda a, b: F.when(a.words == b.words, F.array(a.i, b.i))), lambda x: x.isNotNull()))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             carry: Column | None = None) -> DataFrame:
    """``doc_id`` and the raw counts of every text, with ``carry`` (one
    column, under the name ``carry``) passed through when given.

    Repeated three-word windows: each window's 64-bit hash keeps its upper
    bits and takes the window's position in the lower ones, so one primitive
    sort puts equal windows side by side with their positions.  Windows that
    meet there are compared word by word.
    """
    kept = [] if carry is None else [carry.alias("carry")]
    df = docs.select(F.col(id_col).alias("doc_id"), *kept, text_of(text_col).alias("txt"))
    df = _once(df, "w", F.array_remove(F.split("txt", _BREAK), ""))
    n, bits, none = F.size("w"), F.col("bits"), F.array().cast("array<bigint>")
    # Bits that a window's position needs.
    df = _once(df, "bits", F.length(F.bin(n.cast("long"))))
    df = _once(df, "packed", F.when(n >= 4, F.sort_array(F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: _shift("shiftleft", _window_hash(
            F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)), bits)
        .bitwiseOR(i.cast("long"))))).otherwise(none))
    m, mask = F.size("packed"), _shift("shiftleft", F.lit(1).cast("long"), bits) - 1
    no_pairs = F.array().cast("array<struct<i:int,j:int>>")
    df = _once(df, "pairs", F.when(m >= 2, F.filter(F.zip_with(
        "packed", F.slice("packed", F.lit(2), m - 1),
        lambda a, b: F.when(_shift("shiftright", a.bitwiseXOR(b), bits) == 0, F.struct(
            a.bitwiseAND(mask).cast("int").alias("i"), b.bitwiseAND(mask).cast("int").alias("j")))),
        lambda x: x.isNotNull())).otherwise(no_pairs))
    # Windows of equal hashes whose words differ: this text is counted by its
    # words instead.
    differ = F.exists("pairs", lambda p: F.slice("w", p.i, F.lit(3)) != F.slice("w", p.j, F.lit(3)))
    df = _once(df, "found", F.when(differ, _equal_windows(n)).otherwise(F.flatten(
        F.transform("pairs", lambda p: F.array(p.i, p.j)))))
    repeated = F.size(F.array_distinct(F.flatten(F.transform(
        "found", lambda i: F.array(i, i + 1, i + 2)))))
    df = _once(df, "lines", F.filter(
        F.split("txt", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    stop = F.array(*[F.lit(w) for w in STOP_FORMS])
    bullets = F.filter("lines", lambda x: F.ltrim(x).rlike(r"^(?:[-*\u2022] |[0-9]+[.)] )"))
    ellipses = F.filter("lines", lambda x: F.rtrim(x).rlike(r"(?:\.\.\.|\u2026)$"))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": F.regexp_count("txt", F.lit(SYMBOL)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated,
        "n_lines": F.size("lines"),
        "n_stop_words": F.size(F.array_intersect("w", stop)),
        "n_upper": F.regexp_count("txt", F.lit(r"\p{Lu}")),
        "n_exclaims": F.regexp_count("txt", F.lit("!")),
        "n_bullet_lines": F.size(bullets),
        "n_ellipsis_lines": F.size(ellipses),
    }
    return df.select("doc_id", *(["carry"] if kept else []),
                     *[value.cast("long").alias(name) for name, value in counts.items()])


def _share(part: str, whole: str) -> Column:
    """``part / whole``, 0 where ``whole`` is 0."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


RATIOS = {
    "repeat_share": ("n_repeat_words", "n_words"),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "exclaims_per_word": ("n_exclaims", "n_words"),
    "bullet_line_share": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_share": ("n_ellipsis_lines", "n_lines"),
}


def verdict(rules: Sequence[tuple] = RULES) -> Column:
    """The names of the rules a measured document breaks, in table order."""
    broken = []
    for name, measure, low, high in rules:
        value = _share(*RATIOS[measure]) if measure in RATIOS else F.col(measure)
        passes = F.lit(True)
        if low is not None:
            passes = passes & (value >= low)
        if high is not None:
            passes = passes & (value <= high)
        broken.append(F.when(~passes, F.lit(name)))
    return F.array_compact(F.array(*broken))


def judge(measured: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """Add ``broken`` (rule names), ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < BASE_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    return (measured.withColumn("broken", verdict(rules))
            .withColumn("base_failed", base)
            .withColumn("kept", ~base & (F.size("broken") == 0)))


def score_documents(docs: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """Measures and verdict of every document, one row each."""
    return judge(measures(docs), rules)


def keep_documents(docs: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """The rows of ``docs``, with their columns, that break no rule."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return judge(measures(docs, carry=whole), rules).where("kept").select("carry.*")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (
  SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM g),
r AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE k > 1) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(ls) AS n_lines,
    len(list_distinct(list_filter(ws, lambda x: x IN (STOP_LIST))))
      AS n_stop_words,
    length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaims,
    len(list_filter(ls, lambda x: regexp_matches(x, '^ *(?:[-*\x{2022}] |[0-9]+[.)] )')))
      AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|\x{2026}) *$')))
      AS n_ellipsis_lines
  FROM w LEFT JOIN r USING (rid)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    greatest(n_words, 1) AS nw, greatest(n_lines, 1) AS nl FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 50 AND n_repeat_words / nw <= 0.5
  AND word_chars / nw BETWEEN 2.0 AND 12.0 AND n_symbols / nw <= 0.1 AND n_stop_words >= 2
  AND n_dup_lines / nl <= 0.6 AND n_upper / greatest(word_chars, 1) <= 0.3
  AND n_exclaims / nw <= 0.2 AND n_bullet_lines / nl <= 0.9 AND n_ellipsis_lines / nl <= 0.3
  AS kept
FROM v
""".replace("STOP_LIST", ", ".join(f"'{w}'" for w in STOP_FORMS))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return score_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
