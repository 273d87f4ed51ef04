"""Chat formatting (operator 7): budgeted, turn-aligned windows.

Every turn has a cost in tokens (a count of short runs of characters plus
the marks around it).  The running sum of costs chooses a conversation's
windows: turns whose costs start in the same stride share one, and a turn of
more than half a stride stands alone.  Each window repeats the conversation's
system turn and at most ``HISTORY_TURNS`` turns before it within
``HISTORY_TOKENS``; what it repeats is masked, so each assistant text counts
for the loss once.  New turns of a window cost less than 1.5 strides unless
one alone costs more.  Where that and the repeated system turn exceed
``BUDGET``, the window is cut again by half of the room that the system turn
leaves; history goes where it does not fit.  So a window exceeds the budget
only if a single turn and the repeated system turn do by themselves; no text
is ever cut.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings
inside a text get a backslash after their first character (and one more if
backslashes stand there already), which reads back without loss; so do
backslashes and line ends in a role.

Built-in functions only.  The running sum goes over stretches of
``STRETCH`` turn numbers first, so a conversation with most of the rows is
spread over many tasks; the digests of ``read_back`` need a conversation's
windows in one row, as they are digests of all of it.

Defined results: null text and null role count as empty; a null conv_id is a
conversation; equal turn numbers are ordered by role and text, repeated rows
are turns of their own, null turns come first; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import materialize, read, text_of

BUDGET = 1024
STRIDE = 512
HISTORY_TURNS = 2
HISTORY_TOKENS = 160
MARK_TOKENS = 4
# Turn numbers per stretch of the two-level running sum.
STRETCH = 256

START, END = "<|im_start|>", "<|im_end|>\n"

# What follows the first character of a control string.
_REST = r"(\|[a-z_]+\|>|/?s>|unk>|pad>|/?INST\])"
ESCAPE = r"([<\[])(\\*)" + _REST
UNESCAPE = r"([<\[])\\(\\*)" + _REST
TOKEN = r"[A-Za-z0-9]{1,4}|[^A-Za-z0-9\x20\x09-\x0D]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def _role(role: Column) -> Column:
    # A backslash becomes backslash-b, a line end backslash-n.
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")),
                     F.lit("\n"), F.lit("\\n"))


def _role_back(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")),
                              F.lit("\\b"), F.lit("\\")))


def _same_turn(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """Inner join on ``columns``, null with null; ``right`` gives the others."""
    renamed = right.select(*[F.col(c).alias(f"{c}__r" if c in columns else c)
                             for c in right.columns])
    condition = None
    for c in columns:
        same = F.col(c).eqNullSafe(F.col(f"{c}__r"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition).drop(*[f"{c}__r" for c in columns])


def costed(conversations: DataFrame) -> DataFrame:
    """Every turn with its cost and its place (``n_in``, ``cost_in``,
    ``big_in``: running sums) within its stretch of the conversation."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text_of("role").alias("role"), text_of("text").alias("text"))
    rows = rows.withColumn("cost", (
        F.regexp_count("text", F.lit(TOKEN)) + F.regexp_count("role", F.lit(TOKEN))
        + MARK_TOKENS).cast("long")).withColumn(
        "big", (F.col("cost") * 2 > STRIDE).cast("long")).withColumn(
        "stretch", F.floor(F.col("turn") / STRETCH))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, 0)
    return rows.select("*", F.count("*").over(inside).alias("n_in"),
                       F.sum("cost").over(inside).alias("cost_in"),
                       F.sum("big").over(inside).alias("big_in"))


def placed(turns_in: DataFrame) -> DataFrame:
    """conv_id, stretch, n_in, is_system, cost, ``at`` (the turn's number in
    its conversation), ``before`` (the cost of earlier turns) and ``win``; no
    texts."""
    rows = turns_in.select("conv_id", "stretch", "n_in", "cost", "big", "cost_in", "big_in",
                           (F.col("role") == "system").alias("is_system"))
    # One row per stretch.
    sums = rows.groupBy("conv_id", "stretch").agg(
        F.count("*").alias("n"), F.sum("cost").alias("c"), F.sum("big").alias("b"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "stretch", *[
        F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}0") for x in ("n", "c", "b")])
    rows = _same_turn(rows, sums, "conv_id", "stretch")
    bigs = F.col("b0") + F.col("big_in")
    before = F.col("c0") + F.col("cost_in") - F.col("cost")
    return rows.select(
        "conv_id", "stretch", "n_in", "cost", before.alias("before"),
        (F.col("n0") + F.col("n_in") - 1).alias("at"),
        ((F.col("n0") + F.col("n_in") == 1) & F.col("is_system")).alias("is_system"),
        # Windows in order of (stride, turns that stand alone).
        F.struct(F.floor(before / STRIDE).alias("stride"),
                 (2 * bigs - F.col("big")).alias("alone")).alias("win"))


def turns(conversations: DataFrame) -> DataFrame:
    """Turns with their texts, ``at``, ``cost``, ``before`` and ``win``."""
    rows = costed(conversations)
    return _same_turn(rows.select("conv_id", "stretch", "n_in", "turn", "role", "text"),
                      placed(rows), "conv_id", "stretch", "n_in")


def _within_budget(rows: DataFrame) -> DataFrame:
    """``placed`` with the windows that exceed the budget cut again, and
    ``room``, what a repeated system turn leaves of the budget."""
    whole = rows.groupBy("conv_id", "win").agg(
        F.min("at").alias("first"), F.min("before").alias("from"), F.sum("cost").alias("new"),
        F.max(F.when(F.col("is_system"), F.col("cost"))).alias("own"))
    # The system turn stands in the conversation's first window.
    room = F.lit(BUDGET) - F.coalesce(F.max("own").over(Window.partitionBy("conv_id")), F.lit(0))
    # It does not repeat there.  If it leaves no room at all, no cut can help.
    whole = whole.withColumn("room", room).select(
        "conv_id", "win", "from", "room",
        ((F.col("first") > 0) & (F.col("new") > F.col("room")) & (F.col("room") > 0))
        .alias("over"))
    rows = _same_turn(rows, whole, "conv_id", "win")
    half = F.greatest(F.floor(F.col("room") / 2), F.lit(1))
    rows = rows.withColumn("half", half).withColumn(
        "big", (F.col("cost") > F.col("room") - F.col("half")).cast("long"))
    # A window's turns start in one stride: they are less than a stride in number.
    bigs = F.sum("big").over(Window.partitionBy("conv_id", "win").orderBy("at").rowsBetween(
        Window.unboundedPreceding, 0))
    return rows.withColumn("bigs", bigs).select(
        "conv_id", "stretch", "n_in", "cost", "before", "at", "is_system", "room",
        F.struct(
            "win.stride", "win.alone",
            F.when(F.col("over"), F.floor((F.col("before") - F.col("from")) / F.col("half")))
            .otherwise(0).alias("part"),
            F.when(F.col("over"), 2 * F.col("bigs") - F.col("big")).otherwise(0)
            .alias("part_alone")).alias("win"))


def windows(conversations: DataFrame) -> DataFrame:
    """One row per window: conv_id, window (its order), n_repeated turns at
    its head, first (the number of its first new turn), formatted, and the
    loss mask as spans (start, length) in code points of ``formatted``.

    The conversations are read once: costed turns are stored, their places
    are worked out without the texts and stored, and then joined."""
    stored = materialize(costed(conversations), "chat-turns")
    rows = materialize(_within_budget(placed(stored)), "chat-places")
    bounds = rows.groupBy("conv_id", "win").agg(
        F.min("at").alias("first"), F.min("before").alias("from"),
        (F.min("room") - F.sum("cost")).alias("free"))
    every = Window.partitionBy("conv_id").orderBy("win")
    bounds = bounds.select("conv_id", "win", F.lead(
        F.struct("win", "first", "from", "free")).over(every).alias("next"))
    rows = _same_turn(rows, bounds, "conv_id", "win")
    # A turn goes into its own window, and as history into the next one.
    history = (F.col("next").isNotNull()
               & (F.col("next.first") - F.col("at") <= HISTORY_TURNS)
               & (F.col("next.from") - F.col("before") <= F.least(
                   F.lit(HISTORY_TOKENS), F.col("next.free")))
               & ~F.col("is_system"))
    texts = _same_turn(stored.select("conv_id", "stretch", "n_in", "role", "text"), rows.select(
        "conv_id", "stretch", "n_in", "at", "is_system", "win",
        F.when(history, F.col("next.win")).alias("later")), "conv_id", "stretch", "n_in")
    own = F.struct(F.col("win"), F.struct("at", F.lit(False).alias("again"), "role", "text").alias("t"))
    again = F.struct(F.col("later").alias("win"), F.struct(
        "at", F.lit(True).alias("again"), "role", "text").alias("t"))
    grouped = texts.select("conv_id", F.explode(F.when(
        F.col("later").isNotNull(), F.array(own, again)).otherwise(F.array(own))).alias("x"))
    grouped = grouped.groupBy("conv_id", F.col("x.win").alias("win")).agg(
        F.sort_array(F.collect_list("x.t")).alias("ts"))
    # At most one row per conversation.
    first_turn = (F.col("n_in") == 1) & (F.col("role") == "system")
    system = _same_turn(stored.where(first_turn).select("conv_id", "stretch", "n_in", "role", "text"),
                        rows.where("is_system").select("conv_id", "stretch", "n_in", "at"),
                        "conv_id", "stretch", "n_in").select(
        F.col("conv_id").alias("cid"), F.struct("at", "role", "text").alias("system"))
    grouped = grouped.withColumn("first", F.array_min(F.transform(
        F.filter("ts", lambda t: ~t["again"]), lambda t: t["at"])))
    grouped = grouped.join(system, F.col("conv_id").eqNullSafe(F.col("cid")), "left")
    repeat = F.col("system").isNotNull() & (F.col("first") > 0)
    all_turns = F.when(repeat, F.concat(F.array(F.struct(
        F.col("system.at").alias("at"), F.lit(True).alias("again"),
        F.col("system.role").alias("role"), F.col("system.text").alias("text"))),
        F.col("ts"))).otherwise(F.col("ts"))
    shown = F.transform(all_turns, lambda t: F.struct(
        t["again"].alias("again"), (t["role"] == "assistant").alias("learn"),
        F.concat(F.lit(START), _role(t["role"]), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body")))
    grouped = grouped.select("conv_id", "win", "first", F.explode(F.array(shown)).alias("s"))
    spans = F.aggregate(
        "s", F.struct(F.lit(0).alias("at"), F.array().cast(
            "array<struct<start:int,length:int>>").alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + F.length(s["head"]) + F.length(s["body"]) + len(END)).alias("at"),
            F.when(s["learn"] & ~s["again"], F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(s["head"])).alias("start"),
                F.length(s["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return grouped.select(
        "conv_id", F.col("win").alias("window"), "first",
        F.size(F.filter("s", lambda s: s["again"])).alias("n_repeated"),
        F.array_join(F.transform("s", lambda s: F.concat(s["head"], s["body"], F.lit(END))), "")
        .alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from the windows alone: turns that a window
    repeats are left out, marked spans are put together."""
    # The last piece of the split is what follows the last end mark: empty.
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    new = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))

    def turn(piece: Column) -> Column:
        marked = F.substr(piece, F.lit(len(START) + 1))
        line = F.instr(marked, "\n")
        return F.concat(_role_back(F.substr(marked, F.lit(1), line - 1)), F.lit("\n"),
                        unescape(F.substr(marked, line + 1)), F.lit("\n"))

    part = formatted.select(
        "conv_id", "first", F.size(new).cast("long").alias("n_turns"),
        F.array_join(F.transform(new, turn), "").alias("turns"),
        F.array_join(F.transform("loss", lambda x: unescape(F.substr(
            F.col("formatted"), x["start"] + 1, x["length"]))), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"))
    whole = part.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
        F.sort_array(F.collect_list(F.struct("first", "turns", "loss"))).alias("parts"))
    joined = whole.select(
        "conv_id", "n_turns", "formatted_chars", "n_windows",
        F.array_join(F.transform("parts", lambda p: p["turns"]), "").alias("turns"),
        F.explode(F.array(F.array_join(F.transform("parts", lambda p: p["loss"]), "")))
        .alias("loss"))
    return joined.select(
        "conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
        "n_windows")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
k AS (
  SELECT *, CAST(len(regexp_extract_all(text, 'TOKEN'))
              + len(regexp_extract_all(role, 'TOKEN')) + 4 AS BIGINT) AS cost,
    row_number() OVER o - 1 AS pos
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
b AS (
  SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY pos
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    2 * sum(CASE WHEN cost * 2 > 512 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos)
      - CASE WHEN cost * 2 > 512 THEN 1 ELSE 0 END AS alone,
    (pos = 0 AND role = 'system') AS sys,
    length(regexp_replace(text, 'ESCAPE', '\1\\\2\3', 'g')) + 12 + 1 + 11
      + length(replace(replace(regexp_replace(role, 'ESCAPE', '\1\\\2\3', 'g'), '\', '\b'),
                       chr(10), '\n')) AS chars
  FROM k),
w AS (
  SELECT conv_id, before // 512 AS stride, alone, min(pos) AS first, min(before) AS start,
    sum(cost) AS new FROM b GROUP BY ALL),
room AS (
  SELECT conv_id, 1024 - coalesce(sum(cost) FILTER (sys), 0) AS room FROM b GROUP BY conv_id),
over AS (
  SELECT w.*, room, greatest(room // 2, 1) AS half, first > 0 AND new > room AND room > 0 AS over
  FROM w JOIN room ON room.conv_id IS NOT DISTINCT FROM w.conv_id),
cut AS (
  SELECT b.*, stride, room,
    CASE WHEN over THEN (before - start) // half ELSE 0 END AS part,
    CASE WHEN over THEN 2 * sum((cost > room - half)::INT) OVER (
      PARTITION BY b.conv_id, stride, b.alone ORDER BY pos) - (cost > room - half)::INT
      ELSE 0 END AS part_alone
  FROM b JOIN over ON over.conv_id IS NOT DISTINCT FROM b.conv_id
    AND over.stride = b.before // 512 AND over.alone = b.alone),
n AS (
  SELECT *, lead(first) OVER v AS next_first, lead(start) OVER v AS next_start,
    lead(free) OVER v AS next_free
  FROM (SELECT conv_id, stride, alone, part, part_alone, min(pos) AS first, min(before) AS start,
      min(room) - sum(cost) AS free FROM cut GROUP BY ALL)
  WINDOW v AS (PARTITION BY conv_id ORDER BY stride, alone, part, part_alone)),
h AS (
  SELECT t.conv_id, sum(t.chars) AS chars FROM cut t JOIN n
    ON n.conv_id IS NOT DISTINCT FROM t.conv_id AND n.stride = t.stride AND n.alone = t.alone
   AND n.part = t.part AND n.part_alone = t.part_alone
  WHERE NOT sys AND next_first - pos <= 2 AND next_start - before <= least(160, next_free)
  GROUP BY t.conv_id),
s AS (
  SELECT b.conv_id, b.chars * count(*) AS chars FROM b JOIN n
    ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.first > 0
  WHERE sys GROUP BY b.conv_id, b.chars),
r AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(chars) AS BIGINT) AS chars
  FROM b GROUP BY conv_id),
nw AS (SELECT conv_id, count(*) AS n_windows FROM n GROUP BY conv_id)
SELECT r.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256,
  CAST(r.chars + coalesce(h.chars, 0) + coalesce(s.chars, 0) AS BIGINT) AS formatted_chars,
  n_windows
FROM r LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM r.conv_id
  LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM r.conv_id
  LEFT JOIN nw ON nw.conv_id IS NOT DISTINCT FROM r.conv_id
""".replace("TOKEN", TOKEN).replace("ESCAPE", ESCAPE)


def op7_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of one made of control strings."""
    # Two rows as literals of the plan.
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), "
                      "(-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') "
                      "AS t(conv_id, turn, role, text)")
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(windows(rows.unionByName(probe)))
