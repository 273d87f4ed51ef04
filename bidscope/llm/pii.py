"""Personal data (operator 9): base patterns and bootstrapped contexts.

Seeds are what four fixed patterns find (email, ip, card, phone).  The two
words before an entity, and what stands before it inside its own word, are a
context.  Contexts and the identifiers they precede form a graph: a context's
score is the expected share of identifiers among all its occurrences in the
corpus, an identifier's score the chance that one of its contexts is right
(a seed's is 1), in turn for rounds of Spark joins.  Identifiers that an
accepted context reveals count as known in the next round and bring further
contexts, so identifiers that no seed's context precedes are found too, in up
to ``GENERATIONS`` rounds.  Identifiers (runs of letters and digits with three digits or more) that follow a context
of at least ``ACCEPT`` become spans of kind ``context``; base spans stay.

A context counts if ``MIN_SEEDS`` different known items stand behind it,
however large the table.  Up to ``BROADCAST_CONTEXTS`` (counted) contexts are
broadcast to the scan that counts their occurrences and to the one that finds
spans; above that both join on the context's hash, with equal results.

Defined results: null text counts as empty; very long texts are read whole,
their contexts from the real starts of the words before; rows are treated one by one, so
repeated rows give repeated results; an empty table gives no rows; other
columns are not read, and pass through ``redact`` unchanged.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_bounded, row_count_at_most
from .common import byte_slices, materialize, read, split_words, string_array, text_of

# The base patterns.
PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)
KINDS = tuple(name for name, _ in PATTERNS)
CONTEXT = "context"
# Identifiers that a context can reveal: letters, digits and inner marks.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z_-]*[0-9][A-Za-z0-9_-]*")
MIN_DIGITS, MIN_LENGTH = 3, 6

MIN_SEEDS = 5
# Contexts that a scan holds in memory (8 bytes each, and a set); more of them
# are joined instead.
BROADCAST_CONTEXTS = 1_000_000
# Distinct word pairs that a counting task holds before it hands them on.
COUNTED = 1 << 20
ACCEPT = 0.5
ROUNDS = 3
# Rounds in all, while new contexts are found.
GENERATIONS = 24
# Counts added to a context's occurrences, against rare ones.
DOUBT = 1.0

_BREAK = re.compile("[ \t\n\x0b\x0c\r]+")
# What may stand before an entity inside its own word.
_LEAD = re.compile(r"""[^0-9]*[:="'(<\[]""")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _valid(kind: str, text: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                   for p in text.split("."))
    digits = _digits(text)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if not 16 <= len(digits) <= 19:
        return False
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) in code points, by kind, then start."""
    out = []
    for number, (kind, pattern) in enumerate(PATTERNS):
        if kind == "email":
            if "@" not in text:
                continue
            out += [(number, m.start(), m.end()) for m in _emails(text, pattern)]
        elif kind != "phone" or "+" in text:
            out += [(number, m.start(), m.end()) for m in pattern.finditer(text)
                    if _valid(kind, m.group())]
    return out


_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def _emails(text: str, pattern: re.Pattern):
    """The pattern's matches, looked for only where an @ has a local part."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and not _NOT_LOCAL.match(text, first - 1):
            first -= 1
        m = pattern.match(text, first) if first < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(done, at + 1))


def identifiers(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifiers outside the spans that are ``taken``."""
    out = []
    busy = sorted((s, e) for _, s, e in taken)
    starts = [s for s, _ in busy]
    ends = [0, *accumulate((e for _, e in busy), max)]
    for m in IDENTIFIER.finditer(text):
        first, last = m.span()
        while last > first and text[last - 1] in "-_":
            last -= 1
        while first < last and text[first] in "-_":
            first += 1
        if last - first < MIN_LENGTH or len(_digits(text[first:last])) < MIN_DIGITS:
            continue
        # The furthest end of all spans that start before this one's end.
        if ends[bisect_left(starts, last)] <= first:
            out.append((first, last))
    return out


def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower())


def _lead(word: str) -> str:
    m = _LEAD.match(word)
    return m.group() if m else ""


_STEP = 0x9E3779B97F4A7C15
_ALL = 0xFFFFFFFFFFFFFFFF


def _context_hash(second: int, first: int, lead: int) -> int:
    """A signed 64-bit number for the words before and the lead."""
    value = (((second * _STEP + first) & _ALL) * _STEP + lead) & _ALL
    value ^= value >> 32
    return value - (1 << 64) if value >> 63 else value


def context_of(text: str, start: int) -> int | None:
    """The context of what starts at ``start``; None if other characters
    than a lead stand before it in its word."""
    reach = 256
    while True:
        begin = max(0, start - reach)
        words = _BREAK.split(text[begin:start])
        # The first piece may be the rest of a word.
        before = [w for w in words[begin > 0:-1] if w][-2:]
        if begin == 0 or len(before) == 2:
            break
        reach *= 4
    lead = words[-1]
    if lead and _lead(lead) != lead:
        return None
    hashes = [0] * (2 - len(before)) + [_word_hash(w) for w in before]
    return _context_hash(hashes[0], hashes[1], _word_hash(lead) if lead else 0)


def _interesting(texts: pa.Array) -> np.ndarray:
    """Texts that can hold an entity or an identifier at all."""
    return pc.match_substring_regex(texts, "[0-9@]").to_numpy(zero_copy_only=False)


def find_entities(docs: DataFrame) -> DataFrame:
    """(context, item, seed) of every entity and identifier with a context."""

    def scan(batches):
        for batch in batches:
            texts = string_array(batch.column("text"))
            rows = []
            for text in texts.filter(pa.array(_interesting(texts))).to_pylist():
                spans = base_spans(text)
                for first, last, seed in [(s, e, True) for _, s, e in spans] + [
                        (s, e, False) for s, e in identifiers(text, spans)]:
                    context = context_of(text, first)
                    if context is not None:
                        rows.append((context, hashlib.md5(
                            text[first:last].lower().encode("utf-8", "replace")).digest(), seed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows) if rows else ([], [], []), (pa.int64(), pa.binary(), pa.bool_()))],
                names=["context", "item", "seed"])

    return docs.select(text_of().alias("text")).mapInArrow(
        scan, "context long, item binary, seed boolean")


def _context_values(texts: pa.Array):
    """The context of every word, as unsigned arrays of bounded size."""
    step = np.uint64(_STEP)
    for first, last in byte_slices(texts):
        words, index, offsets = split_words(texts.slice(first, last - first))
        if not len(index):
            continue
        names = words.to_pylist()
        h = np.fromiter(map(_word_hash, names), np.uint64, len(names))
        lead = np.zeros(len(names), np.uint64)
        for i in np.flatnonzero(pc.match_substring_regex(
                words, r"""[:="'(<\[]""").to_numpy(zero_copy_only=False)).tolist():
            found = _lead(names[i])
            lead[i] = _word_hash(found) if found else 0
        h, lead = h[index], lead[index]
        place = np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))
        one = np.where(place >= 1, np.roll(h, 1), np.uint64(0))
        two = np.where(place >= 2, np.roll(h, 2), np.uint64(0))
        value = (two * step + one) * step + lead
        value ^= value >> np.uint64(32)
        yield value


def _held(contexts: np.ndarray | DataFrame, limit: int) -> np.ndarray | None:
    """The contexts, sorted, if there are at most ``limit``."""
    if isinstance(contexts, DataFrame):
        if not row_count_at_most(contexts, limit):
            return None
        contexts = contexts.select("context").toArrow().column(0).to_numpy()
    return np.sort(np.asarray(contexts, np.int64))


def count_contexts(docs: DataFrame, contexts: np.ndarray | DataFrame,
                   limit: int = BROADCAST_CONTEXTS) -> DataFrame:
    """(context, n): occurrences of the listed contexts in all texts,
    whatever word follows.  More than ``limit`` contexts are joined with the
    counts of all word pairs, which tasks add up before the shuffle."""
    held = _held(contexts, limit)
    wanted = None if held is None else docs.sparkSession.sparkContext.broadcast(held)

    def scan(batches):
        known = np.sort(wanted.value.view(np.uint64))
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for value in _context_values(string_array(batch.column("text"))):
                if not len(known):
                    continue
                at = np.searchsorted(known, value)
                at[at == len(known)] = 0
                total += np.bincount(at[known[at] == value], minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.record_batch({"context": pa.array(known[seen].view(np.int64)),
                               "n": pa.array(total[seen])})

    def count_all(batches):
        seen, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for value in _context_values(string_array(batch.column("text"))):
                new, c = np.unique(value, return_counts=True)
                seen, at = np.unique(np.concatenate([seen, new]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, c])).astype(np.int64)
                if len(seen) > COUNTED:
                    yield pa.record_batch({"context": pa.array(seen.view(np.int64)),
                                           "n": pa.array(n)})
                    seen, n = seen[:0], n[:0]
        yield pa.record_batch({"context": pa.array(seen.view(np.int64)), "n": pa.array(n)})

    counted = docs.select(text_of().alias("text")).mapInArrow(
        count_all if held is None else scan, "context long, n long").groupBy(
        "context").agg(F.sum("n").alias("n"))
    return counted if held is not None else counted.join(
        contexts.select("context"), "context", "left_semi")


def learn_contexts(docs: DataFrame, min_seeds: int = MIN_SEEDS, accept: float = ACCEPT,
                   rounds: int = ROUNDS, limit: int = BROADCAST_CONTEXTS) -> DataFrame:
    """The accepted contexts, as a stored table with a column ``context``.

    Each round takes as candidates the contexts before ``min_seeds`` different
    items that are known so far (seeds, and identifiers of a score of
    ``accept`` or more), counts the occurrences of the new ones, and scores
    contexts and items once.  It ends with the ``rounds``-th round in a row
    without new candidates, or after ``GENERATIONS`` rounds."""
    edges = materialize(find_entities(docs).groupBy("context", "item").agg(
        F.count("*").alias("c"), F.max("seed").alias("seed")), "pii-edges")
    # An identifier that is a seed anywhere is one everywhere.
    items = materialize(edges.groupBy("item").agg(
        F.max(F.col("seed").cast("double")).alias("score")), "pii-items")
    occurrences = scored = None
    quiet = 0
    for _ in range(GENERATIONS):
        known = items.where(F.col("score") >= accept).select("item")
        backed = edges.join(known, "item").groupBy("context").agg(
            F.count("*").alias("items")).where(F.col("items") >= min_seeds).select("context")
        if occurrences is not None:
            backed = backed.join(occurrences, "context", "left_anti")
        backed = materialize(backed, "pii-candidates")
        if backed.isEmpty():
            if occurrences is None:
                return backed
            quiet += 1
            if quiet >= rounds:
                break
        else:
            quiet = 0
            counted = count_contexts(docs, backed, limit)
            occurrences = materialize(counted if occurrences is None else
                                      occurrences.unionByName(counted), "pii-contexts")
        graph = edges.join(broadcast_if_bounded(occurrences, limit), "context")
        scored = materialize(graph.join(items, "item").groupBy("context").agg(
            (F.sum(F.col("c") * F.col("score")) / (F.max("n") + DOUBT)).alias("s")).select(
            "context", F.least("s", F.lit(0.999999)).alias("s")), "pii-scores")
        found = graph.join(scored, "context").groupBy("item").agg(
            F.sum(F.log1p(-F.col("s"))).alias("miss"))
        sure = edges.groupBy("item").agg(F.max(F.col("seed").cast("double")).alias("sure"))
        items = materialize(sure.join(found, "item", "left").select("item", F.greatest(
            "sure", F.coalesce(1 - F.exp("miss"), F.lit(0.0))).alias("score")), "pii-items")
    return materialize(scored.where(F.col("s") >= accept).select("context"), "pii-accepted")


def _unused(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def _with_contexts(rows: DataFrame, contexts: np.ndarray | DataFrame,
                   limit: int) -> tuple[DataFrame, str, object]:
    """What a scan of ``rows`` (with a column ``text``) needs to know the
    accepted contexts: the rows, the name of a further column, and a function
    (batch) -> set of contexts for each row.

    Up to ``limit`` contexts are broadcast.  More are joined with the contexts
    that stand in a text, so that each row brings its own; a text is known by
    its hash there, as equal texts have equal contexts."""
    name = _unused(rows.columns, "found")
    held = _held(contexts, limit)
    if held is not None:
        accepted = rows.sparkSession.sparkContext.broadcast(held)
        known: list[set[int]] = []

        def same(batch):
            if not known:
                known.append(set(accepted.value.tolist()))
            return known * batch.num_rows

        return rows, name, same

    def scan(batches):
        for batch in batches:
            texts = string_array(batch.column("text"))
            hits = np.flatnonzero(_interesting(texts))
            keys, found = [], []
            for i, text in zip(hits.tolist(), texts.take(pa.array(hits)).to_pylist()):
                some = {context_of(text, s) for s, _ in identifiers(text, base_spans(text))}
                some.discard(None)
                keys += [i] * len(some)
                found += some
            yield pa.record_batch({"key": batch.column("key").take(pa.array(keys, pa.int64())),
                                   "context": pa.array(found, pa.int64())})

    key = _unused([*rows.columns, name], "key")
    hashed = F.md5(text_of().cast("binary"))
    per_text = rows.select(hashed.alias("key"), text_of().alias("text")).mapInArrow(
        scan, "key string, context long").distinct().join(
        contexts.select("context"), "context").groupBy("key").agg(
        F.collect_list("context").alias(name)).withColumnRenamed("key", key)
    joined = rows.withColumn(key, hashed).join(per_text, key, "left").drop(key)
    return joined, name, lambda batch: [set(x or ()) for x in batch.column(name).to_pylist()]


def all_spans(text: str, contexts: set[int]) -> tuple[list, list]:
    """(base spans, spans that accepted contexts add), each (kind, start, end)."""
    base = base_spans(text)
    added = []
    if contexts:
        added = [(len(KINDS), s, e) for s, e in identifiers(text, base)
                 if context_of(text, s) in contexts]
    return base, added


_NAMES = (*KINDS, CONTEXT)


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{_NAMES[k]}:{s}:{e}" for k, s, e in spans)


SPANS = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
         "spans string")
_EMPTY = hashlib.sha256(b"").hexdigest()


def find_spans(docs: DataFrame, contexts: np.ndarray | DataFrame,
               limit: int = BROADCAST_CONTEXTS) -> DataFrame:
    """Counts, digest and spans of every document."""
    rows, _, known_of = _with_contexts(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), contexts, limit)

    def scan(batches):
        for batch in batches:
            known = known_of(batch)
            texts = string_array(batch.column("text"))
            n = len(texts)
            counts = np.zeros((len(KINDS), n), np.int64)
            digest, spans = [_EMPTY] * n, [""] * n
            hits = np.flatnonzero(_interesting(texts))
            for i, text in zip(hits.tolist(), texts.take(pa.array(hits)).to_pylist()):
                base, added = all_spans(text, known[i])
                for kind, _, _ in base:
                    counts[kind, i] += 1
                if base:
                    digest[i] = hashlib.sha256(_shown(base).encode()).hexdigest()
                spans[i] = _shown(base + added)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                **{f"n_{kind}": pa.array(counts[k]) for k, kind in enumerate(KINDS)},
                "base_sha256": pa.array(digest, pa.string()),
                "spans": pa.array(spans, pa.string())})

    return rows.mapInArrow(scan, SPANS)


def masked(text: str, contexts: set[int]) -> str:
    """The text with every span, or run of overlapping spans, as its kind."""
    base, added = all_spans(text, contexts)
    out, done, end = [], 0, -1
    for start, stop, kind in sorted((s, e, k) for k, s, e in base + added):
        if start >= end:
            out += [text[done:start], f"<{_NAMES[kind].upper()}>"]
        end = max(end, stop)
        done = end
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, contexts: np.ndarray | DataFrame,
           limit: int = BROADCAST_CONTEXTS) -> DataFrame:
    """``docs`` with their columns, texts masked, ``n_chars`` (if there)
    counted anew where the text has changed; null texts stay null."""
    columns = docs.columns
    out = docs.withColumn("text", F.col("text").cast("string"))
    rows, name, known_of = _with_contexts(out, contexts, limit)

    def mask(batches):
        for batch in batches:
            known = known_of(batch)
            if name in batch.schema.names:
                batch = batch.drop_columns([name])
            texts = string_array(batch.column("text"))
            hits = np.flatnonzero(_interesting(texts))
            new = [None] * len(texts)
            for i, text in zip(hits.tolist(), texts.take(pa.array(hits)).to_pylist()):
                clean = masked(text, known[i])
                new[i] = clean if clean != text else None
            column = pc.coalesce(pa.array(new, pa.string()), batch.column("text").cast(pa.string()))
            yield batch.set_column(batch.schema.get_field_index("text"), "text", column)

    changed = rows.mapInArrow(mask, out.schema)
    if "n_chars" in columns:
        length: Column = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(
            F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return changed.select(*[F.col(f"`{c}`") for c in columns])


def op9_bootstrapped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = read(spark, sf_dir, "documents")
    return find_spans(docs, learn_contexts(docs))
