"""Dataset profile.

E1 is one global aggregate (partial counts per task, one final row).  E2, the
first ten distinct values of every column in order of first appearance, is
the only part that needs per-partition code: a lossless prune keeps at most
ten candidates per column per partition before the shuffle, so the exchange
carries ``10 x columns x partitions`` rows however large the table is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import OPPORTUNITY_BUCKETS, SET_ASIDE_BUCKETS
from ..functions.dates import COMPACT_RE, LONGEST, force_date, may_be_date
from ..functions.text import PY_WHITESPACE_CLASS, any_substring, col_ref, py_strip
from ..session import materialize
from .project import disambiguate

EXAMPLES_PER_COLUMN = 10  # fixed value: example values per column


def _non_null(c: Column, dt: T.DataType) -> Column:
    """pandas ``notna``: NULL and, for floats, NaN are missing."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def count_rows(df: DataFrame) -> DataFrame:
    """One row ``row_count, column_count``."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"))


def profile_counts(df: DataFrame) -> DataFrame:
    """``name, position, dtype, non_null_count, row_count,
    column_count``, one row per column, from a single aggregate pass."""
    df = disambiguate(df)
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count(F.when(_non_null(col_ref(f.name), f.dataType), F.lit(1))).alias(f"_c{i}")
             for i, f in enumerate(fields)]
    one = df.agg(*aggs)
    entries = F.array(*[
        F.struct(F.lit(f.name).alias("name"), F.lit(i).alias("position"),
                 F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col(f"_c{i}").alias("non_null_count"))
        for i, f in enumerate(fields)])
    return (one.select(F.col("_rows").alias("row_count"), F.explode(entries).alias("e"))
               .select("e.name", "e.position", "e.dtype", "e.non_null_count", "row_count",
                       F.lit(len(fields)).alias("column_count")))


def _value_text(c: Column, dt: T.DataType) -> Column:
    """The text form of a value as the profile shows it; NaN is missing."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("string"))
    return c.cast("string")


def _prune_partition(n: int, ncols: int, key_type: pa.DataType, scan_order: bool):
    """Per-partition candidates: for each column the ``n`` distinct values
    with the smallest first keys, in whatever order rows arrive.

    Losslessness: once ``n`` values are held, a row whose key is beyond their
    largest cannot matter, and that bound only falls; a value that has been
    pushed out comes back with a smaller key or is not among the first ``n``.
    So a batch is cut to the rows within the bounds before it is sorted, and
    only a batch's distinct values (Arrow's dictionary) become Python objects.

    The same pass counts non-null values per column (Arrow keeps null counts
    per batch, so this costs nothing) and rows: E1 rides along with E2.

    In scan order the key is the row's position, rebuilt here as
    ``partition << 33 | row`` (the layout of ``monotonically_increasing_id``)
    instead of being shipped with every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 33
        first_col = 0 if scan_order else 1
        found: list[dict] = [dict() for _ in range(ncols)]  # value -> first key
        present = [0] * ncols
        offset = 0
        for batch in batches:
            start, offset = offset, offset + batch.num_rows
            for i in range(ncols):
                present[i] += batch.num_rows - batch.column(i + first_col).null_count
            full = all(len(seen) >= n for seen in found)
            if full and scan_order:
                continue  # later rows have larger keys
            if scan_order:
                keys = pa.array(base + start + np.arange(batch.num_rows, dtype=np.int64))
            else:
                keys = batch.column(0)
                keep = pc.is_valid(keys)  # rows without a key give no example
                if full:
                    bound = max(max(seen.values()) for seen in found)
                    keep = pc.and_kleene(keep, pc.less_equal(keys, pa.scalar(bound, keys.type)))
                batch = batch.filter(keep)
                batch = batch.take(pc.sort_indices(batch.column(0)))
                keys = batch.column(0)
            for i, seen in enumerate(found):
                if scan_order and len(seen) >= n:
                    continue
                vals = batch.column(i + first_col)
                coded = vals.dictionary_encode()
                codes = coded.indices.drop_null().to_numpy(zero_copy_only=False)
                if not len(codes):
                    continue
                rows = np.flatnonzero(pc.is_valid(vals).to_numpy(zero_copy_only=False))
                which, first = np.unique(codes, return_index=True)
                order = np.argsort(first, kind="stable")
                for code, row in zip(which[order].tolist(), rows[first[order]].tolist()):
                    k = keys[row].as_py()
                    if len(seen) >= n and k > max(seen.values()):
                        break
                    v = coded.dictionary[code].as_py()
                    if v not in seen or k < seen[v]:
                        seen[v] = k
                    if len(seen) > n:
                        del seen[max(seen, key=lambda x: (seen[x], x))]
        cols, values, keys_out, counts = [], [], [], []
        for i, seen in enumerate(found):
            for v, k in seen.items():
                cols.append(i)
                values.append(v)
                keys_out.append(k)
                counts.append(None)
        for i in range(ncols):            # count rows: value NULL
            cols.append(i)
            values.append(None)
            keys_out.append(None)
            counts.append(present[i])
        cols.append(-1)                    # the partition's row count
        values.append(None)
        keys_out.append(None)
        counts.append(offset)
        yield pa.RecordBatch.from_pydict({"col": pa.array(cols, pa.int32()),
                                          "value": pa.array(values, pa.string()),
                                          "_k": pa.array(keys_out, key_type),
                                          "n": pa.array(counts, pa.int64())})

    return run


def _pruned(df: DataFrame, n: int, order_by: str | None):
    """One pass over ``df``: per partition, the E2 candidates and E1 counts,
    merged per ``(col, value)``.  Returns the merged frame and the fields."""
    from pyspark.sql.pandas.types import to_arrow_type
    fields = df.schema.fields
    values = [_value_text(col_ref(f.name), f.dataType).alias(f"c{i}")
              for i, f in enumerate(fields)]
    if order_by:
        key_type = df.schema[order_by].dataType
        texts = df.select(col_ref(order_by).alias("_k"), *values)
    else:
        key_type = T.LongType()
        texts = df.select(*values)
    out_schema = T.StructType([T.StructField("col", T.IntegerType()),
                               T.StructField("value", T.StringType()),
                               T.StructField("_k", key_type),
                               T.StructField("n", T.LongType())])
    pruned = texts.mapInArrow(_prune_partition(n, len(fields), to_arrow_type(key_type),
                                               scan_order=order_by is None), out_schema)
    merged = pruned.groupBy("col", "value").agg(F.min("_k").alias("_k"), F.sum("n").alias("n"))
    return merged, fields


def _ranked_examples(merged: DataFrame, fields, n: int) -> DataFrame:
    firsts = merged.where(F.col("value").isNotNull() & F.col("_k").isNotNull())
    w = Window.partitionBy("col").orderBy(F.col("_k").asc(), F.col("value").asc())
    names = F.array(*[F.lit(f.name) for f in fields])
    return (firsts.withColumn("example_rank", F.row_number().over(w))
                  .where(F.col("example_rank") <= n)
                  .select(F.get(names, F.col("col")).alias("name"),
                          "example_rank", F.col("value").alias("example_value")))


def first_distinct_values(df: DataFrame, n: int = EXAMPLES_PER_COLUMN,
                          order_by: str | None = None) -> DataFrame:
    """``name, example_rank, example_value`` -- the first ``n``
    distinct non-null values of each column, in order of first appearance.

    Order of appearance is the caller's ``order_by`` key (a unique row
    order; rows may arrive in any), else the scan order
    (``monotonically_increasing_id``, already ascending).
    Losslessness of the prune: a value's rank inside one partition never
    exceeds its global rank, so the global top ``n`` survive.
    """
    df = disambiguate(df)
    merged, fields = _pruned(df, n, order_by)
    return _ranked_examples(merged, fields, n)


def profile(df: DataFrame, n: int = EXAMPLES_PER_COLUMN, order_by: str | None = None) -> DataFrame:
    """E1 + E2 from ONE pass: one row per column with ``non_null_count`` and
    ``example_values ARRAY<STRING>``, plus ``row_count`` and ``column_count``.

    A single chain, so the table is read once: the Arrow pass emits
    candidates and counts; one window per column puts the count row first
    and the candidates after it, keeping ``n + 1`` rows (a window group
    limit, applied before the shuffle); then one small row per column.
    """
    df = disambiguate(df)
    merged, fields = _pruned(df, n, order_by)
    w = Window.partitionBy("col").orderBy(F.col("value").isNull().desc(),
                                          F.col("_k").asc(), F.col("value").asc())
    ranked = (merged.where(F.col("value").isNull() | F.col("_k").isNotNull())
                    .withColumn("_r", F.row_number().over(w))
                    .where(F.col("_r") <= n + 1))
    per_col = ranked.groupBy("col").agg(
        F.max(F.when(F.col("value").isNull(), F.col("n"))).alias("count"),
        F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(),
                                           F.struct(F.col("_r"), F.col("value")))))
        .getField("value").alias("examples"))
    table = per_col.groupBy().agg(F.map_from_entries(F.collect_list(
        F.struct("col", F.struct("count", "examples")))).alias("m"))
    meta = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"),
                              F.lit(f.dataType.simpleString()).alias("dtype"))
                     for i, f in enumerate(fields)])
    entry = F.col("m")[F.col("c.position")]
    return table.select(F.explode(meta).alias("c"), "m").select(
        "c.name", "c.position", "c.dtype",
        F.coalesce(entry.getField("count"), F.lit(0)).alias("non_null_count"),
        F.coalesce(entry.getField("examples"), F.array().cast("array<string>"))
        .alias("example_values"),
        F.coalesce(F.col("m")[F.lit(-1)].getField("count"), F.lit(0)).alias("row_count"),
        F.lit(len(fields)).alias("column_count"))


def profile_document(df: DataFrame, n: int = EXAMPLES_PER_COLUMN,
                     order_by: str | None = None) -> DataFrame:
    """The profile as one JSON document (``row_count``, ``column_count``,
    ``columns`` in schema order), the shape a planner reads."""
    p = profile(df, n, order_by)
    doc = (p.groupBy("row_count", "column_count")
            .agg(F.sort_array(F.collect_list(F.struct(
                "position", "name", "dtype", "non_null_count", "example_values"))).alias("cols")))
    cols = F.transform("cols", lambda x: F.struct(
        x["name"].alias("name"), x["dtype"].alias("dtype"),
        x["non_null_count"].alias("non_null_count"), x["example_values"].alias("example_values")))
    return doc.select(F.to_json(F.struct("row_count", "column_count",
                                         cols.alias("columns"))).alias("profile"))


ROLES = ("date", "set_aside", "type", "naics")


_SA_PATTERNS = [p for _, pats in SET_ASIDE_BUCKETS for p in pats]
_TY_PATTERNS = [p for _, pats in OPPORTUNITY_BUCKETS for p in pats]
_NAICS = f"^{PY_WHITESPACE_CLASS}*[0-9]{{6}}{PY_WHITESPACE_CLASS}*$"
# Patterns that hold a digit are tested before digits are made alike.
_WITH_DIGIT = sorted({p for p in _SA_PATTERNS + _TY_PATTERNS if any(c.isdigit() for c in p)})


def _text_roles(text: Column) -> dict[str, Column]:
    low = py_strip(F.lower(text))
    return {"set_aside": any_substring(low, _SA_PATTERNS), "type": any_substring(low, _TY_PATTERNS),
            "naics": text.rlike(_NAICS)}


def _cells(df: DataFrame, positions: list[int]) -> DataFrame:
    """(position, text) of the non-null values of the columns there."""
    fields = df.schema.fields
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.when(
        _non_null(col_ref(fields[i].name), fields[i].dataType),
        col_ref(fields[i].name).cast("string")).alias("text")) for i in positions])
    return df.select(F.explode(cells).alias("c")).select("c.position", "c.text").where(
        "text is not null")


def cell_shapes(df: DataFrame) -> DataFrame:
    """(position, shape, n, then one flag per role of ``_text_roles``): the
    values of every column with all digits made alike, counted, and what they
    fit.  Values of more than ``LONGEST`` characters, which are no dates, are
    tested as they stand and counted without a shape, so keys stay short."""
    text = F.col("text")
    alike = F.translate(text, "123456789", "0" * 9)
    if _WITH_DIGIT:
        alike = F.when(any_substring(F.lower(text), _WITH_DIGIT), text).otherwise(alike)
    long = F.length("text") > LONGEST
    flags = F.when(long, F.struct(*[t.alias(r) for r, t in _text_roles(text).items()]))
    shapes = _cells(df, list(range(len(df.columns)))).select(
        "position", F.when(~long, alike).alias("shape"), flags.alias("long")).groupBy(
        "position", "shape", "long").agg(F.count("*").alias("n"))
    return shapes.select("position", "shape", "n", *[
        F.coalesce(F.col("long." + r), t, F.lit(False)).alias(r)
        for r, t in _text_roles(F.col("shape")).items()])


def _is_whole(dt: T.DataType) -> bool:
    return isinstance(dt, T.IntegralType)


def _date_hits(df: DataFrame, shapes: DataFrame) -> DataFrame:
    """(position, n): how many values of each column are dates.  Layouts are
    told from the shapes; only columns with such shapes are read again, and
    each distinct value of them is parsed once."""
    fields = df.schema.fields
    typed = [i for i, f in enumerate(fields) if isinstance(
        f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    whole = [i for i, f in enumerate(fields) if _is_whole(f.dataType)]
    maybe = F.when(F.col("position").isin(whole), F.col("shape").rlike(COMPACT_RE)).otherwise(
        may_be_date(F.col("shape")))
    found = sorted(r.position for r in shapes.where(
        ~F.col("position").isin(typed) & F.col("shape").isNotNull() & maybe).select(
        "position").distinct().collect())  # columns of df
    hits = shapes.where(F.col("position").isin(typed)).select("position", "n")
    for kind in ([i for i in found if i not in whole], [i for i in found if i in whole]):
        if kind:
            parsed = force_date(F.col("text").cast("bigint") if kind[0] in whole else F.col("text"),
                                fields[kind[0]].dataType if kind[0] in whole else None)
            values = _cells(df, kind).groupBy("position", "text").agg(F.count("*").alias("n"))
            hits = hits.unionByName(values.where(parsed.isNotNull()).select("position", "n"))
    return hits.groupBy("position").agg(F.sum("n").alias("date_hits"))


def candidate_columns(df: DataFrame) -> DataFrame:
    """Per column, how many non-null values look like a date, a
    set-aside text, an opportunity type or a six-digit NAICS code, plus the
    role a column fits (at least half its values, earlier role on ties).

    The cells are counted by shape in one pass (``cell_shapes``, written to
    the shared scratch folder), the tests run once per shape."""
    df = disambiguate(df)
    names = df.sparkSession.createDataFrame(
        [(i, f.name) for i, f in enumerate(df.schema.fields)], "position int, name string")
    shapes = materialize(cell_shapes(df), "cell-shapes")
    counts = shapes.groupBy("position").agg(
        F.sum("n").alias("non_null_count"),
        *[F.sum(F.when(F.col(r), F.col("n")).otherwise(0)).alias(f"{r}_hits") for r in ROLES[1:]])
    # One row per column on every side.
    out = names.join(counts, "position", "left").join(_date_hits(df, shapes), "position", "left")
    out = out.na.fill(0).select("name", "position", "non_null_count",
                                *[F.col(f"{r}_hits") for r in ROLES])
    best = F.greatest(*[F.col(f"{r}_hits") for r in ROLES])
    role = None
    for r in ROLES:
        cond = (F.col(f"{r}_hits") == best) & (best > 0) & (best * 2 >= F.col("non_null_count"))
        role = F.when(cond, F.lit(r)) if role is None else role.when(cond, F.lit(r))
    return out.withColumn("candidate_role", role)


def best_candidates(candidates: DataFrame) -> DataFrame:
    """E4 ranking: per role, columns ordered by hit share (ties: schema
    position) -- ``role, rank, name, hits, non_null_count``.  The input has
    one row per column, so the window is tiny."""
    per_role = candidates.select(
        "name", "position", "non_null_count",
        F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_hits").alias("hits"))
                            for r in ROLES])).alias("x")).select(
        "name", "position", "non_null_count", "x.role", "x.hits").where(F.col("hits") > 0)
    share = F.col("hits") / F.col("non_null_count")
    w = Window.partitionBy("role").orderBy(share.desc(), F.col("position").asc())
    return per_role.select("role", F.row_number().over(w).alias("rank"), "name", "hits",
                           "non_null_count")


def sample_rows(df: DataFrame, n: int | None = None, fraction: float | None = None,
                seed: int = 42) -> DataFrame:
    """E5: a repeatable sample.  ``fraction`` is Bernoulli sampling per task;
    ``n`` keeps the ``n`` rows with the smallest seeded row hash (a
    distributed top-n, no full sort)."""
    if fraction is not None:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    h = F.xxhash64(F.lit(seed), *[col_ref(c) for c in df.columns])
    return df.orderBy(h, *[col_ref(c) for c in df.columns]).limit(5 if n is None else n)
