"""Sources: CSV (S1), per-file Latin-1 fallback (S2), format dispatch (S4),
NA tokens (S5).

Every reader returns a lazy DataFrame.  Type inference is one aggregate pass
over the text columns (no driver-side sampling); with a given schema it is
skipped.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_ref
from ..operators.project import disambiguate
from ..session import materialize
from .csv_records import block_facts, raw_lines, records

# The missing-value spellings pandas' CSV reader turns into NA
# by default (pandas 2.x); a lone blank " " is not among them.
PANDAS_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                    "n/a", "nan", "null")

ROW_ID = "_row"

WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = (r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$")
# Spellings that a CSV reader takes for truth values.
TRUTHS = ("True", "TRUE", "true", "False", "FALSE", "false")


class UnsupportedFormat(ValueError):
    pass


def null_tokens(df: DataFrame, tokens: Sequence[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """NA spellings in text columns become SQL NULL (one projection)."""
    toks = list(tokens)
    cols = []
    for f in df.schema.fields:
        c = col_ref(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(toks), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _beyond_64_bits(whole: Column) -> Column:
    """Whether a whole number, as text, needs more than 64 bits.  Its digits
    tell: a cast that does not fit costs an exception per value."""
    digits = F.regexp_extract(whole, r"^\s*[+-]?0*([0-9]*)", 1)
    most = F.when(F.contains(whole, F.lit("-")), str(1 << 63)).otherwise(str((1 << 63) - 1))
    size = F.length(digits)
    return (F.length(whole) > 18) & ((size > 19) | ((size == 19) & (digits > most)))


def _fit_counts(names: Sequence[str]) -> list:
    """Per text column: its values, and how many are no whole number, whole
    numbers beyond 64 bits, no number, no truth value (Spark's casts take
    more, such as ``12D``)."""
    aggs = []
    for i, name in enumerate(names):
        c = col_ref(name)
        aggs += [F.count(c).alias(f"n{i}"),
                 F.count(F.when(~c.rlike(WHOLE), 1)).alias(f"w{i}"),
                 F.count(F.when(c.rlike(WHOLE) & _beyond_64_bits(c), 1)).alias(f"l{i}"),
                 F.count(F.when(~c.rlike(NUMBER), 1)).alias(f"d{i}"),
                 F.count(F.when(~c.isin(*TRUTHS), 1)).alias(f"b{i}")]
    return aggs


def infer_types(df: DataFrame, skip: Sequence[str] = (ROW_ID,), staged: bool = False) -> DataFrame:
    """Narrow text columns to BIGINT / DOUBLE / BOOLEAN when every non-null
    value fits, as a CSV reader's inference would; dates stay text.

    One aggregate job counts, per column, the values that do not fit.  With
    ``staged`` the same job writes the rows to the shared scratch folder, and
    the result reads them there instead of parsing the files again.
    """
    text_cols = [f.name for f in df.schema.fields
                 if isinstance(f.dataType, T.StringType) and f.name not in skip]
    if not text_cols:
        return df
    if staged:
        seen, names = Observation(), df.columns
        plain = df.toDF(*[f"c{i}" for i in range(len(names))])
        counted = plain.observe(seen, *_fit_counts([f"c{names.index(n)}" for n in text_cols]))
        df, r = materialize(counted, "csv-text").toDF(*names), seen.get
    else:
        r = df.agg(*_fit_counts(text_cols)).first()
    target = {}
    for i, name in enumerate(text_cols):
        if r[f"n{i}"] == 0:
            continue
        if r[f"w{i}"] == 0:
            # Digits beyond 64 bits are identifiers: they stay text.
            if r[f"l{i}"] == 0:
                target[name] = "bigint"
        elif r[f"d{i}"] == 0:
            target[name] = "double"
        elif r[f"b{i}"] == 0:
            target[name] = "boolean"
    if not target:
        return df
    return df.select(*[(col_ref(f.name).try_cast(target[f.name]) if f.name in target
                        else col_ref(f.name)).alias(f.name) for f in df.schema.fields])


def header_names(text: str) -> list[str]:
    """The column names of a header record, as a CSV reader names them: empty
    ones by place, and repeated ones numbered after the first."""
    text = text.lstrip("\ufeff").removesuffix("\r")
    names = next(csv.reader(io.StringIO(text, newline=""))) if text else []
    out: list[str] = []
    for i, name in enumerate(names):
        name = name or f"Unnamed: {i}"
        base, k = name, 0
        while name in out:
            k += 1
            name = f"{base}.{k}"
        out.append(name)
    return out


def _file_kinds(facts: DataFrame) -> DataFrame:
    """One row per file: ``file`` (hash of its path), ``utf8``, ``opens``, its
    ``first`` line that is not blank, ``first_opens`` and ``head_block``."""
    has_line = F.when(F.col("first").isNotNull(), F.col("block"))
    return facts.groupBy("path").agg(
        F.bool_and("utf8").alias("utf8"), F.bool_or("opens").alias("opens"),
        F.min_by("first", has_line).alias("first"),
        F.min_by("first_opens", has_line).alias("first_opens"),
        F.min(has_line).alias("head_block")).select(
        F.xxhash64("path").alias("file"), "utf8", "opens", "first", "head_block",
        F.coalesce("first_opens", F.lit(False)).alias("first_opens"))


def _decoded(raw: bytes | None, utf8: bool) -> str:
    return bytes(raw or b"").decode("utf-8" if utf8 else "latin-1", "replace")


def _columns(headers: list[list[str]]) -> list[str]:
    """The names of all headers, each once, in the order met; names that
    differ in case only are told apart as a table needs them."""
    return list(dict.fromkeys(name for names in headers for name in names))


_PARSE = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE",
          "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _from_records(spark: SparkSession, lines: DataFrame, facts: DataFrame, latin1: bool,
                  schema: T.StructType | None) -> DataFrame:
    """Columns of records cut from the lines, whatever headers and encodings
    the files have: one scan, one projection."""
    kinds = _file_kinds(facts)
    long_headers = kinds.where("first_opens").limit(1).count() > 0
    found = records(lines, facts, long_headers)
    heads = kinds
    if long_headers:
        # A header of several lines: take it from the records.
        first = found.where("header").select("file", F.col("record").alias("whole"))
        heads = kinds.join(first, "file", "left").withColumn(
            "first", F.coalesce("whole", "first"))
    if schema is not None:
        heads = heads.withColumn("first", F.lit(None).cast("binary"))
    groups = heads.groupBy("first", "utf8").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "first", "utf8").collect()
    if not groups:
        return spark.createDataFrame([], schema or T.StructType([]))
    # 12 bytes for every file that is not of the commonest kind.
    number = {(r.first if r.first is None else bytes(r.first), r.utf8): i
              for i, r in enumerate(groups)}
    others = {} if len(groups) == 1 else {
        r.file: number[r.first if r.first is None else bytes(r.first), r.utf8]
        for r in heads.select("file", "first", "utf8").collect()}
    kind = F.lit(0)
    if others:
        table = spark.createDataFrame([(f, k) for f, k in others.items() if k],
                                      "file long, kind int")
        found = found.join(F.broadcast(table), "file", "left")
        kind = F.coalesce(F.col("kind"), F.lit(0))
    odd = [i for i, r in enumerate(groups) if not r.utf8 and latin1]
    text = F.when(kind.isin(odd), F.decode("record", "ISO-8859-1")).otherwise(
        F.col("record").cast("string")) if odd else F.col("record").cast("string")
    text = F.regexp_replace(text, "\r$", "")
    rows = found.where(~F.col("header")).select("file", "block", "row", kind.alias("kind"),
                                                text.alias("record"))
    if schema is not None:
        return rows.select(F.from_csv("record", F.lit(_ddl(schema)), _PARSE).alias("x")).select("x.*")
    names = [header_names(_decoded(r.first, r.utf8 or not latin1)) for r in groups]
    width = max(1, max(map(len, names)))
    parsed = rows.select("kind", F.from_csv(
        "record", F.lit(", ".join(f"c{i} string" for i in range(width))), _PARSE).alias("x"))
    if len(groups) == 1:
        out = parsed.select(*[F.col(f"x.c{i}") for i in range(len(names[0]))])
        return disambiguate(out.toDF(*names[0]))
    fields = F.array(*[F.col(f"x.c{i}") for i in range(width)])
    parsed = parsed.select("kind", fields.alias("f"))
    columns = _columns(names)
    out = []
    for name in columns:
        # The field's place in each kind of file, null where it has none.
        places = F.array(*[F.lit(own.index(name) if name in own else None).cast("int")
                           for own in names])
        out.append(F.get("f", F.get(places, F.col("kind"))))
    return disambiguate(parsed.select(*[c.alias(f"c{i}") for i, c in enumerate(out)]).toDF(*columns))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(
        f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None,
             multi_line: bool = True, na_tokens: Sequence[str] | None = PANDAS_NA_TOKENS,
             infer: bool = True, latin1_fallback: bool = True,
             with_row_id: bool = False, recursive: bool = False,
             pattern: str | None = None) -> DataFrame:
    """S1 (+S2, S5): header record, UTF-8, files that are not valid UTF-8
    decoded as Latin-1.  Without a schema, columns go by the names in each
    file's own header (a column that a file lacks is NULL there), and text is
    read first so NA tokens are nulled before types are inferred.

    One aggregate over the raw lines tells each file's encoding and header and
    whether a quoted field holds a newline.  Where none does and all files are
    of one kind, Spark's own splittable reader takes them; otherwise records
    are cut in parallel (``csv_records``).  Both split files at any size.

    With ``infer`` the parsed text is written once under the shared scratch
    folder while the same job counts what fits which type; the result reads
    that table.  ``multi_line=False`` states that no field holds a newline;
    ``pattern`` is a glob on file names.
    """
    if schema is not None and not isinstance(schema, T.StructType):
        schema = spark.createDataFrame([], schema).schema
    if schema is not None and not latin1_fallback and not multi_line:
        df = _spark_csv(spark, paths, recursive, pattern, "UTF-8", schema)
    else:
        lines = raw_lines(spark, paths, recursive, pattern)
        facts = materialize(block_facts(lines), "csv-facts")
        kinds = _file_kinds(facts).agg(
            F.count("*").alias("n"), F.bool_or("opens").alias("opens"),
            F.count_distinct("utf8").alias("encodings"), F.bool_and("utf8").alias("utf8"),
            F.count_distinct("first").alias("headers"), F.min("first").alias("first"),
            F.max("head_block").alias("head_block")).first()
        # Spark's reader looks for the header in a file's first block.
        one_kind = (kinds.encodings <= 1 and not kinds.head_block
                    and (schema is not None or kinds.headers <= 1))
        if kinds.n and one_kind and not (kinds.opens and multi_line):
            latin = latin1_fallback and not kinds.utf8
            use = schema
            if schema is None:
                names = header_names(_decoded(kinds.first, not latin))
                use = T.StructType([T.StructField(f"c{i}", T.StringType())
                                    for i in range(len(names))])
            df = _spark_csv(spark, paths, recursive, pattern,
                            "ISO-8859-1" if latin else "UTF-8", use)
            if schema is None:
                # By place, so names that differ only in case do not meet.
                df = disambiguate(df.toDF(*names))
        else:
            df = _from_records(spark, lines, facts, latin1_fallback, schema)
    if na_tokens is not None and df.columns:
        df = null_tokens(df, na_tokens)
    if schema is None and infer:
        df = infer_types(df, staged=True)
    return df.withColumn(ROW_ID, F.monotonically_increasing_id()) if with_row_id else df


def _spark_csv(spark: SparkSession, paths, recursive: bool, pattern: str | None, encoding: str,
               schema: T.StructType) -> DataFrame:
    reader = (spark.read.options(**(_PARSE | {"multiLine": "false"})).option("header", True)
              .option("encoding", encoding).option("recursiveFileLookup", recursive)
              .option("enforceSchema", True).schema(schema))
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.csv(paths)


_SUFFIXES = (".csv", ".xlsx", ".xls", ".parquet", ".orc", ".json")


def _suffix(spark: SparkSession, path: str) -> str:
    p = path.rstrip("/").lower()
    for s in _SUFFIXES:
        if p.endswith(s):
            return s
    # A folder: the suffix all its data files share, from their paths alone.
    try:
        paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
            path).select("path")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if "." in p.rsplit("/", 1)[-1]:
            return ""  # named like a file of another kind
        raise FileNotFoundError(path) from e
    name = F.element_at(F.split("path", "/"), -1)
    kinds = {r.kind for r in paths.select(
        name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[A-Za-z]+)$", 1)).alias("kind"))
        .where(~F.col("name").rlike(r"^[._]") & F.col("kind").isin(*_SUFFIXES))
        .select("kind").distinct().collect()}  # at most len(_SUFFIXES) rows
    return kinds.pop() if len(kinds) == 1 else ""


def load_dataset(spark: SparkSession, path: str, fmt: str | None = None, **kw) -> DataFrame:
    """Dispatch on the lower-cased suffix (or ``fmt``); a folder takes the
    suffix its files share.  ``.xls`` is refused (binary legacy format)."""
    kind = ("." + fmt.lower().lstrip(".")) if fmt else _suffix(spark, path)
    if kind == ".csv":
        if path.lower().rstrip("/").endswith(".csv"):
            return read_csv(spark, path, **kw)
        # Files of other kinds beside them are no data.
        return read_csv(spark, path, **({"recursive": True, "pattern": "*.[cC][sS][vV]"} | kw))
    if kind == ".xlsx":
        from .workbooks import read_workbooks
        return read_workbooks(spark, path, **kw)
    if kind == ".xls":
        raise UnsupportedFormat("legacy .xls workbooks are not supported; save as .xlsx or .csv")
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".orc":
        return spark.read.orc(path)
    if kind == ".json":
        return spark.read.json(path)
    raise UnsupportedFormat("Unsupported file type")
