"""Workbook scan (S3): a folder of ``.xlsx`` files, first sheet, header row.

Spark has no workbook source, so files arrive through the ``binaryFile``
source (one workbook per record, spread over tasks) and are parsed with the
standard library (``zipfile`` + ``ElementTree``) inside ``mapInPandas``.  A
first light pass reads only the header rows to fix the schema (the union of
column names, in first-seen order); the second emits the cells as text into a
parquet table under ``spark.checkpoint.dir`` (so the XML is parsed once), and
the usual one-pass inference narrows numeric columns.
"""

from __future__ import annotations

import datetime as _dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sizing import materialize
from .readers import PANDAS_NA_TOKENS, infer_types, null_tokens

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG_R = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# Built-in number formats that show dates (ECMA-376 part 1, 18.8.30).
_DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}
_EPOCH = _dt.datetime(1899, 12, 30)


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + (ord(ch.upper()) - 64)
    return n - 1


def _text_of(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{_M}t"))


class _Book:
    def __init__(self, data: bytes):
        self.z = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.z.namelist())
        self.shared = []
        if "xl/sharedStrings.xml" in names:
            root = ET.fromstring(self.z.read("xl/sharedStrings.xml"))
            self.shared = [_text_of(si) for si in root.iter(f"{_M}si")]
        self.date_styles = set()
        if "xl/styles.xml" in names:
            st = ET.fromstring(self.z.read("xl/styles.xml"))
            custom = {}
            for nf in st.iter(f"{_M}numFmt"):
                code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", nf.get("formatCode", "")).lower()
                custom[int(nf.get("numFmtId"))] = bool(re.search(r"[dy]", code))
            xfs = st.find(f"{_M}cellXfs")
            for i, xf in enumerate(xfs if xfs is not None else []):
                fid = int(xf.get("numFmtId", "0"))
                if fid in _DATE_FORMAT_IDS or custom.get(fid):
                    self.date_styles.add(i)
        wb = ET.fromstring(self.z.read("xl/workbook.xml"))
        first = wb.find(f"{_M}sheets/{_M}sheet")
        rid = first.get(f"{_R}id")
        rels = ET.fromstring(self.z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels.iter(f"{_PKG_R}Relationship")
                      if r.get("Id") == rid)
        self.sheet = target.lstrip("/") if target.startswith("/") else "xl/" + target

    def _value(self, c) -> str | None:
        t = c.get("t", "n")
        if t == "inlineStr":
            is_ = c.find(f"{_M}is")
            return None if is_ is None else _text_of(is_)
        v = c.find(f"{_M}v")
        if v is None or v.text is None:
            return None
        raw = v.text
        if t == "s":
            return self.shared[int(raw)]
        if t == "b":
            return "True" if raw == "1" else "False"
        if t in ("str", "e"):
            return raw
        if int(c.get("s", "0")) in self.date_styles:
            stamp = _EPOCH + _dt.timedelta(days=float(raw))
            return stamp.date().isoformat() if stamp.time() == _dt.time() else stamp.isoformat(" ")
        num = float(raw)
        return str(int(num)) if num.is_integer() and "e" not in raw.lower() else raw

    def rows(self) -> Iterator[list[str | None]]:
        with self.z.open(self.sheet) as fh:
            for _, el in ET.iterparse(fh, events=("end",)):
                if el.tag != f"{_M}row":
                    continue
                cells: dict[int, str | None] = {}
                for pos, c in enumerate(el.iter(f"{_M}c")):
                    ref = c.get("r")
                    cells[_col_index(ref) if ref else pos] = self._value(c)
                el.clear()
                width = max(cells) + 1 if cells else 0
                yield [cells.get(i) for i in range(width)]


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            header = next(_Book(bytes(content)).rows(), [])
            out += [(path, i, "" if h is None else str(h)) for i, h in enumerate(header)]
        yield pd.DataFrame(out, columns=["path", "idx", "name"])


def read_workbooks(spark: SparkSession, path: str, na_tokens=PANDAS_NA_TOKENS,
                   infer: bool = True, with_file: bool = False, **_) -> DataFrame:
    """S3: rows of the first sheet of every ``.xlsx`` under ``path``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
             .option("recursiveFileLookup", "true").load(path).select("path", "content"))
    heads = files.mapInPandas(_headers, "path string, idx int, name string")
    # Distinct header names only, each at its first (file, position): the
    # driver receives one row per distinct column name, not per file.
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")),
                       F.concat(F.lit("Unnamed: "), F.col("idx").cast("string")))
    firsts = (heads.select(label.alias("name"), F.struct("path", "idx").alias("at"))
                   .groupBy("name").agg(F.min("at").alias("at")))
    names = [r["name"] for r in firsts.orderBy("at").select("name").collect()]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                it = _Book(bytes(content)).rows()
                header = next(it, [])
                pos = {}
                for i, h in enumerate(header):
                    key = ("" if h is None else str(h)) or f"Unnamed: {i}"
                    pos.setdefault(key, i)
                chunk = []
                for row in it:
                    if not any(v not in (None, "") for v in row):
                        continue
                    rec = {n: (row[pos[n]] if n in pos and pos[n] < len(row) else None)
                           for n in names}
                    if with_file:
                        rec["_file"] = path
                    chunk.append(rec)
                    if len(chunk) >= 10_000:
                        yield pd.DataFrame(chunk, columns=cols)
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=cols)

    cols = names + (["_file"] if with_file else [])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in cols])
    df = files.mapInPandas(cells, schema)
    if na_tokens is not None:
        df = null_tokens(df, na_tokens)
    # Parse the workbooks once: the cells land as parquet on shared storage,
    # and type inference and every later action read that instead of
    # re-running the XML parsing.
    df = materialize(df, "xlsx-cells")
    return infer_types(df, skip=("_file",)) if infer else df
