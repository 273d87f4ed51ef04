"""Workbook export (K2), re-aimed for a cluster: every partition writes its
own ``.xlsx`` (one sheet, at most the format's row limit) straight to the
target folder, and the job returns a small manifest of files and row counts.

Only the standard library is used to build the Office Open XML package.
File names are fixed per partition, so a retried task overwrites its own
file instead of adding one.
"""

from __future__ import annotations

import datetime as _dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

SHEET_NAME_MAX = 31          # fixed value: sheet-name length limit
SHEET_ROWS_MAX = 1_048_576   # rows per worksheet, header included
EXCEL_EPOCH = _dt.date(1899, 12, 30)
_BAD_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _col_letter(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _cell(ref: str, v) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if isinstance(v, _dt.datetime):
        serial = (v - _dt.datetime(1899, 12, 30)).total_seconds() / 86400
        return f'<c r="{ref}" s="2"><v>{serial!r}</v></c>'
    if isinstance(v, _dt.date):
        return f'<c r="{ref}" s="1"><v>{(v - EXCEL_EPOCH).days}</v></c>'
    text = str(v)
    if _BAD_XML.search(text):
        raise ValueError(f"cell {ref}: a workbook cannot hold control characters; export CSV")
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _package_parts(sheet_name: str) -> dict[str, str]:
    sheet = escape(sheet_name[:SHEET_NAME_MAX], {'"': "&quot;"})
    return {
        "[Content_Types].xml":
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
            '</Types>',
        "_rels/.rels":
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
            '</Relationships>',
        "xl/workbook.xml":
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
            'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
            f'<sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels":
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/>'
            '</Relationships>',
        "xl/styles.xml":
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
            '<numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/>'
            '<numFmt numFmtId="165" formatCode="yyyy-mm-dd hh:mm:ss"/></numFmts>'
            '<fonts count="1"><font><sz val="11"/><name val="Calibri"/></font></fonts>'
            '<fills count="1"><fill><patternFill patternType="none"/></fill></fills>'
            '<borders count="1"><border/></borders>'
            '<cellStyleXfs count="1"><xf/></cellStyleXfs>'
            '<cellXfs count="3"><xf/><xf numFmtId="164" applyNumberFormat="1"/>'
            '<xf numFmtId="165" applyNumberFormat="1"/></cellXfs>'
            '</styleSheet>',
    }


class WorkbookWriter:
    """Streams one worksheet into an ``.xlsx`` package on ``out``; rows are
    encoded as they arrive, so memory does not grow with the sheet."""

    def __init__(self, out, header: list[str], sheet_name: str):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        for name, body in _package_parts(sheet_name).items():
            self.zip.writestr(name, body)
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                         b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                         b'<sheetData>')
        self.rows = 0
        self._row(tuple(header))

    def _row(self, row: tuple) -> None:
        r = self.rows + 1
        cells = "".join(_cell(f"{_col_letter(c)}{r}", v) for c, v in enumerate(row))
        self.sheet.write(f'<row r="{r}">{cells}</row>'.encode())
        self.rows += 1

    def add(self, row: tuple) -> None:
        self._row(row)

    def close(self) -> int:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()
        return self.rows - 1


def workbook_bytes(header: list[str], rows: list[tuple], sheet_name: str) -> bytes:
    """One-sheet ``.xlsx`` in memory (small results and tests)."""
    buf = io.BytesIO()
    w = WorkbookWriter(buf, header, sheet_name)
    for row in rows:
        w.add(row)
    w.close()
    return buf.getvalue()


def _filesystem(path: str):
    from pyarrow import fs as pafs
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.replace("file:", "", 1)


class _AttemptFile:
    """Output stream that writes ``path`` under an attempt-private name and
    moves it into place on close, so a retried or speculative task never
    leaves a half-written or interleaved workbook behind."""

    def __init__(self, path: str, attempt: int):
        self.fs, self.final = _filesystem(path)
        self.fs.create_dir(self.final.rsplit("/", 1)[0], recursive=True)
        self.tmp = f"{self.final}.attempt-{attempt}.tmp"
        self.stream = self.fs.open_output_stream(self.tmp)

    def write(self, data) -> int:
        return self.stream.write(data)

    def flush(self) -> None:
        self.stream.flush()

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.tmp, self.final)


def write_workbooks(df: DataFrame, path: str, sheet_name: str = "Filtered",
                    rows_per_file: int = SHEET_ROWS_MAX - 1) -> list[tuple[str, int]]:
    """K2: one workbook per partition (split further past the row limit).

    Returns the manifest ``[(file, rows)]`` -- one small row per file.
    """
    header = list(df.columns)
    target = path.rstrip("/")

    def write_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        ctx = TaskContext.get()
        pid, attempt = ctx.partitionId(), ctx.taskAttemptId()
        written = []
        state = {"k": 0, "stream": None, "book": None, "name": None}

        def start():
            name = f"{target}/part-{pid:05d}-{state['k']:03d}.xlsx"
            state["stream"] = _AttemptFile(name, attempt)
            state["book"] = WorkbookWriter(state["stream"], header, sheet_name)
            state["name"] = name

        def finish():
            n = state["book"].close()
            state["stream"].close()
            written.append((state["name"], n))
            state["k"] += 1
            state["book"] = None

        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for row in pdf.itertuples(index=False, name=None):
                if state["book"] is None:
                    start()
                state["book"].add(row)
                if state["book"].rows - 1 >= rows_per_file:
                    finish()
        if state["book"] is not None or not written:
            if state["book"] is None:
                start()
            finish()
        yield pd.DataFrame(written, columns=["file", "rows"])

    manifest = df.mapInPandas(write_part, "file string, rows long")
    return [(r["file"], r["rows"]) for r in manifest.collect()]
