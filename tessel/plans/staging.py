"""Stages a stand-in table as files of a foreign format, for the source queries and tests.

Spark has no writer for zip archives and workbooks.  A task writes one file per partition (more, if
the format's own limit of rows asks for it), named by the partition, to a temporary name first and
then renames it, so a retried or speculative task replaces its own file.  Rows are written as they
arrive: a task holds one batch of them, whatever its partition's size.  The folder must be one that every task can write (local mode or a mounted
shared folder); other file systems raise.  All values travel as Spark's own text, so integers of
any size and NULLs survive.
"""

from __future__ import annotations

import csv
import io
import itertools
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import ExitStack

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the spreadsheet namespace.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
# Fixed value: rows of a sheet, its header included.
SHEET_ROWS = 1 << 20


def _folder(path: str) -> str:
    local = path[len("file:"):] if path.startswith("file:") else path
    if "://" in local.lstrip("/"):
        raise ValueError(f"zip and workbook files can only be staged in a mounted folder, not in {path}")
    return "/" + local.lstrip("/") if path.startswith("file:") else local


def _write_files(df: DataFrame, folder: str, suffix: str, encode, most: int | None = None) -> int:
    """Files of up to ``most`` rows; ``encode(fh, columns, rows)`` writes one and returns its number of rows."""
    local, columns = _folder(folder), df.columns

    def write(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for k in itertools.count():
            part = list(itertools.islice(rows, 1))
            if not part:
                return
            os.makedirs(local, exist_ok=True)
            name = os.path.join(local, f"part-{TaskContext.get().partitionId():05d}{f'-{k:05d}' if k else ''}{suffix}")
            draft = f"{name}.{uuid.uuid4().hex}.tmp"
            with open(draft, "wb") as fh:
                n = encode(fh, columns, itertools.chain(part, itertools.islice(rows, most - 1 if most else None)))
            os.replace(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "rows"])

    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return text.mapInArrow(write, "file string, rows long").count()


def write_json_records(df: DataFrame, folder: str) -> None:
    """JSON arrays of records, one file per partition, through Spark's text sink."""
    def lines(batches):
        first = True
        for b in batches:
            rows = [("[" if first and i == 0 else ",") + r for i, r in enumerate(b.column(0).to_pylist())]
            first = first and not rows
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])

    records = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    records.mapInArrow(lines, "value string").write.text(folder)


def write_zipped_csv(df: DataFrame, folder: str, header: bool = True, members: int = 1) -> int:
    """One zip archive per partition, its rows dealt over CSV members; returns the number of archives."""
    def encode(fh, columns, rows):
        n = 0
        with zipfile.ZipFile(fh, "w", zipfile.ZIP_DEFLATED) as z, ExitStack() as stack:
            # an archive takes one member at a time: their texts wait on the task's disk
            texts = [stack.enter_context(tempfile.TemporaryFile("w+", encoding="utf-8", newline="")) for _ in range(members)]
            writers = [csv.writer(t, lineterminator="\n") for t in texts]
            if header:
                for w in writers:
                    w.writerow(columns)
            for n, r in enumerate(rows, start=1):
                writers[(n - 1) % members].writerow(["" if v is None else v for v in r])
            for k, t in enumerate(texts):
                t.seek(0)
                with z.open(f"data/part{k or ''}.csv", "w", force_zip64=True) as out:
                    shutil.copyfileobj(t.buffer, out)
        return n

    return _write_files(df, folder, ".zip", encode)


def _cell_xml(ref: str, value) -> str:
    if value is None:
        return ""
    text = (value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _col_letters(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def write_workbook(fh, columns: list[str], rows) -> int:
    """A minimal single-sheet ``.xlsx``: a header row, then rows of text cells (``None``: empty);
    returns the number of rows."""
    letters = [_col_letters(i) for i in range(len(columns))]
    parts = {
        "[Content_Types].xml":
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.'
            'relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-'
            'officedocument.spreadsheetml.sheet.main+xml"/>'
            '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.'
            'openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels":
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
            'relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml":
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/'
            'officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" '
            'r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels":
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
            'relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    ri = 0
    with zipfile.ZipFile(fh, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as raw, io.TextIOWrapper(raw, "utf-8", newline="") as sheet:
            sheet.write('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                        f'<worksheet xmlns="{MAIN}"><sheetData>')
            for ri, row in enumerate(itertools.chain([columns], rows), start=1):
                cells = "".join(_cell_xml(f"{c}{ri}", v) for c, v in zip(letters, row))
                sheet.write(f'<row r="{ri}">{cells}</row>')
            sheet.write('</sheetData></worksheet>')
    return ri - 1


def workbook_bytes(columns: list[str], rows: list[tuple]) -> bytes:
    """:func:`write_workbook` in memory, for a few rows."""
    buf = io.BytesIO()
    write_workbook(buf, columns, rows)
    return buf.getvalue()


def write_workbooks(df: DataFrame, folder: str) -> int:
    """One workbook per partition, more if its rows exceed a sheet; returns the number of workbooks."""
    return _write_files(df, folder, ".xlsx", write_workbook, SHEET_ROWS - 1)
