"""Excel workbooks (SRC7): a folder of ``.xlsx`` files read as one table.

``binaryFile`` lists and reads the files (any Hadoop file system); a
``mapInArrow`` task parses each workbook with the standard library (an
``.xlsx`` file is a zip of XML parts) and emits the cells of the first sheet
as text; Spark then casts the text to the requested schema, leniently.  A
column declared as text keeps exactly what the cell stores (postal codes
keep their digits), as a ``dtype=str`` override does.  One task per
workbook: parallel across files.  A task holds the compressed file, its shared
strings and one batch of rows; the sheet is decompressed and parsed as a stream.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_CELL_REF = re.compile(r"([A-Z]+)(\d+)")
#: Records, and characters, of one batch handed to Spark.
BATCH_RECORDS, BATCH_CHARS = 10_000, 4_000_000


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" not in z.namelist():
        return out
    m = f"{{{NS['m']}}}"
    with z.open("xl/sharedStrings.xml") as fh:
        table = None
        for event, si in ET.iterparse(fh, events=("start", "end")):
            if table is None:
                table = si
            if event == "end" and si.tag == m + "si":
                out.append("".join(t.text or "" for t in si.iter(m + "t")))
                table.clear()  # strings that were read
    return out


def _first_sheet(z: zipfile.ZipFile) -> str:
    names = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
    return "xl/worksheets/sheet1.xml" if "xl/worksheets/sheet1.xml" in names else names[0]


def sheet_rows(z: zipfile.ZipFile, name: str):
    """Lists of cell text (``None``: empty cell), one per row, as the sheet is parsed."""
    m = f"{{{NS['m']}}}"
    strings = _shared_strings(z)
    with z.open(name) as fh:
        data = None
        for event, row in ET.iterparse(fh, events=("start", "end")):
            if event == "start" and row.tag == m + "sheetData":
                data = row
            if event == "start" or row.tag != m + "row":
                continue
            cells: dict[int, str | None] = {}
            for c in row.findall(m + "c"):
                at = _CELL_REF.match(c.get("r", ""))
                kind, v = c.get("t"), c.find(m + "v")
                value = v.text if v is not None else None
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(m + "t"))
                elif kind == "s" and value is not None:
                    value = strings[int(value)]
                elif kind == "b" and value is not None:
                    value = "True" if value == "1" else "False"
                cells[_col_index(at.group(1)) if at else len(cells)] = value
            if data is not None:
                data.clear()  # rows that were read
            yield [cells.get(i) for i in range(max(cells) + 1 if cells else 0)]


def parse_workbook(data: bytes) -> list[list[str | None]]:
    """Rows of the first sheet as lists of cell text (``None`` for empty cells)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return list(sheet_rows(z, _first_sheet(z)))


def text_batches(rows, names: list[str]):
    """Arrow batches of bounded size from an iterator of lists of text."""
    schema = pa.schema([(n, pa.string()) for n in names])
    held, chars = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*held)], schema=schema)

    for row in rows:
        held.append(row)
        chars += sum(map(len, filter(None, row)))
        if len(held) >= BATCH_RECORDS or chars >= BATCH_CHARS:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def read_workbooks(spark: SparkSession, path: str, schema, header: bool = True,
                   glob: str = "*.xlsx") -> DataFrame:
    """SRC7: the first sheet of every workbook under ``path`` as one table.

    With ``header`` the first row names the columns and cells are matched to
    the schema by name; otherwise by position.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = [f.name for f in schema.fields]
    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def records(z):
        rows = sheet_rows(z, _first_sheet(z))
        at = list(range(len(names)))
        if header:
            head = next(rows, None)
            if head is None:
                return
            head = [h if h is not None else "" for h in head]
            at = [head.index(n) if n in head else None for n in names]
        for r in rows:
            yield [r[i] if i is not None and i < len(r) else None for i in at]

    def parse(batches):
        for batch in batches:
            for data in batch.column(0):
                with zipfile.ZipFile(pa.BufferReader(data.as_buffer())) as z:
                    yield from text_batches(records(z), names)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(path).select("content"))
    text = files.mapInArrow(parse, text_schema)
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name)
                         if not isinstance(f.dataType, T.StringType) else F.col(f.name)
                         for f in schema.fields])
