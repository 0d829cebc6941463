"""Archives and workbooks read member by member (SRC7, SRC10): a Spark data source in Python.

Planning lists the files and, from each file's table of contents alone, its members or sheets;
every one of them becomes a partition of its own, so one large archive is read by many tasks.  A
task seeks to its member and decompresses it as a stream, record by record: neither the archive nor
the member is ever held whole (a workbook's shared strings are, within the format's own limits).

Files are opened through Arrow's file systems (local and mounted folders, HDFS, S3, GCS), which
can seek; :func:`tessel.sources.zipped.read_zipped_csv` reads whole archives through any Hadoop file
system instead.  Values arrive as text and are cast leniently by Spark.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import os
import posixpath
import zipfile
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessel.session import ship_package
from tessel.sources.files import _missing_values
from tessel.sources.workbook import BATCH_RECORDS, NS, sheet_rows, text_batches  # noqa: F401

# Fixed value: the namespace of relationship ids inside a workbook.
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def list_files(path: str, glob: str) -> list[str]:
    """Files under ``path`` (or ``path`` itself) whose name matches, in order of their paths, as
    paths of its file system."""
    from pyarrow import fs

    system, root = _file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [root]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in posixpath.relpath(p, root).split("/"))
    return sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, glob) and not hidden(f.path))


@contextmanager
def opened(root: str, path: str):
    """A zip file by its table of contents; members are sought, not loaded."""
    system, _ = _file_system(root)
    with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
        yield z


@dataclass
class Member(InputPartition):
    """One member of one file."""

    path: str
    name: str
    label: str


def csv_members(z: zipfile.ZipFile, pattern: str) -> list[tuple[str, str]]:
    return [(i.filename, os.path.basename(i.filename)) for i in z.infolist() if not i.is_dir() and fnmatch.fnmatch(os.path.basename(i.filename), pattern)]


def sheets(z: zipfile.ZipFile, pattern: str) -> list[tuple[str, str]]:
    """Member and title of every sheet, in the workbook's order."""
    names = set(z.namelist())
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
    book = ET.fromstring(z.read("xl/workbook.xml"))
    out = [(targets.get(s.get(RELATION)), s.get("name") or "") for s in book.iter(f"{{{NS['m']}}}sheet")]
    return [(m, title) for m, title in out if m in names and fnmatch.fnmatchcase(title, pattern)]


def csv_records(z: zipfile.ZipFile, name: str, options: dict):
    """Lists of text, one per record, as the member is decompressed."""
    with z.open(name) as fh:
        for r in csv.reader(io.TextIOWrapper(fh, encoding=options["encoding"], newline=""), delimiter=options["sep"]):
            if r:
                yield r


def sheet_records(z: zipfile.ZipFile, name: str, options: dict):
    """Lists of text (``None``: empty cell), one per row, as the sheet is parsed."""
    return sheet_rows(z, name)


class MemberReader(DataSourceReader):
    def __init__(self, options: dict, listing, records):
        self.options, self.listing, self.records = options, listing, records

    def partitions(self):
        root = self.options["path"]

        def members(path):
            with opened(root, path) as z:
                return [Member(path, name, label) for name, label in self.listing(z, self.options["members"])]

        paths = list_files(root, self.options["glob"])
        with ThreadPoolExecutor(16) as pool:  # tables of contents only
            return [m for found in pool.map(members, paths) for m in found]

    def read(self, partition: Member | None):
        if partition is None:  # nothing was listed
            return
        names, header = self.options["columns"], self.options["header"]
        null = self.options["null_value"]

        with opened(self.options["path"], partition.path) as z:
            records = self.records(z, partition.name, self.options)
            at = list(range(len(names)))
            if header:
                head = next(records, None)
                if head is None:
                    return
                lost = [n for n in names if n not in head]
                if lost and self.options["strict"]:
                    raise ValueError(f"columns not in the header of {partition.label}: {lost}")
                at = [head.index(n) if n in head else len(head) for n in names]
            yield from text_batches(([r[i] if i < len(r) and r[i] not in ("", null) else None for i in at] for r in records), names)


class _Members(DataSource):
    listing = records = None

    def _options(self) -> dict:
        return json.loads(self.options["members"])

    def schema(self):
        return T.StructType([T.StructField(n, T.StringType()) for n in self._options()["columns"]])

    def reader(self, schema):
        return MemberReader(self._options(), type(self).listing, type(self).records)


class ZipMembers(_Members):
    listing, records = staticmethod(csv_members), staticmethod(csv_records)

    @classmethod
    def name(cls):
        return "tessel_zip_members"


class WorkbookSheets(_Members):
    listing, records = staticmethod(sheets), staticmethod(sheet_records)

    @classmethod
    def name(cls):
        return "tessel_workbook_sheets"


def _read(spark: SparkSession, source: type[DataSource], schema, options: dict, nan_as_null: bool) -> DataFrame:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    ship_package(spark)
    spark.dataSource.register(source)
    options = options | {"columns": [f.name for f in schema.fields]}
    text = spark.read.format(source.name()).option("members", json.dumps(options)).load()
    typed = text.select(*[F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType)
                          else F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return _missing_values(typed, schema, nan_as_null, ())


def read_zip_members(spark: SparkSession, path: str, schema, header: bool = True, members: str = "*.csv", sep: str = ",",
                     null_value: str | None = None, nan_as_null: bool = True, glob: str = "*.zip", encoding: str = "utf-8") -> DataFrame:
    """SRC10: every CSV member of every archive under ``path``, a partition each.

    With ``header`` the schema names any of the members' columns, in any order (a member without one
    of them raises); otherwise it lists all columns by position.  Short records are padded with
    NULL, bad cells become NULL, ``NaN`` is missing.
    """
    options = dict(path=path, glob=glob, members=members, header=header, sep=sep, null_value=null_value, encoding=encoding, strict=True)
    return _read(spark, ZipMembers, schema, options, nan_as_null)


def read_workbook_sheets(spark: SparkSession, path: str, schema, header: bool = True, sheet: str = "*", glob: str = "*.xlsx") -> DataFrame:
    """SRC7: every sheet whose title matches, of every workbook under ``path``, a partition each.

    With ``header`` a sheet's first row names its columns and a column it lacks is NULL; otherwise
    the schema lists all columns by position.  Text columns keep exactly what the cell stores.
    """
    options = dict(path=path, glob=glob, members=sheet, header=header, null_value=None, strict=False)
    return _read(spark, WorkbookSheets, schema, options, False)
