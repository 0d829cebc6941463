"""CSV members of zip archives (SRC10) - the monthly download format of the flight data.

``binaryFile`` reads each archive (any Hadoop file system); a ``mapInPandas`` task opens it
with the standard library and parses the records of every member matching ``member_glob``
(directories inside the archive are ignored, like ``unzip -j``), quoted newlines included.
Fields come by header name as text; Spark casts them leniently.  One task per archive,
parallel across archives; a task holds its archive (compressed) in memory.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import os
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.sources.files import _missing_values

RECORDS_PER_BATCH = 20_000


def _members(data: bytes, member_glob: str, encoding: str):
    """Text streams of the matching members, by name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            base = os.path.basename(info.filename)
            if not info.is_dir() and fnmatch.fnmatch(base, member_glob):
                with z.open(info) as fh:
                    yield base, io.TextIOWrapper(fh, encoding=encoding, newline="")


def read_zipped_csv(spark: SparkSession, path: str, schema, header: bool = True,
                    member_glob: str = "*.csv", sep: str = ",", null_value: str | None = None,
                    nan_as_null: bool = True, glob: str = "*.zip", encoding: str = "utf-8") -> DataFrame:
    """SRC10: every CSV member of every archive under ``path`` as one typed table.

    With ``header`` the schema names any of the members' columns, in any order (each member's
    own header counts; a member without one of them raises); otherwise it lists all columns by
    position.  Short records are padded with NULL; bad cells become NULL; ``NaN`` is missing
    (``nan_as_null``), as in :func:`tessel.sources.files.read_csv`.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = [f.name for f in schema.fields]

    def records(batches):
        for pdf in batches:
            for data in pdf["content"]:
                for base, text in _members(bytes(data), member_glob, encoding):
                    rows = csv.reader(text, delimiter=sep)
                    at = list(range(len(names)))
                    if header:
                        head = next(rows, None)
                        if head is None:
                            continue
                        lost = [n for n in names if n not in head]
                        if lost:
                            raise ValueError(f"columns not in the header of {base}: {lost}")
                        at = [head.index(n) for n in names]
                    out = []
                    for r in rows:
                        if not r:
                            continue  # an empty line
                        out.append([r[i] if i < len(r) and r[i] not in ("", null_value) else None for i in at])
                        if len(out) >= RECORDS_PER_BATCH:
                            yield pd.DataFrame(out, columns=names, dtype=object)
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=names, dtype=object)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(path).select("content"))
    text = files.mapInPandas(records, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    typed = text.select(*[F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType)
                          else F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return _missing_values(typed, schema, nan_as_null, ())
