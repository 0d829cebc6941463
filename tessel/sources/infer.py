"""Schemas from a bounded prefix of delimited files (SRC1, SRC2).

The first rows of the files, in order of their paths, are read as text and every column gets the
narrowest type of a lattice that all its values have::

    empty < integer < decimal number < text,  empty < boolean < text

Types of prefixes merge by their join in the lattice, so the result does not depend on how the
prefix is cut.  A number written with a leading zero is text: it is a code (a postal code, say),
not a quantity.  Dates stay text, as the original readers leave them.

The prefix decides the type only.  Later values that do not fit become NULL with the row kept
(``strict=False``, like ``ignore_errors``), or the read fails (``strict=True``).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessel.sources.files import read_csv

#: Rows of the prefix: a bound on what reaches the driver.
PREFIX_ROWS = 50_000

EMPTY, BOOLEAN, INTEGER, DECIMAL, TEXT = range(5)
SPARK_TYPES = {EMPTY: T.StringType(), BOOLEAN: T.BooleanType(), INTEGER: T.LongType(), DECIMAL: T.DoubleType(), TEXT: T.StringType()}
_INTEGER = re.compile(r"[+-]?(0|[1-9]\d{0,17})")
_DECIMAL = re.compile(r"[+-]?((0|[1-9]\d*)(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|Infinity)|NaN")
_BOOLEAN = re.compile(r"true|false", re.IGNORECASE)


def type_of(value: str | None) -> int:
    """The narrowest type of one cell."""
    if value is None:
        return EMPTY
    if _INTEGER.fullmatch(value):
        return INTEGER
    if _DECIMAL.fullmatch(value):
        return DECIMAL
    return BOOLEAN if _BOOLEAN.fullmatch(value) else TEXT


def join(a: int, b: int) -> int:
    """The least type that holds both."""
    if a == b or EMPTY in (a, b):
        return max(a, b)
    return DECIMAL if {a, b} == {INTEGER, DECIMAL} else TEXT


def infer_schema(spark: SparkSession, path, header: bool = True, sep: str = ",", null_value: str | None = None, extra_null_tokens=(),
                 text_columns=(), prefix_rows: int = PREFIX_ROWS) -> T.StructType:
    """The schema of the first ``prefix_rows`` rows under ``path``; ``text_columns`` stay text
    whatever they hold.  Without a header columns are named ``_c0``, ``_c1``, ..."""
    reader = (spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').option("inferSchema", False))
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    raw = reader.csv(path)
    rows = raw.limit(prefix_rows).collect()  # takes the first partitions, as many as needed
    missing = set(extra_null_tokens)
    fields = []
    for i, name in enumerate(raw.columns):
        kinds = {type_of(None if r[i] in missing else r[i]) for r in rows}
        kind = TEXT if name in text_columns else reduce(join, kinds, EMPTY)
        fields.append(T.StructField(name, SPARK_TYPES[kind]))
    return T.StructType(fields)


def read_csv_inferred(spark: SparkSession, path, header: bool = True, sep: str = ",", null_value: str | None = None, extra_null_tokens=(),
                      text_columns=(), prefix_rows: int = PREFIX_ROWS, strict: bool = False, nan_as_null: bool = True) -> DataFrame:
    """SRC1 / SRC2: delimited files with the schema of their prefix, every column in file order."""
    schema = infer_schema(spark, path, header, sep, null_value, extra_null_tokens, text_columns, prefix_rows)
    if not strict:
        return read_csv(spark, path, schema, header, sep, null_value, extra_null_tokens, nan_as_null=nan_as_null)
    reader = (spark.read.schema(schema).option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').option("mode", "FAILFAST"))
    return (reader.option("nullValue", null_value) if null_value is not None else reader).csv(path)
