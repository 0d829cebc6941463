"""Small helpers shared by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def numeric_columns(df, exclude=()) -> list[str]:
    """Names of the numeric (integral or fractional) columns, in schema order."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    out = []
    for name, dtype in df.dtypes:
        if name in exclude:
            continue
        if dtype in kinds or dtype.startswith("decimal"):
            out.append(name)
    return out
