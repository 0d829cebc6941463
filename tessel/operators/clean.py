"""Projections and filters (PRJ1-PRJ11, FLT1-FLT8, SC18, SC20).

Written as plain projections and conjunctions so Catalyst can prune columns
and push predicates into the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.columns import col_of


def select_columns(df: DataFrame, cols) -> DataFrame:
    """PRJ1 / PRJ7: keep the named columns, in the given order."""
    return df.select(*cols)


def select_cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """PRJ2 / SC18: keep and leniently cast columns; a value that does not cast becomes NULL."""
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """PRJ3: rename by map; names not present are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def rename_positional(df: DataFrame, names) -> DataFrame:
    """PRJ4: rename the first ``len(names)`` columns by position."""
    names = list(names)
    return df.toDF(*(names + df.columns[len(names):]))


def with_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """PRJ5: add or replace columns in one projection."""
    return df.withColumns(exprs)


def drop_columns(df: DataFrame, *cols) -> DataFrame:
    """PRJ6."""
    return df.drop(*cols)


def not_null(df: DataFrame, *cols) -> DataFrame:
    """FLT1 / FLT6: drop rows with NULL in any of ``cols``.

    Written as a conjunction of ``isNotNull`` so that, after left joins, the
    optimizer turns the outer joins into inner ones (``na.drop`` would not,
    and would also drop NaN, which is not missing).
    """
    if not cols:
        return df
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def not_sentinel(df: DataFrame, col: str, sentinel: str = "\\N") -> DataFrame:
    """FLT1 + FLT2: keep rows whose value is present and differs from a text sentinel."""
    c = F.col(col)
    return df.where(c.isNotNull() & (c != F.lit(sentinel)))


def where_all(df: DataFrame, **equalities) -> DataFrame:
    """FLT3 / FLT4: conjunction of equalities; a parameter given as ``None`` means "all".

    A number compared with a text column is compared as text (S11): a postal
    code is a code, and casting the column to a number would fail on codes
    that are not numeric.
    """
    types = dict(df.dtypes)

    def lit_for(k, v):
        if types.get(k) == "string" and not isinstance(v, str):
            return F.lit(str(v))
        return F.lit(v)

    preds = [F.col(k) == lit_for(k, v) for k, v in equalities.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def where_text(df: DataFrame, predicate: str) -> DataFrame:
    """FLT5: predicate given as SQL text, e.g. ``"Country = 'United States'"``."""
    return df.where(predicate)


def mask_by(df: DataFrame, col, value) -> DataFrame:
    """FLT7: rows where another column has a value."""
    return df.where(col_of(col) == F.lit(value))


def is_empty(df: DataFrame) -> bool:
    """FLT8: emptiness test; runs a limit-1 job at the edge of a pipeline."""
    return df.isEmpty()


def pivot_wide(df: DataFrame, index, column: str, value: str, values=None) -> DataFrame:
    """PRJ9: long ``(index..., column, value)`` rows to one row per index with one column
    per ``column`` value - the transposed display form of a summary (correlation
    matrix, confusion matrix, statistics per column).

    Give ``values`` (the pivot values, e.g. the schema's column names) to skip the
    extra job that finds them.
    """
    index = [index] if isinstance(index, str) else list(index)
    grouped = df.groupBy(*index)
    pivoted = grouped.pivot(column, list(values)) if values is not None else grouped.pivot(column)
    return pivoted.agg(F.first(value))
