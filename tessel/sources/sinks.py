"""Sinks and result hand-off (SNK1-SNK6).

Writes are distributed (a folder of part files); only small, already
reduced results are brought to the driver, and those hand-offs check a row
bound first instead of trusting the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite",
              null_value: str | None = None, single_file: bool = False) -> None:
    """SNK1 / SNK2: CSV with a header and no index column.

    ``single_file`` funnels the data through one task (``coalesce(1)``); use it
    only for small results.
    """
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode).option("header", header).option("quote", '"').option("escape", '"')
    if null_value is not None:
        w = w.option("nullValue", null_value)
    w.csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=()) -> None:
    """Columnar output (the format later reads should use)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def to_pandas_small(df: DataFrame, max_rows: int):
    """SNK3: a reduced result as pandas; raises if it has more rows than the caller's bound.
    The whole result is ``df`` itself."""
    head = df.limit(max_rows + 1).toPandas()
    if len(head) > max_rows:
        raise ValueError(f"result has more than {max_rows} rows; aggregate or limit it first")
    return head


def scalar(df: DataFrame):
    """SNK4: the single value of a one-row, one-column result."""
    rows = df.limit(2).collect()
    if len(rows) != 1 or len(rows[0]) != 1:
        raise ValueError("expected exactly one row with one column")
    return rows[0][0]


def distinct_list(df: DataFrame, col: str, max_values: int) -> list:
    """SNK5: sorted distinct values of a column as a Python list; raises above the caller's
    bound.  The whole result is ``df.select(col).distinct()``."""
    pdf = to_pandas_small(df.select(col).distinct().orderBy(col), max_values)
    return pdf[col].tolist()


def keep(df: DataFrame, path: str | None = None) -> DataFrame:
    """SNK6: keep a computed table for reuse: written to ``path`` as parquet and read back,
    or, without a path, a reliable checkpoint in the shared checkpoint folder."""
    if path is None:
        from tessel.session import materialize

        return materialize(df)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
