"""Grouped and global aggregates (AGG1-AGG13, AGG23, AGG25).

Every grouped aggregate here is algebraic (count, sum, min, max, avg), so the
planner splits it into a map-side partial aggregate and a final one: a key
holding a third of all rows is collapsed to one row per task before the
shuffle and cannot overload a reducer.  Global scalars that scale other rows
(a maximum, a grand total) are attached as uncorrelated scalar subqueries,
which Spark evaluates once and inlines as a literal: no window without
partitioning, no cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def count_rows_by(df: DataFrame, keys, name: str = "total", drop_null_keys: bool = False
                  ) -> DataFrame:
    """AGG1-AGG3: row count per key combination.

    NULL keys form their own group (as in the Polars code); set
    ``drop_null_keys`` for the pandas-derived operators, whose ``groupby``
    drops them (S3).
    """
    keys = _keys(keys)
    if drop_null_keys:
        df = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_and_sum_by(df: DataFrame, keys, count_col: str, sum_col: str,
                     count_name: str | None = None, sum_name: str | None = None) -> DataFrame:
    """AGG4: non-null count of one column and sum of another per key (NULL keys dropped, S3).

    The sum of an all-NULL group is 0, as in pandas (S5).
    """
    keys = _keys(keys)
    df = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return df.groupBy(*keys).agg(
        F.count(count_col).alias(count_name or count_col),
        F.coalesce(F.sum(sum_col), F.lit(0.0)).alias(sum_name or sum_col))


def sum_by(df: DataFrame, keys, col: str, name: str | None = None,
           drop_null_keys: bool = True) -> DataFrame:
    """AGG5 / AGG6: sum of a column per key (pandas semantics: NULL keys dropped, empty sum 0)."""
    keys = _keys(keys)
    if drop_null_keys:
        df = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return df.groupBy(*keys).agg(F.coalesce(F.sum(col), F.lit(0)).alias(name or col))


def count_non_null_by(df: DataFrame, keys, col: str, name: str | None = None) -> DataFrame:
    """AGG7: non-null count of a column per key (NULL keys dropped)."""
    keys = _keys(keys)
    df = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return df.groupBy(*keys).agg(F.count(col).alias(name or col))


def total(df: DataFrame, col: str, name: str = "total") -> DataFrame:
    """AGG8: global sum as a one-row table (0 for no rows, S5)."""
    return df.agg(F.coalesce(F.sum(col), F.lit(0)).alias(name))


def count_days_mean(df: DataFrame, day_col: str, approx: bool = False) -> DataFrame:
    """AGG9-AGG11: rows, distinct days and rows per day (0 when there are no days), one pass.

    ``approx`` counts distinct days with a HyperLogLog++ sketch (bounded memory per
    task, about 1% error) instead of an exact distinct count.  NULL days are not
    counted (S7).
    """
    n = F.count(F.lit(1))
    d = (F.approx_count_distinct(F.col(day_col), 0.01) if approx
         else F.count_distinct(F.col(day_col)))
    return df.agg(n.alias("total_flights"), d.alias("num_days"),
                  F.when(d > 0, n / d).otherwise(F.lit(0.0)).alias("mean_per_day"))


def scale_by_max(df: DataFrame, col: str, name: str = "scaled") -> DataFrame:
    """AGG12: ``col / max(col)`` for every row; the maximum is a scalar subquery."""
    mx = df.select(F.max(col)).scalar()
    return df.withColumn(name, F.col(col) / mx)


def column_means(df: DataFrame, cols) -> dict:
    """AGG13: means of several columns in one aggregation pass, returned as a small dict.

    Only aggregated scalars reach the driver.
    """
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """AGG23 / SET4 / SNK5: distinct values of a column, sorted."""
    return df.select(col).distinct().orderBy(col)


def share_of_total(df: DataFrame, value_col: str, name: str = "share", by=None) -> DataFrame:
    """AGG25: each row's value as a fraction of the total (per ``by`` group if given).

    Per-group totals come from a grouped aggregate joined back on the group
    keys; the global total is a scalar subquery.
    """
    if not by:
        tot = df.select(F.sum(value_col)).scalar()
        return df.withColumn(name, F.col(value_col) / tot)
    by = _keys(by)
    totals = df.groupBy(*by).agg(F.sum(value_col).alias("_group_total"))
    return (df.join(totals, by, "inner")
            .withColumn(name, F.col(value_col) / F.col("_group_total"))
            .drop("_group_total"))
