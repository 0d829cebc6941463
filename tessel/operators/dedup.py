"""Set operations and de-duplication (SET1-SET4).

Keep-one-row-per-key is an aggregate of ``min`` / ``min_by`` over a struct of
the other columns, so it has a map-side partial step and needs neither a
window over a whole key nor a sort of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*dfs: DataFrame) -> DataFrame:
    """SET1: stack tables by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def one_per_key(df: DataFrame, keys) -> DataFrame:
    """SET2: one row per key.  Deterministic: the row with the smallest remaining values."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    agg = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return agg.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """SET3: the first row per key in the order given by ``order`` column(s).

    ``order`` should be a file-order column (a line number, an ingest
    sequence) or any total order; NULL keys form one group, as
    ``drop_duplicates`` keeps one NULL-key row.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return agg.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """SET4."""
    return df.select(col).distinct()
