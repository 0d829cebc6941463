"""Equi left joins (JN1-JN6) with a size-checked broadcast.

Only left outer equi-joins occur in the workloads.  A dimension side is
broadcast only after its rows and their bytes are measured against bounds (one
aggregate over at most ``max_rows + 1`` rows; long text counts its real length).
Beyond them the join is left to the planner (sort-merge, or a runtime switch
by adaptive execution), so nothing unbounded is ever shipped to every task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows and measured bytes a broadcast side may have at most.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024
_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
          "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def measured(df: DataFrame, max_rows: int) -> tuple[int, int]:
    """Rows and bytes of ``df``, from its values; reads at most ``max_rows + 1`` rows.

    Text and binary values count their own bytes, nested values those of their JSON
    text, other types their width; 16 bytes are added per row.
    """
    size = F.lit(16)
    for name, t in df.dtypes:
        c = F.col(f"`{name}`")
        if t in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif t in _WIDTH or t.startswith("decimal"):
            size = size + F.lit(_WIDTH.get(t, 16))
        else:
            size = size + F.octet_length(F.to_json(F.struct(c)))
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"),
                                     F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only when the rows and their measured bytes are within the bounds."""
    if not max_rows:
        return df
    n, size = measured(df, max_rows)
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def left_join(left: DataFrame, right: DataFrame, on=None, left_on=None, right_on=None,
              null_safe: bool = False, broadcast_max_rows: int | None = BROADCAST_MAX_ROWS
              ) -> DataFrame:
    """JN1-JN6: left outer equi-join.

    ``on``: shared key name(s); the key appears once in the output (JN1, JN2,
    JN5, JN6).  ``left_on`` / ``right_on``: different names, both kept (JN3,
    JN4).  ``null_safe=True`` lets a NULL key match a NULL key, as pandas
    ``merge`` does (S4); by default NULL matches nothing.
    ``broadcast_max_rows``: broadcast the right side if it is proven that small;
    ``None`` leaves the choice to the planner.
    """
    if broadcast_max_rows:
        right = checked_broadcast(right, broadcast_max_rows)
    if on is not None:
        keys = [on] if isinstance(on, str) else list(on)
        if not null_safe:
            return left.join(right, keys, "left")
        l, r = left.alias("_l"), right.alias("_r")
        cond = reduce(lambda a, b: a & b,
                      [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])
        rest = [F.col(f"_r.{c}") for c in right.columns if c not in keys]
        return l.join(r, cond, "left").select("_l.*", *rest)
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = [right_on] if isinstance(right_on, str) else list(right_on)
    clash = sorted(set(left.columns) & set(right.columns))
    if clash:
        # both keys are kept, so every other name must be unique across the two sides
        raise ValueError(f"columns on both sides of the join: {clash}; rename them first")
    l, r = left.alias("_l"), right.alias("_r")
    pairs = zip(lk, rk)
    cond = reduce(lambda a, b: a & b, [
        F.col(f"_l.{a}").eqNullSafe(F.col(f"_r.{b}")) if null_safe
        else F.col(f"_l.{a}") == F.col(f"_r.{b}") for a, b in pairs])
    return l.join(r, cond, "left").select("_l.*", "_r.*")


def assert_unique(df: DataFrame, keys) -> DataFrame:
    """S12 guard: the rows of ``df`` whose key occurs more than once (empty when unique).

    A dimension with duplicate keys multiplies fact rows in a join; callers
    check ``assert_unique(dim, k).isEmpty()`` before trusting the join.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).count().where(F.col("count") > 1)
