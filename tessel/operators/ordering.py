"""Sorts, limits, top-k and sampling (ORD1-ORD7).

Top-k is ``orderBy(...).limit(k)``, which the planner runs as a per-task heap
(``TakeOrderedAndProject``): no global sort.  Ties are always broken by the
key columns so results are repeatable (S8).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def _order(cols) -> list[Column]:
    out = []
    for c in cols:
        if isinstance(c, Column):
            out.append(c)
        elif c.startswith("-"):
            out.append(F.col(c[1:]).desc())
        else:
            out.append(F.col(c).asc())
    return out


def sort(df: DataFrame, *cols) -> DataFrame:
    """ORD1: ``"c"`` ascending, ``"-c"`` descending."""
    return df.orderBy(*_order(cols))


def head(df: DataFrame, n: int = 5, order=None) -> DataFrame:
    """ORD2: first n rows (by ``order`` when repeatability matters)."""
    return (df.orderBy(*_order(order)) if order else df).limit(n)


def top_k(df: DataFrame, by: str, k: int, tie_keys=()) -> DataFrame:
    """ORD4 / ORD5 / ORD6: the k rows with the largest ``by``; ties by ``tie_keys`` ascending."""
    return df.orderBy(F.col(by).desc(), *[F.col(c).asc() for c in tie_keys]).limit(k)


def argmax_by_group(df: DataFrame, group, key: str, value: str, name: str | None = None
                    ) -> DataFrame:
    """ORD3 per group: the ``key`` with the largest ``value``; ties go to the smallest key.

    One aggregate of ``min(struct(-value, key))``: a partial aggregate per task
    then a final one, so a hot group cannot pile up on one task.
    """
    group = [group] if isinstance(group, str) else list(group)
    best = F.min(F.struct((-F.col(value)).alias("neg"), F.col(key).alias("k")))
    out = df.groupBy(*group).agg(best.alias("_best"))
    return out.select(*group, F.col("_best.k").alias(name or key),
                      (-F.col("_best.neg")).alias(value))


def top_k_per_group(df: DataFrame, group, order, k: int, salt_buckets: int = 16,
                    rank_name: str = "rank") -> DataFrame:
    """Exact top-k rows per group, safe when one group holds most of the rows.

    Stage 1 ranks inside (group, salt) sub-groups, where the salt is a hash of
    the whole row, and keeps k rows of each; stage 2 ranks the at most
    ``k * salt_buckets`` survivors per group.  ``order`` as in :func:`sort`;
    it must end with enough keys to make the order total.
    """
    group = [group] if isinstance(group, str) else list(group)
    ordering = _order(order)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*ordering)
    stage1 = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    w2 = Window.partitionBy(*group).orderBy(*ordering)
    return (stage1.drop("_salt", "_r")
            .withColumn(rank_name, F.row_number().over(w2))
            .where(F.col(rank_name) <= k))


def sample_n(df: DataFrame, n: int, seed: int = 42, key_cols=None, hash: str = "xxhash64",
             bits: int = 16) -> DataFrame:
    """ORD7: exactly n rows chosen uniformly at random (all rows if fewer).

    Rows are ranked by a seeded hash of ``key_cols`` (all columns by default) and
    the n smallest are kept: repeatable for a given seed whatever the
    partitioning.  One path for every n: counts per bucket of the hash's top
    ``bits`` bits, a running sum over that small table (at most ``2**bits`` rows),
    and a ranking of the rows of the one bucket that holds the cut-off.
    ``hash="md5"`` ranks by the MD5 of ``"seed|key|..."`` text, which any SQL
    engine can reproduce.
    """
    cols = list(key_cols) if key_cols else df.columns
    if hash == "md5":
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
        bucket = F.shiftright(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint"), 32 - bits)
    else:
        h = F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])
        bucket = F.shiftright("_h", 64 - bits)
    data = df.withColumn("_h", h).withColumn("_b", bucket)
    per = data.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**bits rows
    per = per.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    cut = per.where((F.col("_before") < n) & (F.col("_before") + F.col("_c") >= n)).select(
        F.struct(F.max("_b").alias("b"), F.max(F.lit(n) - F.col("_before")).alias("need")))
    # the cut-off bucket and how many of its rows to keep; NULL when there are <= n rows
    data = data.withColumn("_cut", cut.scalar())
    below = data.where(F.col("_cut.b").isNull() | (F.col("_b") < F.col("_cut.b")))
    ranked = Window.partitionBy("_b").orderBy("_h", *cols)
    edge = (data.where(F.col("_b") == F.col("_cut.b"))
            .withColumn("_r", F.row_number().over(ranked))
            .where(F.col("_r") <= F.col("_cut.need")))
    return below.select(*df.columns).unionByName(edge.select(*df.columns))
