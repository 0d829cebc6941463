"""Exact quantiles with linear interpolation, computed without a single-task bottleneck.

``percentile`` in Spark is exact but merges the whole value->count map of a
column in one task.  Here the work is spread out:

1. distinct values per column with their multiplicities (a partial + final
   hash aggregate; a value repeated a billion times is one row);
2. bucket bounds from a mergeable sketch (``percentile_approx``) over the
   distinct values, so every bucket holds about the same number of them;
3. counts per (column, bucket) and their running sums - a table of
   ``columns x buckets`` rows;
4. the buckets holding the wanted ranks are found in that small table, and
   only their rows are ranked (a window per target bucket).

Steps 2-4 are used only when some column has more distinct values than a
bound; below it, ``percentile`` over the value counts (a bounded map per
column) is cheaper.

Interpolation is the "linear" rule of pandas / NumPy / SQL
``quantile_cont``: position ``h = (n - 1) p``, value
``v[floor h] + (h - floor h) (v[floor h + 1] - v[floor h])``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.session import materialize

DEFAULT_BUCKETS = 256
MAX_BUCKETS = 16_384
TARGET_PER_BUCKET = 250_000
# Distinct values per column up to which one sorted window partition per column is used.
DIRECT_MAX_DISTINCT = 1_000_000


def count_below(df: DataFrame, value_col: str, bounds_col: str, n_bounds: int,
                out: str, strict: bool = True) -> DataFrame:
    """Add ``out`` = how many elements of the ascending array ``bounds_col`` are below
    ``value_col`` (``<`` when ``strict``, else ``<=``).

    A binary search of fixed depth ``ceil(log2(n_bounds + 1))``, written as one
    fold over the step sizes: a few comparisons per row instead of a scan of the
    whole array.  NULL bounds (a group with fewer values than buckets) never count.
    """
    steps = []
    step = 1
    while step <= n_bounds:
        steps.append(step)
        step *= 2
    steps.reverse()
    bounds, v = F.col(bounds_col), F.col(value_col)

    def probe(acc, st):
        cand = acc + st
        at = F.element_at(bounds, cand)
        below = (at < v) if strict else (at <= v)
        return F.when((cand <= F.size(bounds)) & F.coalesce(below, F.lit(False)), cand) \
            .otherwise(acc)

    return df.withColumn(out, F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), probe))


def long_values(df: DataFrame, cols, name_col: str = "column", value_col: str = "value"
                ) -> DataFrame:
    """Unpivot numeric columns into ``(column, value double)`` rows, NULLs dropped."""
    cast = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    out = cast.unpivot([], list(cols), name_col, value_col)
    return out.where(F.col(value_col).isNotNull())


def value_counts(long_df: DataFrame, name_col: str = "column", value_col: str = "value"
                 ) -> DataFrame:
    """Distinct values per column with their multiplicity ``cnt``."""
    return long_df.groupBy(name_col, value_col).agg(F.count(F.lit(1)).alias("cnt"))


def _ranks(n_by_column: DataFrame, probs) -> DataFrame:
    """Per column and probability: the two 0-based ranks to read and the interpolation weight."""
    pr = F.explode(F.array(*[F.lit(p) for p in probs])).alias("p")
    return (n_by_column.select("column", "n", pr)
            .withColumn("h", (F.col("n") - 1) * F.col("p"))
            .withColumn("lo", F.floor("h"))
            .withColumn("frac", F.col("h") - F.col("lo"))
            .withColumn("hi", F.least(F.col("lo") + 1, F.col("n") - 1)))


def _interpolate(ranks: DataFrame, picked: DataFrame) -> DataFrame:
    """Combine the values found at the wanted ranks into the interpolated quantiles."""
    # at most 2 x len(probs) picked values per column: gather them in a map rank -> value
    found = picked.groupBy("column").agg(
        F.map_from_entries(F.collect_list(F.struct("r", "value"))).alias("at"))
    out = ranks.join(F.broadcast(found), "column")  # one row per column
    v_lo, v_hi = F.element_at("at", F.col("lo")), F.element_at("at", F.col("hi"))
    return out.select("column", "p", (v_lo + (v_hi - v_lo) * F.col("frac")).alias("quantile"))


def _wanted(ranks: DataFrame) -> DataFrame:
    return ranks.select("column", F.explode(F.array("lo", "hi")).alias("r")).distinct()


def exact_quantiles(df: DataFrame, cols, probs, buckets: int | None = None,
                    max_direct: int = DIRECT_MAX_DISTINCT,
                    estimated_distinct: int | None = None) -> DataFrame:
    """Rows ``(column, p, quantile)`` for every column and probability.

    Columns without values give no rows.  A HyperLogLog pass estimates each
    column's distinct count: when none exceeds ``max_direct``, Spark's exact
    ``percentile`` with the value counts as frequencies runs in the same job as
    the counting (its per-column map is bounded by that check); beyond the
    bound the counts are written once and the bucketed selection keeps every
    task small; ``buckets=None`` sizes the buckets from the largest distinct
    count.  ``estimated_distinct``: that estimate, when the caller already has it.
    """
    cols = list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, p double, quantile double")
    if estimated_distinct is None:
        # a sketch pass (HyperLogLog, one code-generated aggregate) picks the path
        estimated_distinct = max(df.agg(*[F.approx_count_distinct(F.col(c).cast("double")).alias(f"_{i}")
                                          for i, c in enumerate(cols)]).first())
    if estimated_distinct <= max_direct:
        return _percentile_of_counts(value_counts(long_values(df, cols)), probs)
    # distinct values with multiplicities: read by several steps below, so written once
    vc = materialize(value_counts(long_values(df, cols)))
    return quantiles_from_counts(vc, probs, buckets, max_direct)


def _percentile_of_counts(vc: DataFrame, probs) -> DataFrame:
    """Spark's exact ``percentile`` over value counts: for columns whose number of distinct
    values is known to be bounded (the per-column value map holds them all)."""
    qs = vc.groupBy("column").agg(
        F.percentile("value", [float(p) for p in probs], F.col("cnt")).alias("qs"))
    ps = F.array(*[F.lit(float(p)) for p in probs])
    return qs.select("column", F.posexplode("qs").alias("i", "quantile")).select(
        "column", F.element_at(ps, F.col("i") + 1).alias("p"), "quantile")


def quantiles_from_counts(vc: DataFrame, probs, buckets: int | None = None,
                          max_direct: int = DIRECT_MAX_DISTINCT) -> DataFrame:
    """:func:`exact_quantiles` from a table of ``(column, value, cnt)`` distinct values
    (as :func:`value_counts` gives, ideally materialized)."""
    probs = [float(p) for p in probs]
    sizes = vc.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"),
                                     F.sum("cnt").alias("n"))
    largest = sizes.agg(F.max("distinct")).first()[0] or 0
    if largest <= max_direct:
        # bounded per column: exact percentile over the counts (at most max_direct entries)
        return _percentile_of_counts(vc, probs)

    if buckets is None:
        # about TARGET_PER_BUCKET distinct values per bucket, within [DEFAULT, MAX] buckets
        buckets = min(MAX_BUCKETS, max(DEFAULT_BUCKETS, -(-largest // TARGET_PER_BUCKET)))
    fractions = [i / buckets for i in range(1, buckets)]
    bounds = materialize(vc.groupBy("column").agg(
        F.percentile_approx("value", fractions, 10 * buckets).alias("bounds")))
    # bucket = number of bounds strictly below the value (0 .. buckets-1)
    vb = count_below(vc.join(F.broadcast(bounds), "column"), "value", "bounds", buckets - 1,
                     "b").drop("bounds")
    per_bucket = vb.groupBy("column", "b").agg(F.sum("cnt").alias("bcnt"))
    w = Window.partitionBy("column").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = materialize(  # columns x buckets rows
        per_bucket.withColumn("before", F.coalesce(F.sum("bcnt").over(w), F.lit(0)))
        .withColumn("n", F.sum("bcnt").over(Window.partitionBy("column"))))
    # wanted 0-based ranks: floor(h) and floor(h) + 1 (capped at n - 1)
    ranks = _ranks(per_bucket.select("column", "n").distinct(), probs)
    targets = (_wanted(ranks).join(per_bucket, "column")
               .where((F.col("r") >= F.col("before"))
                      & (F.col("r") < F.col("before") + F.col("bcnt")))
               .select("column", "b", "r", (F.col("r") - F.col("before")).alias("r_in")))
    # rows of the target buckets only, ranked inside their bucket by value
    tb = targets.select("column", "b").distinct()
    wv = Window.partitionBy("column", "b").orderBy("value")
    inside = (vb.join(F.broadcast(tb), ["column", "b"], "left_semi")
              .withColumn("upto", F.sum("cnt").over(wv.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("from", F.col("upto") - F.col("cnt")))
    picked = (targets.join(inside, ["column", "b"])
              .where((F.col("r_in") >= F.col("from")) & (F.col("r_in") < F.col("upto")))
              .select("column", "r", "value"))
    return _interpolate(ranks, picked)


def approx_quantiles(df: DataFrame, cols, probs, accuracy: int = 10_000) -> DataFrame:
    """Rows ``(column, p, quantile)`` from a mergeable sketch (no interpolation)."""
    probs = [float(p) for p in probs]
    q = long_values(df, cols).groupBy("column").agg(
        F.percentile_approx("value", probs, accuracy).alias("qs"))
    return q.select("column", F.posexplode("qs").alias("i", "quantile")).select(
        "column", F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("i") + 1).alias("p"),
        "quantile")
