"""Sketches stored per partition of a table and merged for any selection (AGG9-AGG11, AGG14, AGG24).

A sketch table has a row per combination of the keys (a month, say) with the row count, a HyperLogLog
sketch of each wanted column's distinct values and a KLL sketch of each wanted column's
distribution.  A later question about any selection of keys reads that table alone: sketches are
merged, the rows are not scanned again.  All of it is Spark's own aggregates, partial per task.

Bounds.  Distinct counts: a relative standard error of 1.04 / sqrt(2**lg_k), 0.4 % at the default
of 16; up to some thousands of values the sketch still lists them and the count is exact.
Quantiles: the rank of an answer is within about 1.65 / k**0.9 of the wanted one (99 %), 1.3 % at
``k`` = 200 and 0.3 % at the default of 1000, however many sketches are merged.

:func:`heavy_hitters` finds the most frequent values of columns in two passes without shuffling the
values themselves.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.scalars import nan_to_null
from tessel.session import materialize, ship_package

LG_K, KLL_K = 16, 1000


def partition_sketches(df: DataFrame, keys, distinct=(), numeric=(), lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """A row per combination of ``keys``: ``rows``, ``hll_<column>`` of each column of ``distinct``
    and ``kll_<column>`` of each of ``numeric``.  NULL (and NaN, in numbers) is not counted; keys
    may be NULL.  Write it with :func:`tessel.sources.sinks.write_parquet`, partitioned by the keys
    if their selections should prune."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    text = [F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"hll_{c}") for c in distinct]
    numbers = [F.kll_sketch_agg_double(nan_to_null(F.col(c).cast("double")), k).alias(f"kll_{c}") for c in numeric]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *text, *numbers)


def merged(sketches: DataFrame, keys=()) -> DataFrame:
    """The sketches of coarser groups (``keys`` a part of the table's keys; none: all rows)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    parts = [F.hll_union_agg(c, True).alias(c) if c.startswith("hll_") else F.kll_merge_agg_double(c).alias(c)
             for c in sketches.columns if c.startswith(("hll_", "kll_"))]
    return sketches.groupBy(*keys).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *parts)


def distinct_counts(sketches: DataFrame, column: str, keys=()) -> DataFrame:
    """AGG9-AGG11: ``keys..., rows, distinct, per_distinct`` of the selected sketches (0 when there
    are no values)."""
    m = merged(sketches.select(*([keys] if isinstance(keys, str) else keys), "rows", f"hll_{column}"), keys)
    d = F.coalesce(F.hll_sketch_estimate(f"hll_{column}"), F.lit(0))
    return m.select(*([keys] if isinstance(keys, str) else keys), "rows", d.alias("distinct"), F.when(d > 0, F.col("rows") / d).otherwise(F.lit(0.0)).alias("per_distinct"))


def quantiles(sketches: DataFrame, columns, probs, keys=()) -> DataFrame:
    """AGG14: ``keys..., column, n, p, quantile`` of the selected sketches (no row for a column
    without values)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    columns = [columns] if isinstance(columns, str) else list(columns)
    m = merged(sketches.select(*keys, "rows", *[f"kll_{c}" for c in columns]), keys)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"kll_{c}").alias("sketch")) for c in columns])
    held = m.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*").withColumn("n", F.kll_sketch_get_n_double("sketch")).where("n > 0")
    answers = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("quantile")) for p in probs])
    return held.select(*keys, "column", "n", F.explode(answers).alias("a")).select(*keys, "column", "n", "a.*")


def _misra_gries(columns: list[str], counters: int):
    """A task's candidates: at most ``counters`` values of a column; a value that lacks, or more than
    its count, occurs at most ``slack`` times more often in the task."""
    def run(batches):
        held: list[dict] = [{} for _ in columns]
        slack = [0] * len(columns)
        for batch in batches:
            for i in range(len(columns)):
                counts = batch.column(i).value_counts()
                mine = held[i]
                for value, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist()):
                    if value is not None:
                        mine[value] = mine.get(value, 0) + n
                if len(mine) > counters:  # subtract the largest count that does not fit from all
                    cut = sorted(mine.values(), reverse=True)[counters]
                    slack[i] += cut
                    held[i] = {v: n - cut for v, n in mine.items() if n > cut}
        for i, mine in enumerate(held):
            values = [None, *mine]  # the NULL row carries the slack
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(values), pa.int32()), pa.array(values, pa.string()), pa.array([slack[i], *mine.values()], pa.int64())],
                                             ["i", "value", "n"])

    return run


def heavy_hitters(df: DataFrame, columns, top: int, counters: int = 1000, candidates: int = 4000) -> DataFrame:
    """``column, value, count, rank`` (rank from 1, ties to the smaller text) of the ``top`` most
    frequent values, as text, of each column; exact.

    First pass: a Misra-Gries summary per task, summed over the tasks; second pass: the exact counts
    of the ``candidates`` values of a column with the largest sums.  Any other value occurs at most
    (its sum, or the largest sum left out) + (all tasks' slack) times; a column whose ``top``-th
    exact count does not exceed that (or that has fewer values) is counted in full instead, so the
    result never rests on the sketch."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    ship_package(df.sparkSession)
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(f"x{i}") for i, c in enumerate(columns)])
    found = materialize(text.mapInArrow(_misra_gries(columns, counters), "i int, value string, n bigint"), "summaries")
    sums = found.groupBy("i", "value").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "summary")
    slack = {r["i"]: r["n"] for r in sums.where("value IS NULL").collect()}  # a row per column
    best = [sums.where(F.col("value").isNotNull() & (F.col("i") == i)).orderBy(F.desc("n"), "value").limit(candidates + 1).collect() for i in range(len(columns))]
    rows, bound = [], {}
    for i, b in enumerate(best):
        bound[i] = slack.get(i, 0) + (b[candidates]["n"] if len(b) > candidates else 0)
        rows += [(i, r["value"]) for r in b[:candidates]]
    wanted = F.broadcast(df.sparkSession.createDataFrame(rows, "i int, value string"))  # candidates x columns at most
    long = lambda which: text.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("value")) for i in which])).alias("v")).select("v.*").where("value IS NOT NULL")
    empty = df.sparkSession.createDataFrame([], "i int, value string, n bigint")
    exact = materialize(long(range(len(columns))).join(wanted, ["i", "value"]).groupBy("i", "value").agg(F.count(F.lit(1)).alias("n")), "candidates") if columns else empty
    place = F.struct((-F.col("n")).alias("o"), "value", "n")
    lists = lambda counted: counted.groupBy("i").agg(F.slice(F.sort_array(F.collect_list(place)), 1, top).alias("l"))
    tops = {r["i"]: r["l"] for r in lists(exact).collect()}
    open_ = [i for i in range(len(columns)) if bound[i] and (len(tops.get(i, [])) < top or tops[i][top - 1]["n"] <= bound[i])]
    if open_:
        from tessel.operators.ordering import top_k_per_group

        counted = long(open_).groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
        for r in top_k_per_group(counted, "i", ["-n", "value"], top, rank_name="r").groupBy("i").agg(F.sort_array(F.collect_list(place)).alias("l")).collect():
            tops[r["i"]] = r["l"]
    out = [(columns[i], v["value"], v["n"], k) for i, l in sorted(tops.items()) for k, v in enumerate(l, 1)]
    return df.sparkSession.createDataFrame(out, "column string, value string, count bigint, rank int")
