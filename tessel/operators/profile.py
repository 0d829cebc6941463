"""Table profiling (AGG14-AGG22, AGG24): statistics, info, size, correlation,
histograms, kernel density, 2-D bins and column profiles.

Results are long tables (one row per column, bin or grid point), the
transposed form the original code displays; ``groupBy().pivot()`` gives a
wide one.  Every statistic is an algebraic aggregate or a composition of
them: partial aggregation per task, nothing unbounded in one task, and
ranges that other rows need travel as scalar subqueries or small grouped
tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.columns import numeric_columns
from tessel.functions.scalars import nan_to_null
from tessel.operators import comoments
from tessel.operators import quantiles as qt
from tessel.operators.joins import checked_broadcast
from tessel.operators.sketches import heavy_hitters
from tessel.operators.ordering import top_k_per_group
from tessel.session import materialize, ship_package

DTYPE_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
               "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def _number(c):
    """A column as double with NaN as missing, as the dataframe code skips it."""
    return nan_to_null(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"))


def describe(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """AGG14: per numeric column ``count, mean, std, min, p25, p50, p75, max``.

    ``std`` is the sample standard deviation; quartiles interpolate linearly.
    Two passes: count, mean, std, min, max and the distinct-count estimate come from
    one code-generated aggregation over the table (no shuffle); exact quartiles come from the distributed exact
    selection over the columns' distinct values; ``exact=False`` adds sketch
    quartiles to that same single aggregation instead.
    """
    cols = list(cols) if cols else numeric_columns(df)
    order = ["column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    df = df.select(*[_number(c).alias(c) for c in cols])
    kinds = ("count", "mean", "std", "min", "max")
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [f(x).alias(f"{k}{i}") for k, f in zip(kinds, (F.count, F.avg, F.stddev_samp, F.min, F.max))]
        aggs.append(F.approx_count_distinct(x).alias(f"distinct{i}") if exact
                    else F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}"))
    row = df.agg(*aggs).first() if cols else None  # one row, a few numbers per column
    quart = ("p25", "p50", "p75")
    rows = [(c, *[row[f"{k}{i}"] for k in kinds], *((row[f"q{i}"] or [None] * 3) if not exact else []))
            for i, c in enumerate(cols)]
    schema = "column string, count bigint, mean double, std double, min double, max double"
    stats = df.sparkSession.createDataFrame(rows, schema + ("" if exact else ", p25 double, p50 double, p75 double"))
    if not exact:
        return stats.select(*order)
    largest = max((row[f"distinct{i}"] for i in range(len(cols))), default=0)
    q = qt.exact_quantiles(df, cols, [0.25, 0.5, 0.75], estimated_distinct=largest)
    qw = q.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n)
                                   for p, n in zip((0.25, 0.5, 0.75), quart)])
    # one row per column of the schema on both sides: broadcast
    return stats.join(F.broadcast(qw), "column", "left").select(*order)


def table_info(df: DataFrame) -> DataFrame:
    """AGG15: ``(position, column, dtype, non_null, rows)`` for every column, one pass."""
    aggs = [F.count(F.lit(1)).alias("\0rows")] + [
        F.count(F.col(f"`{c}`")).alias(f"\0{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                     F.lit(t).alias("dtype"), F.col(f"`\0{i}`").alias("non_null"))
            for i, (c, t) in enumerate(df.dtypes)]
    return wide.select(F.explode(F.array(*rows)).alias("s"), F.col("`\0rows`").alias("rows")) \
        .select("s.*", "rows")


def table_shape(df: DataFrame) -> DataFrame:
    """AGG16: ``(rows, columns)``."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def size_profile(df: DataFrame) -> DataFrame:
    """AGG17: bytes of data per column: UTF-8 bytes of text, type width x non-null values.

    A data aggregate, so it is the same on any layout; rows ``(column, dtype, bytes)``.
    Types without a fixed width (arrays, maps, structs) count the bytes of their JSON text.
    """
    aggs = []
    for i, (c, t) in enumerate(df.dtypes):
        col = F.col(f"`{c}`")
        if t == "string":
            e = F.sum(F.octet_length(col))
        elif t in DTYPE_WIDTH:
            e = F.count(col) * F.lit(DTYPE_WIDTH[t])
        elif t.startswith("decimal"):
            e = F.count(col) * F.lit(16)
        elif t == "binary":
            e = F.sum(F.octet_length(col))
        else:
            e = F.sum(F.octet_length(F.to_json(F.struct(col))))
        aggs.append(F.coalesce(e, F.lit(0)).cast("bigint").alias(f"\0{i}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"),
                     F.col(f"`\0{i}`").alias("bytes")) for i, (c, t) in enumerate(df.dtypes)]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def corr_matrix(df: DataFrame, cols=None) -> DataFrame:
    """AGG18: Pearson correlation of every pair of numeric columns, ``(col_a, col_b, corr)``.

    Pairwise-complete (a row counts for a pair when both values are present).
    One pass: blocks of rows become matrices of co-moments that are merged pairwise
    (:mod:`tessel.operators.comoments`), so hundreds of columns cost matrix products, not
    expressions.  A constant column yields NULL (NaN in pandas), and so do infinite values.
    The matrix has both triangles and a diagonal of 1 (NULL for a constant column).
    """
    cols = list(cols) if cols else numeric_columns(df)
    schema = "col_a string, col_b string, corr double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    ship_package(df.sparkSession)
    at = [f"x{i}" for i in range(len(cols))]
    found = comoments.correlations(df.select(*[_number(F.col(f"`{c}`")).alias(x) for c, x in zip(cols, at)]), at)
    names = F.array(*[F.lit(c) for c in cols])
    return found.select(F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"), "corr")


def _bin_index(value, lo, hi, bins: int):
    """0-based equal-width bin of ``value`` over ``[lo, hi]``; the top edge joins the last bin."""
    idx = F.floor((value - lo) / (hi - lo) * F.lit(bins))
    # not least(): it skips NULLs and would put a missing value in the last bin
    return F.when(idx > F.lit(bins - 1), F.lit(bins - 1)).otherwise(idx).cast("int")


def _widen(lo, hi):
    """A degenerate range ``lo == hi`` becomes ``[lo - 0.5, hi + 0.5]`` (NumPy's rule)."""
    same = lo == hi
    return (F.when(same, lo - 0.5).otherwise(lo), F.when(same, hi + 0.5).otherwise(hi))


def histogram(df: DataFrame, col: str, bins: int = 25, by=None, common_range: bool = True
              ) -> DataFrame:
    """AGG19 / AGG20: equal-width histogram of ``col``, per ``by`` group if given.

    ``common_range``: one range over all rows (the hue histogram); otherwise
    each group gets its own range (the per-class probability histograms).
    Rows ``(by..., bin, bin_lo, bin_hi, count)`` for every bin, empty bins
    included; missing values (NULL, NaN) and rows of a NULL group are left out,
    as the plotting call does.  Two passes over the rows.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    data = df.select(*by, _number(col).alias("_v")).where(F.col("_v").isNotNull())
    for c in by:
        data = data.where(F.col(c).isNotNull())
    # ranges: one aggregate, written (a row per group), measured and broadcast, so the
    # rows themselves are never shuffled by a class that may hold most of them
    rng = materialize(data.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "ranges")
    if common_range or not by:
        both = rng.agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))
        lo, hi = both.select("lo").scalar(), both.select("hi").scalar()
        data, groups = data.withColumns({"_lo": lo, "_hi": hi}), rng.where(F.col("_lo").isNotNull()).withColumns({"_lo": lo, "_hi": hi})
    else:
        data, groups = data.join(checked_broadcast(rng), by), rng
    lo_c, hi_c = _widen(F.col("_lo"), F.col("_hi"))
    counts = (data.withColumn("bin", _bin_index(F.col("_v"), lo_c, hi_c, bins))
              .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = (groups.select(*by, lo_c.alias("_a"), hi_c.alias("_b"))
            .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))))
    width = (F.col("_b") - F.col("_a")) / F.lit(bins)
    return (grid.join(counts, by + ["bin"], "left")
            .select(*by, "bin",
                    (F.col("_a") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("_a") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def kde(df: DataFrame, col: str, by=None, gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """AGG21: Gaussian kernel density of ``col`` on an even grid, per ``by`` group.

    Bandwidth by Scott's rule, ``h = s n^(-1/5)`` with ``s`` the sample
    standard deviation; the grid spans ``[min - cut h, max + cut h]``.
    Rows ``(by..., i, x, density, n)``; ``density * n * bin_width`` gives the
    curve on a count histogram.  Work: the group parameters are one aggregate
    (written once, a row per group); the distinct values with weights are
    expanded to the grid points and summed with a partial aggregate, so a task
    emits at most groups x gridsize rows and no cross join is formed.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    data = df.select(*by, _number(col).alias("_v")).where(F.col("_v").isNotNull())
    # group parameters: one code-generated aggregate, written once (one row per group)
    # because both the expansion and the normalisation read it
    params = materialize(
        data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("_v").alias("s"),
                              F.min("_v").alias("mn"), F.max("_v").alias("mx"))
        .withColumn("h", F.col("s") * F.pow(F.col("n"), F.lit(-0.2)))
        .where(F.col("h") > 0)
        .withColumn("lo", F.col("mn") - F.lit(cut) * F.col("h"))
        .withColumn("step", (F.col("mx") - F.col("mn") + F.lit(2 * cut) * F.col("h"))
                    / F.lit(gridsize - 1)), "kde-params")
    weights = data.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("w"))
    if by:
        expanded = weights.join(params.select(*by, "h", "lo", "step"), by)
    else:
        # one group: its parameters are scalar subqueries (no join at all)
        expanded = weights.withColumns({c: params.select(c).scalar() for c in ("h", "lo", "step")})
    expanded = expanded.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))))
    gx = F.col("lo") + F.col("i") * F.col("step")
    z = (gx - F.col("_v")) / F.col("h")
    sums = expanded.groupBy(*by, "i").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("k"))
    if by:
        sums = sums.join(params, by)
    else:
        sums = sums.withColumns({c: params.select(c).scalar() for c in ("n", "h", "lo", "step")})
    norm = F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))
    return sums.select(*by, "i", (F.col("lo") + F.col("i") * F.col("step")).alias("x"),
                       (F.col("k") / norm).alias("density"), "n")


def pair_bins(df: DataFrame, cols, bins: int = 10) -> DataFrame:
    """AGG22: joint distribution of every ordered pair of columns as 2-D bin counts.

    Each column is binned over its own range (ranges as scalar subqueries);
    one pass explodes the d(d-1)/2 unordered pairs of a row, a partial aggregate counts
    them, and the small result is mirrored into ``(x_col, y_col, bx, by)``.  Rows where either value is NULL are
    left out of that pair.
    """
    cols = list(cols)
    binned = df.select(*[_number(c).alias(c) for c in cols])
    # all ranges in one aggregate, attached once as a struct column (one scalar subquery)
    rng = binned.select(F.struct(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                                 *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)])).scalar()
    binned = binned.withColumn("_rng", rng)
    idx = {}
    for i, c in enumerate(cols):
        a, b = _widen(F.col(f"_rng.lo{i}"), F.col(f"_rng.hi{i}"))
        idx[c] = _bin_index(F.col(c), a, b, bins)
    binned = binned.select(*[idx[c].alias(f"_b{i}") for i, c in enumerate(cols)])
    idx = {c: F.col(f"_b{i}") for i, c in enumerate(cols)}
    pairs = [F.struct(F.lit(a).alias("x_col"), F.lit(b).alias("y_col"),
                      idx[a].alias("bx"), idx[b].alias("by"))
             for i, a in enumerate(cols) for b in cols[i + 1:]]
    exploded = binned.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    counts = (exploded.where(F.col("bx").isNotNull() & F.col("by").isNotNull())
              .groupBy("x_col", "y_col", "bx", "by").agg(F.count(F.lit(1)).alias("count")))
    # each unordered pair is counted once; its transpose has the same counts
    both = F.explode(F.array(
        F.struct("x_col", "y_col", "bx", "by", "count"),
        F.struct(F.col("y_col").alias("x_col"), F.col("x_col").alias("y_col"), F.col("by").alias("bx"), F.col("bx").alias("by"), "count")))
    return counts.select(both.alias("p")).select("p.*")


def _approximate_profile(df: DataFrame, num: set, top: int) -> DataFrame:
    """No shuffle of all values: one code-generated aggregate (sketched distinct counts, exact missing
    counts, minima and maxima), and the exact most frequent texts by heavy-hitter candidates."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (c, t) in enumerate(df.dtypes):
        x = nan_to_null(F.col(f"`{c}`")) if t in ("float", "double") else F.col(f"`{c}`")
        key = x if c in num else x.cast("string")
        aggs += [F.approx_count_distinct(key).alias(f"u{i}"), F.count(x).alias(f"n{i}")]
        if c in num:
            aggs += [F.min(_number(x)).alias(f"lo{i}"), F.max(_number(x)).alias(f"hi{i}")]
    none = lambda kind: F.lit(None).cast(kind)
    cells = []
    for i, (c, t) in enumerate(df.dtypes):
        lo, hi = (F.col(f"lo{i}"), F.col(f"hi{i}")) if c in num else (none("double"), none("double"))
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"u{i}").alias("n_unique"),
                              (F.col("rows") - F.col(f"n{i}")).alias("n_missing"), lo.alias("min"), hi.alias("max"),
                              F.lit(c not in num).alias("_text"), F.col(f"n{i}").alias("_n")))
    base = df.agg(*aggs).select(F.explode(F.array(*cells)).alias("s")).select("s.*")
    best = heavy_hitters(df, [c for c in df.columns if c not in num], top)  # `top` rows a column
    pick = lambda k, of: F.max(F.when(F.col("rank") == k, F.col(of)))
    tops = best.groupBy("column").agg(*[e for k in range(1, top + 1) for e in (pick(k, "value").alias(f"top{k}"), pick(k, "count").alias(f"top{k}_count"))])
    names = [e for k in range(1, top + 1) for e in (f"top{k}", f"top{k}_count")]
    taken = sum((F.coalesce(f"top{k}_count", F.lit(0)) for k in range(1, top + 1)), F.lit(0))
    return (base.join(tops, "column", "left")
            .select("column", "dtype", "n_unique", "n_missing", "min", "max", *names, F.when(F.col("_text"), F.col("_n") - taken).alias("others_count")))


def column_profile(df: DataFrame, top: int = 2, exact: bool = True) -> DataFrame:
    """AGG24: per column: unique and missing counts; min / max of numbers; for other
    columns the ``top`` most frequent values (as text) with counts and the count of
    all others.

    Rows ``(column, dtype, n_unique, n_missing, min, max, top1, top1_count, ...,
    others_count)``.  One scan of the table: every column is packed as a
    (text, number) pair, unpivoted, and its values counted once (partial
    aggregation, written once); all figures come from that table, and the top
    values per column from a salted two-stage ranking.  ``exact=False`` shuffles
    candidates only: distinct counts are sketched, the top values (still exact) come from
    :func:`tessel.operators.sketches.heavy_hitters`.
    """
    num = set(numeric_columns(df))
    if not exact:
        return _approximate_profile(df, num, top)
    packed = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        if c in num:
            # distinct values are told apart in the native type (a double merges large integers)
            exact = nan_to_null(col) + 0.0 if t in ("float", "double") else col
            pair = F.struct(exact.cast("string").alias("s"), _number(col).alias("d"))
        else:
            pair = F.struct(col.cast("string").alias("s"), F.lit(None).cast("double").alias("d"))
        packed.append(pair.alias(c))
    long = (df.select(*packed).unpivot([], df.columns, "column", "v")
            .select("column", F.col("v.s").alias("s"), F.col("v.d").alias("d")))
    vc = materialize(long.groupBy("column", "s", "d").agg(F.count(F.lit(1)).alias("cnt")))
    missing = F.col("s").isNull()
    stats = vc.groupBy("column").agg(
        F.sum("cnt").alias("rows"),
        F.coalesce(F.sum(F.when(missing, F.col("cnt"))), F.lit(0)).alias("n_missing"),
        F.count(F.when(~missing, F.lit(1))).alias("n_unique"),
        F.min("d").alias("min"), F.max("d").alias("max"))
    text_only = F.col("s").isNotNull() & ~F.col("column").isin(list(num))
    best = top_k_per_group(vc.where(text_only).select("column", "s", "cnt"),
                           "column", ["-cnt", "s"], top, rank_name="r")
    tops = best.groupBy("column").agg(
        *[F.max(F.when(F.col("r") == i, F.col("s"))).alias(f"top{i}") for i in range(1, top + 1)],
        *[F.max(F.when(F.col("r") == i, F.col("cnt"))).alias(f"top{i}_count")
          for i in range(1, top + 1)])
    types = df.sparkSession.createDataFrame(
        [(c, t) for c, t in df.dtypes], "column string, dtype string")
    out = types.join(stats, "column", "left").join(tops, "column", "left")
    taken = sum((F.coalesce(F.col(f"top{i}_count"), F.lit(0)) for i in range(1, top + 1)),
                F.lit(0))
    non_null = F.col("rows") - F.col("n_missing")
    others = F.when(~F.col("column").isin(list(num)), non_null - taken)
    topcols = [x for i in range(1, top + 1) for x in (f"top{i}", f"top{i}_count")]
    return out.select("column", "dtype", "n_unique", "n_missing", "min", "max", *topcols,
                      others.alias("others_count"))


def column_histograms(df: DataFrame, cols=None, bins: int = 10) -> DataFrame:
    """AGG24 numeric part: a ``bins``-bin histogram of each numeric column over its own range.

    Rows ``(column, bin, bin_lo, bin_hi, count)``.
    """
    cols = list(cols) if cols else numeric_columns(df)
    lv = qt.long_values(df, cols, "column", "v")
    return histogram(lv, "v", bins, by="column", common_range=False)
