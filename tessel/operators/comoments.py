"""Co-moments of many columns in one pass: masked Gram blocks and a stable pairwise merge (AGG18).

A task turns its Arrow batches into matrices and multiplies them.  For every pair of columns (i, j),
over the rows that hold both, a state has the count, both means, both sums of squared deviations
and the sum of products of deviations.  Values are centred on their block's means first, and two
states are merged by the difference of their means, never by subtracting large sums, so columns far
from zero keep their digits.  A task's state is 48 d^2 bytes; it travels in strips of rows of the
pair matrix, which are merged as they stream past, in two levels, so no task holds more than one
state and no strip is merged by all rows at once.  Neither the plan nor the work has d^2
expressions: a pair is a cell of a matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a block (rows x columns), bytes of a strip, first-level merges of a strip.
BLOCK_CELLS, STRIP_BYTES, SALTS = 1 << 21, 1 << 20, 16
#: States of up to so many bytes (16 columns) are merged in one level: a task's state is then so
#: small that one stream takes those of a hundred thousand tasks.
SMALL_STATE = 48 * 16 * 16
_TINY = 8 * np.finfo(np.float64).eps
STATE = "strip int, salt int, state binary"


def block_state(x: np.ndarray) -> np.ndarray:
    """The state of a block of rows (NaN: missing): ``n, mean_i, mean_j, m2_i, m2_j, c``, each d x d."""
    here = ~np.isnan(x)
    count = here.sum(axis=0)
    with np.errstate(invalid="ignore", over="ignore"):
        low, high = np.where(here, x, np.inf).min(axis=0), np.where(here, x, -np.inf).max(axis=0)
        centre = np.where(here, x, 0.0).sum(axis=0) / np.maximum(count, 1)
        centre = np.where(count == 0, 0.0, np.where(low == high, low, centre))  # a constant stays exact
        y = np.where(here, x - centre, 0.0)
        if here.all():
            one = np.ones((1, x.shape[1]))
            n, s, q = len(x) * (one.T @ one), y.sum(axis=0)[:, None] * one, (y * y).sum(axis=0)[:, None] * one
        else:
            m = here.astype(np.float64)
            n, s, q = m.T @ m, y.T @ m, (y * y).T @ m
        off = s / np.maximum(n, 1)
        m2 = q - s * off
        m2 = np.where(m2 <= 1e-12 * q, 0.0, m2)  # below the rounding of this difference
        c = y.T @ y - s * off.T
    mean = np.where(n > 0, centre[:, None] + off, 0.0)
    return np.stack([n, mean, mean.T, m2, m2.T, c])


def merged(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Two states (or the same strip of two) as one."""
    if a is None:
        return b
    (na, ia, ja, pa_, qa, ca), (nb, ib, jb, pb, qb, cb) = a, b
    n = na + nb
    with np.errstate(invalid="ignore", over="ignore"):
        share = nb / np.maximum(n, 1)
        both = na * share  # 0 where one side has no rows; that side's means do not count
        di, dj = np.where(both > 0, ib - ia, 0.0), np.where(both > 0, jb - ja, 0.0)
        mean_i = np.where(na > 0, ia + di * share, ib)
        mean_j = np.where(na > 0, ja + dj * share, jb)
        return np.stack([n, mean_i, mean_j, pa_ + pb + di * di * both, qa + qb + dj * dj * both, ca + cb + di * dj * both])


def correlation(state: np.ndarray) -> np.ndarray:
    """Pearson correlation of each cell; NaN where a side is constant over the pair's rows."""
    n, mean_i, mean_j, m2_i, m2_j, c = state
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        flat = (m2_i <= n * (_TINY * mean_i) ** 2) | (m2_j <= n * (_TINY * mean_j) ** 2)
        return np.where(flat | (n < 2), np.nan, np.clip(c / (np.sqrt(m2_i) * np.sqrt(m2_j)), -1.0, 1.0))


def _strip_rows(d: int) -> int:
    return max(1, STRIP_BYTES // (48 * d))


def _merge_stream(d: int, finish=None):
    """Merge rows sorted by (strip, salt); a row, or what ``finish`` makes of it, for each key."""
    def run(batches):
        key, state = None, None
        for batch in batches:
            for strip, salt, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (strip, salt) != key:
                    if key is not None:
                        yield out(key, state)
                    key, state = (strip, salt), None
                state = merged(state, np.frombuffer(raw.as_py(), np.float64).reshape(6, -1, d))
        if key is not None:
            yield out(key, state)

    def out(key, state):
        if finish:
            return finish(key[0], state)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([state.tobytes()])], ["strip", "salt", "state"])

    return run


def strips(df: DataFrame, cols: list[str]) -> DataFrame:
    """``strip, salt, state``: each task's state in strips.  ``cols`` are doubles; NULL and NaN are
    missing."""
    d = len(cols)
    rows, most = _strip_rows(d), max(1, BLOCK_CELLS // d)

    def run(batches):
        state = np.zeros((6, d, d))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            for a in range(0, len(x), most):
                state = merged(state, block_state(x[a:a + most]))
        salt = TaskContext.get().partitionId() % SALTS
        for k, a in enumerate(range(0, d, rows)):
            raw = np.ascontiguousarray(state[:, a:a + rows]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([raw])], ["strip", "salt", "state"])

    return df.select(*cols).mapInArrow(run, STATE)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """``i, j, corr`` for every cell of the matrix of ``cols`` (doubles), by position; NULL where a
    side is constant.  One pass over ``df``."""
    d = len(cols)
    rows = _strip_rows(d)

    def finish(strip, state):
        cells = correlation(state)
        i = np.repeat(np.arange(strip * rows, strip * rows + len(cells)), d)
        j = np.tile(np.arange(d), len(cells))
        value = cells.ravel()
        value[(i == j) & ~np.isnan(value)] = 1.0
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value, mask=np.isnan(value))], ["i", "j", "corr"])

    first = strips(df, cols)
    if 48 * d * d > SMALL_STATE:
        first = first.repartition("strip", "salt").sortWithinPartitions("strip", "salt").mapInArrow(_merge_stream(d), STATE)
    last = first.select("strip", F.lit(0).alias("salt"), "state").repartition("strip").sortWithinPartitions("strip")
    return last.mapInArrow(_merge_stream(d, finish), "i int, j int, corr double")
