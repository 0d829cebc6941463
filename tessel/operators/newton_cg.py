"""Logistic regression on many features: trust-region Newton steps by conjugate gradients (ML3).

Minimises ``1/2 |w|^2 + C sum log(1 + exp(-y' w.x))`` with the intercept as a penalised weight on a
constant 1, like :func:`tessel.operators.ml.train_logistic_newton`.  A step solves
``H s = -g`` within a trust region by conjugate gradients (Steihaug's truncation), each of which
needs one product ``H v = v + C X' (p (1 - p) * X v)``: a pass of matrix products over blocks of
rows.  A pass shuffles d numbers per task and hands d numbers to the driver; the Hessian is not formed.

Up to NARROW weights it is: reading the rows then costs more than all d products of a step, so the pass
for the gradient multiplies with every unit vector as well (``X' (p (1 - p) * X)``, d^2 numbers per task)
and the step's products follow from these: a pass for each step instead of one for each product.

The rows are written once as blocks of doubles, compressed (LZ4, lossless) where they are made, since
moving bytes between Spark and Python is most of a pass; nothing else of the input is kept.  Spark's
readers and writers hold thousands of blocks at a time, so a stored block is small, whatever the table's
size; a pass joins neighbouring blocks for its matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import materialize, ship_package

#: Numbers of a stored block of rows (one row, if that has more), and of the blocks joined for a product.
BLOCK, JOINED = 1 << 10, 1 << 16
#: Of the features' bytes in a block; blocks of labels stay as they are.
CODEC = "lz4_raw"
#: Weights up to which the products with all unit vectors are summed along with the gradient.
NARROW = 64


def blocks(train: DataFrame, features, label: str) -> DataFrame:
    """``rows, x, y``: features and a constant 1, compressed, and labels 0 / 1, as little-endian doubles.
    Rows with a NULL feature or label raise."""
    d = len(list(features)) + 1
    most = max(1, BLOCK // d)

    def run(batches):
        codec = pa.Codec(CODEC)
        for batch in batches:
            if any(c.null_count for c in batch.columns):
                raise ValueError("a feature or label is NULL: impute first")
            x = np.stack([c.to_numpy() for c in batch.columns[:-1]] + [np.ones(batch.num_rows)], axis=1)
            y = batch.column(d - 1).to_numpy()
            parts = [slice(a, a + most) for a in range(0, len(x), most)]
            yield pa.RecordBatch.from_arrays([pa.array([len(y[p]) for p in parts], pa.int64()),
                                              pa.array([codec.compress(x[p].tobytes(), asbytes=True) for p in parts], pa.binary()),
                                              pa.array([y[p].tobytes() for p in parts], pa.binary())], ["rows", "x", "y"])

    ship_package(train.sparkSession)
    columns = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate([*features, label])]
    return materialize(train.select(*columns).mapInArrow(run, "rows bigint, x binary, y binary"), "feature-blocks")


def _joined(batch: pa.RecordBatch, d: int):
    """The rows and labels of a few neighbouring blocks ``x, y`` at a time."""
    codec, step = pa.Codec(CODEC), max(1, JOINED // max(BLOCK, d))
    for a in range(0, batch.num_rows, step):
        x, y = (c.to_pylist() for c in batch.slice(a, step).columns)
        x = [codec.decompress(b, d * len(v), asbytes=True) for b, v in zip(x, y)]
        x, y = (np.frombuffer(b"".join(c), np.float64) for c in (x, y))
        yield x.reshape(-1, d), y


def _summed(data: DataFrame, d: int, of) -> np.ndarray:
    """Sum over all blocks of the vectors ``of(x, y)``."""
    def run(batches):
        total = None
        for batch in batches:
            for x, y in _joined(batch, d):
                part = of(x, y)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["j", "v"])

    rows = data.select("x", "y").mapInArrow(run, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r["j"] for r in rows), default=-1) + 1)
    for r in rows:
        out[r["j"]] = r["v"]
    return out


def _loss_gradient(w, products: bool = False):
    """The gradient's sums and the loss; ``products``: then those of :func:`_curvature` for each unit vector."""
    def of(x, y):
        z = x @ w
        loss = np.logaddexp(0.0, z) - y * z
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        sums = np.append(x.T @ (p - y), loss.sum())
        return np.append(sums, x.T @ (x * (p * (1 - p))[:, None])) if products else sums

    return of


def _curvature(w, v):
    def of(x, y):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        return x.T @ (p * (1 - p) * (x @ v))

    return of


def _step(g: np.ndarray, radius: float, hessian, tol: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An approximate solution of ``H s = -g`` with ``|s| <= radius``, and ``H s``."""
    s, hs, r = np.zeros_like(g), np.zeros_like(g), -g
    p, rr = r.copy(), float(r @ r)
    for _ in range(most):
        if rr <= (tol * np.linalg.norm(g)) ** 2:
            break
        hp = hessian(p)
        curve = float(p @ hp)
        alpha = rr / curve if curve > 0 else np.inf
        if not np.isfinite(alpha) or np.linalg.norm(s + alpha * p) >= radius:
            a, b, c = float(p @ p), float(s @ p), float(s @ s) - radius ** 2
            alpha = (-b + np.sqrt(max(b * b - a * c, 0.0))) / a  # to the region's edge
            return s + alpha * p, hs + alpha * hp
        s, hs, r = s + alpha * p, hs + alpha * hp, r - alpha * hp
        rr, old = float(r @ r), rr
        p = r + rr / old * p
    return s, hs


def train_logistic_cg(train: DataFrame, features, label: str, C: float = 1.0, tol: float = 1e-8, max_iter: int = 100) -> np.ndarray:
    """ML3: weights ``[w_1..w_d, intercept]``; stops when the gradient's norm is ``tol`` of its first,
    raises if ``max_iter`` steps do not get there.  An empty table gives zeros."""
    features = list(features)
    d = len(features) + 1
    data = blocks(train, features, label)
    narrow = d <= NARROW

    def at(w):
        got = _summed(data, d, _loss_gradient(w, narrow))
        if not len(got):
            return None
        units = got[d + 1:].reshape(d, d) if narrow else None
        hessian = lambda v: v + C * (units @ v if narrow else _summed(data, d, _curvature(w, v)))
        return 0.5 * float(w @ w) + C * got[d], w + C * got[:d], hessian

    w = np.zeros(d)
    if not (got := at(w)):
        return w
    f, g, hessian = got
    first = radius = float(np.linalg.norm(g))
    for _ in range(max_iter):
        size = float(np.linalg.norm(g))
        if size <= tol * max(first, 1e-300):
            return w
        s, hs = _step(g, radius, hessian, min(0.1, np.sqrt(size / first)), 4 * d)
        f2, g2, hessian2 = at(w + s)
        predicted = -float(g @ s) - 0.5 * float(s @ hs)
        # near the minimum losses differ by less than their rounding: the gradient decides
        flat = abs(f - f2) <= 1e-10 * abs(f)
        ratio = (f - f2) / predicted if predicted > 0 else -1.0
        if ratio > 1e-4 or flat and np.linalg.norm(g2) < size:
            w, f, g, hessian = w + s, f2, g2, hessian2
        radius = max(radius, 2 * float(np.linalg.norm(s))) if ratio > 0.75 or flat else radius if ratio > 0.25 else 0.25 * float(np.linalg.norm(s))
    raise RuntimeError(f"not converged after {max_iter} trust-region steps")
