"""Imputation, stratified split, logistic regression and the prediction table
(ML1-ML5, ML10).

* Imputation: sentinel 0 -> missing -> column mean, the means as scalar
  subqueries (one aggregation job for all columns).
* Split: exact per-class test sizes without ranking a whole class in one
  task.  Rows are ordered by a seeded 64-bit hash; the hash's top bits cut
  each class into up to ``2**bits`` buckets whose counts and running sums
  form a small table; only the bucket holding each class's cut-off is ranked.
* Model: Spark ML's distributed logistic regression with the L2 penalty of
  the original solver (``C = 1``), or an exact Newton solve of the same
  objective with a penalised intercept (liblinear's objective), where each
  iteration is one Spark aggregation of gradient and Hessian sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import scalars
from tessel.operators.joins import checked_broadcast
from tessel.session import materialize

DEFAULT_SPLIT_BITS = 16


def impute_mean(df: DataFrame, cols, zero_is_missing: bool = True,
                fit_on: DataFrame | None = None) -> DataFrame:
    """ML1 (SC9 + AGG13 + SC10): replace missing values (and zeros) by the column mean.

    By default the mean is taken over the non-missing values of all rows of
    ``df`` (as the original does, before any split, S13); pass ``fit_on`` (e.g.
    the training part) to take the means from those rows only.
    """
    def clean(d):
        return d.withColumns({c: scalars.zero_to_null(c) if zero_is_missing else F.col(c)
                              for c in cols})

    cleaned = clean(df)
    source = cleaned if fit_on is None else clean(fit_on)
    means = {c: source.select(F.avg(c)).scalar() for c in cols}
    return cleaned.withColumns({c: F.coalesce(F.col(c), means[c]) for c in cols})


def stratified_split(df: DataFrame, label: str, test_size: float = 0.3, seed: int = 42,
                     key_cols=None, bits: int = DEFAULT_SPLIT_BITS,
                     split_col: str = "split") -> DataFrame:
    """ML2: add ``split`` = ``test`` / ``train`` with exactly ``round(test_size * n_c)``
    test rows in every class ``c`` (NULL labels form a class of their own).

    Rows are taken in order of ``xxhash64(seed, key_cols)`` (then the key
    columns), so the split is repeatable and independent of partitioning;
    ``key_cols`` (all columns by default) must identify a row: rows with equal
    keys fall on the same side.  The class cut-off bucket is found in a
    ``classes x 2**bits`` table of bucket counts, its last test row by ranking
    that bucket's rows alone (about ``n_c / 2**bits``); every row is then
    labelled by one comparison with its class's cut-off.
    """
    keys = list(key_cols) if key_cols else [c for c in df.columns]
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in keys])
    data = df.withColumns({"_h": h, "_cls": F.col(label)}) \
        .withColumn("_bkt", F.shiftright(F.col("_h"), 64 - bits))
    per_bucket = data.groupBy("_cls", "_bkt").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_cls").orderBy("_bkt")
    per_bucket = (per_bucket
                  .withColumn("_before", F.coalesce(
                      F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                  .withColumn("_n", F.sum("_c").over(Window.partitionBy("_cls"))))
    k = F.floor(F.col("_n") * F.lit(float(test_size)) + F.lit(0.5))
    cut = (per_bucket.where((F.col("_before") < k) & (k <= F.col("_before") + F.col("_c")))
           .select(F.col("_cls").alias("_cut_cls"), F.col("_bkt").alias("_cut_bkt"),
                   (k - F.col("_before")).alias("_need")))
    # one row per class, written, measured and broadcast: the table itself is never shuffled
    cut = checked_broadcast(materialize(cut, "split-buckets"))
    same = data["_cls"].eqNullSafe(cut["_cut_cls"])
    place = F.struct("_h", *keys)
    inside = (data.join(cut, same & (data["_bkt"] == cut["_cut_bkt"]))
              .withColumn("_r", F.row_number().over(Window.partitionBy("_cls", "_bkt").orderBy("_h", *keys))))
    last = (inside.where(F.col("_r") == F.col("_need"))
            .select(F.col("_cut_cls").alias("_last_cls"), place.alias("_last")))
    last = checked_broadcast(materialize(last, "split-cuts"))
    out = data.join(last, data["_cls"].eqNullSafe(last["_last_cls"]), "left")
    side = F.when(place <= F.col("_last"), F.lit("test")).otherwise(F.lit("train"))
    return out.withColumn(split_col, side).drop("_h", "_cls", "_bkt", "_last_cls", "_last")


def split_sizes(split: DataFrame, label: str, split_col: str = "split") -> DataFrame:
    """Rows ``(label, split, n)``: the size of each class on each side."""
    return split.groupBy(label, split_col).agg(F.count(F.lit(1)).alias("n"))


def _assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol=out,
                           handleInvalid="keep").transform(df)


def train_logistic(train: DataFrame, features, label: str, C: float = 1.0,
                   max_iter: int = 1000):
    """ML3: L2-regularised logistic regression with Spark ML (distributed L-BFGS).

    The penalty matches ``C`` of the original: Spark minimises
    ``mean loss + reg/2 |w|^2``, which equals the sum-of-losses objective
    ``C sum loss + 1/2 |w|^2`` scaled by ``1/(C n)``.  As in Spark, the
    intercept is not penalised (see :func:`train_logistic_newton` for that).
    """
    from pyspark.ml.classification import LogisticRegression

    n = train.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter,
                            regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, tol=1e-6)
    return lr.fit(_assemble(train, features).withColumn(label, F.col(label).cast("double")))


def train_logistic_newton(train: DataFrame, features, label: str, C: float = 1.0,
                          max_iter: int = 100, tol: float = 1e-10) -> np.ndarray:
    """ML3 (exact objective of the original solver): minimise
    ``1/2 |w|^2 + C sum log(1 + exp(-y' w.x))`` with the intercept as a penalised
    weight on a constant 1.

    Newton's method; each step is one aggregation pass over ``train`` that
    returns the gradient and Hessian sums (d + d(d+1)/2 numbers).  Raises if
    ``max_iter`` steps do not converge.  Returns the weights ``[w_1..w_d, intercept]``.
    """
    feats = list(features) + ["__one"]
    data = train.select(*[F.col(f).cast("double").alias(f) for f in features],
                        F.lit(1.0).alias("__one"), F.col(label).cast("double").alias("__y"))
    d = len(feats)
    w = np.zeros(d)
    for _ in range(max_iter):
        z = sum((F.lit(float(w[j])) * F.col(feats[j]) for j in range(d)), F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        r = p - F.col("__y")
        s = p * (F.lit(1.0) - p)
        aggs = [F.sum(r * F.col(feats[j])).alias(f"g{j}") for j in range(d)]
        aggs += [F.sum(s * F.col(feats[a]) * F.col(feats[b])).alias(f"h{a}_{b}")
                 for a in range(d) for b in range(a, d)]
        row = data.agg(*aggs).first()
        g = w + C * np.array([row[f"g{j}"] for j in range(d)])
        H = np.eye(d)
        for a in range(d):
            for b in range(a, d):
                H[a, b] += C * row[f"h{a}_{b}"]
                H[b, a] = H[a, b]
        step = np.linalg.solve(H, g)
        w = w - step
        if np.max(np.abs(step)) < tol:
            return w
    raise RuntimeError(f"Newton's method has not converged after {max_iter} steps")


def predict(model, df: DataFrame, features, prob_col: str = "probability_1",
            pred_col: str = "predicted") -> DataFrame:
    """ML4 + ML5 (SC16): class prediction (0.5 threshold) and class-1 probability."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_assemble(df, features))
    return (out.withColumn(prob_col, vector_to_array("probability")[1])
            .withColumn(pred_col, F.col("prediction").cast("int"))
            .drop("features", "rawPrediction", "probability", "prediction"))


def predict_with_weights(weights, df: DataFrame, features, prob_col: str = "probability_1",
                         pred_col: str = "predicted") -> DataFrame:
    """ML4 + ML5 for weights from :func:`train_logistic_newton` (intercept last)."""
    z = sum((F.lit(float(weights[j])) * F.col(c).cast("double")
             for j, c in enumerate(features)), F.lit(float(weights[-1])))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return df.withColumn(prob_col, p).withColumn(pred_col, (F.col(prob_col) > 0.5).cast("int"))


# Column names of the prediction table.
REAL_COLUMN, PROBABILITY_COLUMN, ERROR_COLUMN = "real_Outcome", "probability (y=1)", "Error"


def prediction_table(pred: DataFrame, label: str, k: int | None = 20,
                     prob_col: str = "probability_1", pred_col: str = "predicted",
                     tie_keys=()) -> DataFrame:
    """ML10 (SC8 + SC14 + ORD6): features with real class, prediction, probability
    rounded to 4 places, and ``Correcto`` / ``Incorrecto``; the k most probable first.
    """
    out = (pred.withColumnRenamed(label, REAL_COLUMN)
           .withColumn(PROBABILITY_COLUMN, scalars.round_half_even(prob_col, 4))
           .withColumn(ERROR_COLUMN, scalars.match_label(REAL_COLUMN, pred_col))
           .drop(prob_col))
    if k is None:
        return out
    return out.orderBy(F.col(PROBABILITY_COLUMN).desc(), *[F.col(c) for c in tie_keys]).limit(k)
