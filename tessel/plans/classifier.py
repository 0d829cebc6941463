"""Classifier workload (W4): load -> impute -> split -> fit -> predict -> evaluate, and the
profile tables of its exploration tab.

Each function returns lazy DataFrames (a dict of them for the multi-table
steps).  Only the model fit runs eagerly, as any estimator does; its
aggregation passes are distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators import evaluate as ev
from tessel.operators import ml
from tessel.operators import profile as pf
from tessel.session import materialize

# The clinical columns in which 0 means "not measured".
ZERO_MEANS_MISSING = ["Glucose", "BloodPressure", "SkinThickness", "Insulin", "BMI"]


def load_clinical(df: DataFrame, zero_missing_cols=ZERO_MEANS_MISSING) -> DataFrame:
    """ML1: zeros in the listed columns are missing values, filled with the column mean."""
    cols = [c for c in zero_missing_cols if c in df.columns]
    return ml.impute_mean(df, cols)


def train_classifier(data: DataFrame, label: str = "Outcome", features=None,
                     test_size: float = 0.3, seed: int = 42, key_cols=None, C: float = 1.0,
                     exact_objective: bool = False) -> dict:
    """ML2 + ML3: stratified split and logistic regression on the training part.

    ``exact_objective`` fits the penalised-intercept objective by Newton steps
    (weights returned under ``"weights"``) instead of Spark ML's estimator.
    Returns ``{"model" | "weights", "train", "test", "features"}``.
    """
    features = list(features) if features else [c for c in data.columns
                                                if c != label and c not in (key_cols or [])]
    data = materialize(data, "classifier-input")  # the split reads it several times
    # written once: the fit, its row count and the scoring of the test part all read it
    split = materialize(ml.stratified_split(data, label, test_size, seed, key_cols=key_cols),
                        "split")
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    out = {"train": train, "test": test, "features": features}
    if exact_objective:
        out["weights"] = ml.train_logistic_newton(train, features, label, C)
    else:
        out["model"] = ml.train_logistic(train, features, label, C)
    return out


def predict(trained: dict, df: DataFrame) -> DataFrame:
    """ML4 + ML5: predicted class and class-1 probability for ``df``."""
    if "model" in trained:
        return ml.predict(trained["model"], df, trained["features"])
    return ml.predict_with_weights(trained["weights"], df, trained["features"])


class LazyTables(dict):
    """A mapping of table name -> DataFrame whose tables are built on first access.

    Some evaluation tables write a small intermediate table when they are built;
    a caller that reads only one of them does not pay for the others.
    """

    def __init__(self, builders: dict):
        super().__init__()
        self._builders = dict(builders)

    def __getitem__(self, key):
        if not dict.__contains__(self, key):
            dict.__setitem__(self, key, self._builders[key]())
        return dict.__getitem__(self, key)

    def __contains__(self, key):
        return key in self._builders

    def __iter__(self):
        return iter(self._builders)

    def __len__(self):
        return len(self._builders)

    def keys(self):
        return self._builders.keys()


def evaluate_classifier(pred: DataFrame, label: str = "Outcome",
                        target_names: dict | None = None, top: int = 20,
                        tie_keys=()) -> LazyTables:
    """ML6-ML10 + AGG20/AGG21 on a prediction table: confusion matrix, report, ROC
    curve, AUC, per-class probability histograms and densities, top predictions.

    Tables are built when first read from the returned mapping."""
    scored = pred.select(F.col(label).alias("label"), F.col("predicted").alias("prediction"),
                         F.col("probability_1").alias("score"))
    return LazyTables({
        "confusion": lambda: ev.confusion(scored),
        "report": lambda: ev.class_report(scored, target_names=target_names),
        "roc": lambda: ev.roc_points(scored),
        "auc": lambda: ev.auc(scored),
        "probability_histogram": lambda: pf.histogram(scored, "score", 20, by="label",
                                                      common_range=False),
        "probability_density": lambda: pf.kde(scored, "score", by="label"),
        "predictions": lambda: ml.prediction_table(pred, label, top, tie_keys=tie_keys),
    })


def explore(data: DataFrame, label: str = "Outcome", hist_cols=("Glucose", "BMI"),
            pair_cols=ZERO_MEANS_MISSING) -> dict:
    """The exploration tab: statistics, class histograms with densities, pair bins, correlation."""
    out = {"describe": pf.describe(data), "correlation": pf.corr_matrix(data)}
    for c in hist_cols:
        if c in data.columns:
            out[f"histogram_{c}"] = pf.histogram(data, c, 25, by=label)
            out[f"density_{c}"] = pf.kde(data, c, by=label)
    pairs = [c for c in pair_cols if c in data.columns]
    if len(pairs) > 1:
        out["pair_bins"] = pf.pair_bins(data, pairs, 10)
        out["pair_density"] = {c: pf.kde(data, c) for c in pairs}
    return out
