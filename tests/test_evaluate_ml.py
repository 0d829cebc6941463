"""ML1-ML10: confusion matrix, report, ROC, AUC, imputation, split, logistic models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001, rows
from tessel.operators import evaluate as ev
from tessel.operators import ml
from tessel.plans import standins as si


def _roc_brute(y, s, drop=True):
    order = np.argsort(-s, kind="mergesort")
    y, s = y[order], s[order]
    idx = np.r_[np.where(np.diff(s))[0], y.size - 1]
    tps = np.cumsum(y)[idx]
    fps = 1 + idx - tps
    thr = s[idx]
    if drop and len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    fpr = np.r_[0, fps] / fps[-1]
    tpr = np.r_[0, tps] / tps[-1]
    return np.r_[np.inf, thr], fpr, tpr


def _mann_whitney(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


@pytest.mark.parametrize("buckets", [2, 5, 256])
@pytest.mark.parametrize("case", ["ties", "perfect", "reversed"])
def test_roc_and_auc_match_brute_force(spark, case, buckets):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 400)
    if case == "ties":
        s = np.round(rng.random(400) * 0.5 + y * 0.2, 2)
    elif case == "perfect":
        s = y * 0.5 + rng.random(400) * 0.4
    else:
        s = (1 - y) * 0.5 + rng.random(400) * 0.4
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s})).repartition(6)
    for drop in (True, False):
        thr, fpr, tpr = _roc_brute(y, s, drop)
        got = ev.roc_points(df, drop_intermediate=drop, buckets=buckets).toPandas()
        got = got.sort_values("threshold", ascending=False)
        assert got.threshold.tolist() == thr.tolist()
        assert got.fpr.values == pytest.approx(fpr) and got.tpr.values == pytest.approx(tpr)
    auc = ev.auc(df, buckets=buckets).first()[0]
    assert auc == pytest.approx(np.trapezoid(tpr, fpr)) and auc == pytest.approx(_mann_whitney(y, s))


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "label int, score double")
    assert ev.auc(df).first()[0] is None


def test_confusion_fills_zero_cells_and_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 0)], "label int, prediction int")
    cm = rows(ev.confusion(df), ["label", "prediction"])
    assert len(cm) == 9 and (1, 1, 0) in cm and (0, 0, 2) in cm
    rep = {r.name: r for r in ev.class_report(df, digits=None).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1_score == 0.0
    assert rep["0"].precision == 0.5 and rep["0"].recall == 1.0
    assert rep["accuracy"].support == 0.5 and rep["macro avg"].support == 4.0
    assert rep["weighted avg"].recall == pytest.approx(0.5)
    names = [r.name for r in ev.class_report(df, target_names={0: "No", 1: "Yes"}).collect()]
    assert names == ["No", "Yes", "2", "accuracy", "macro avg", "weighted avg"]


def test_report_matches_hand_computation(spark):
    y = [0, 0, 0, 1, 1, 1, 1, 0]
    p = [0, 1, 0, 1, 1, 0, 1, 0]
    df = spark.createDataFrame(list(zip(y, p)), "label int, prediction int")
    rep = {r.name: r for r in ev.class_report(df).collect()}
    # class 1: tp 3, fp 1, fn 1 -> precision .75 recall .75 f1 .75
    assert (rep["1"].precision, rep["1"].recall, rep["1"].f1_score, rep["1"].support) == (
        0.75, 0.75, 0.75, 4.0)
    assert rep["accuracy"].precision == 0.75


def test_impute_mean_uses_nonzero_values(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 5.0), (4.0, None)], "a double, b double")
    out = rows(ml.impute_mean(df, ["a"]))
    assert out == [(2.0, 5.0), (3.0, 0.0), (4.0, None)]


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_stratified_split_exact_sizes(spark, bits):
    data = [(i, "hot" if i % 10 < 7 else ("mid" if i % 10 < 9 else "rare")) for i in range(2000)]
    data += [(5000, None), (5001, None), (5002, None)]
    df = spark.createDataFrame(data, "id long, label string").repartition(5)
    sp = ml.stratified_split(df, "label", 0.3, 42, key_cols=["id"], bits=bits)
    sizes = {(r.label, r.split): r.n for r in ml.split_sizes(sp, "label").collect()}
    for lab, n in [("hot", 1400), ("mid", 400), ("rare", 200), (None, 3)]:
        k = int(np.floor(n * 0.3 + 0.5))
        assert sizes.get((lab, "test"), 0) == k and sizes.get((lab, "train"), 0) == n - k
    assert sp.count() == 2003 and sp.select("id").distinct().count() == 2003
    base = ml.stratified_split(df.coalesce(1), "label", 0.3, 42, key_cols=["id"], bits=8)
    a = {r.id for r in sp.where("split = 'test'").collect()}
    b = {r.id for r in base.where("split = 'test'").collect()}
    assert a == b  # independent of layout and of the bucket count


def _newton_numpy(X, y, C=1.0):
    Xb = np.c_[X, np.ones(len(X))]
    w = np.zeros(Xb.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-Xb @ w))
        g = w + C * Xb.T @ (p - y)
        H = np.eye(len(w)) + C * (Xb.T * (p * (1 - p))) @ Xb
        step = np.linalg.solve(H, g)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    return w


def test_newton_matches_numpy_and_spark_model_predicts(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(600, 3))
    y = (X @ np.array([1.5, -2.0, 0.5]) + 0.3 + rng.normal(size=600) > 0).astype(int)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(y=y, id=np.arange(600))
    df = spark.createDataFrame(pdf)
    w = ml.train_logistic_newton(df, ["a", "b", "c"], "y")
    assert w == pytest.approx(_newton_numpy(X, y), rel=1e-8, abs=1e-10)
    scored = ml.predict_with_weights(w, df, ["a", "b", "c"]).toPandas()
    assert ((scored.probability_1 > 0.5).astype(int) == scored.predicted).all()
    model = ml.train_logistic(df, ["a", "b", "c"], "y")
    pred = ml.predict(model, df, ["a", "b", "c"])
    acc = pred.select(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.8
    table = ml.prediction_table(pred, "y", 5, tie_keys=["id"]).toPandas()
    assert len(table) == 5 and set(table.Error) <= {"Correcto", "Incorrecto"}
    assert table["probability (y=1)"].is_monotonic_decreasing


def test_train_predict_pipeline_on_test_tables(spark):
    data = ml.impute_mean(si.clinical(spark, SF001), ["l_discount", "l_tax"])
    assert data.where("l_discount = 0 OR l_tax = 0").count() == 0
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    split = ml.stratified_split(data, "Outcome", 0.3, 42, key_cols=["l_orderkey", "l_linenumber"])
    model = ml.train_logistic(split.where("split = 'train'"), feats, "Outcome")
    pred = ml.predict(model, split.where("split = 'test'"), feats)
    assert pred.count() == split.where("split = 'test'").count()


def test_classifier_plan_end_to_end(spark):
    from tessel.plans import classifier as cl

    rng = np.random.default_rng(9)
    n = 500
    pdf = pd.DataFrame({"id": np.arange(n), "Glucose": rng.normal(120, 30, n).round(),
                        "BMI": rng.normal(32, 6, n).round(1), "Age": rng.integers(21, 80, n)})
    pdf.loc[::17, "Glucose"] = 0.0  # zero = not measured
    pdf["Outcome"] = ((pdf.Glucose > 130) ^ (rng.random(n) < 0.15)).astype(int)
    data = cl.load_clinical(spark.createDataFrame(pdf))
    assert data.where("Glucose = 0").count() == 0
    for exact in (False, True):
        t = cl.train_classifier(data, "Outcome", ["Glucose", "BMI", "Age"], key_cols=["id"],
                                exact_objective=exact)
        res = cl.evaluate_classifier(cl.predict(t, t["test"]), "Outcome", tie_keys=["id"])
        assert res["predictions"].count() == 20
        assert 0.5 < res["auc"].first()[0] <= 1.0
        assert res["confusion"].select(F.sum("count")).first()[0] == t["test"].count()
        assert res["probability_histogram"].count() == 40
    views = cl.explore(data)
    assert {"describe", "correlation", "histogram_Glucose", "pair_bins"} <= set(views)
    assert views["histogram_Glucose"].select(F.sum("count")).first()[0] == n


def test_profile_table_job(spark):
    from tessel.plans.profiling import profile_table

    out = profile_table(si.airports_wide(spark, SF001))
    assert out["shape"].first()[0] == 150
    assert {r.column for r in out["describe"].collect()} == {"AirportID", "Altitude"}
    assert out["column_histograms"].select(F.sum("count")).first()[0] == 300


def test_impute_mean_can_fit_on_training_rows(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 2.0), (3, 4.0), (4, 10.0)], "id int, a double")
    train = df.where("id <= 3")
    out = {r.id: r.a for r in ml.impute_mean(df, ["a"], fit_on=train).collect()}
    assert out[1] == 3.0 and out[4] == 10.0  # mean of the training part's non-zero values
    leak = {r.id: r.a for r in ml.impute_mean(df, ["a"]).collect()}
    assert leak[1] == pytest.approx(16.0 / 3)
