"""Property checks on random inputs, few examples each."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.operators import evaluate as ev
from tessel.operators import ml, ordering
from tessel.operators import profile as pf
from tessel.operators import quantiles as qt

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.lists(st.one_of(st.integers(-5, 5).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=60)


@SETTINGS
@given(vals=values, parts=st.integers(1, 5))
def test_quantiles_equal_numpy(spark, vals, parts):
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(parts)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for max_direct in (0, 10 ** 6):
        got = {r.p: r["quantile"] for r in
               qt.exact_quantiles(df, ["x"], probs, buckets=4, max_direct=max_direct).collect()}
        for p in probs:
            want = float(np.quantile(np.array(vals), p))
            assert abs(got[p] - want) <= 1e-9 * max(1.0, abs(want))


@SETTINGS
@given(vals=values, bins=st.integers(1, 12))
def test_histogram_counts_every_value_once(spark, vals, bins):
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(vals)], "x double, g int")
    h = pf.histogram(df, "x", bins, by="g").toPandas()
    assert h["count"].sum() == len(vals)
    assert (h.groupby("g").size() == bins).all()


@SETTINGS
@given(data=st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 20)), min_size=1,
                     max_size=80), k=st.integers(1, 4))
def test_top_k_per_group_is_the_sorted_prefix(spark, data, k):
    rows = [(g, i, v) for i, (g, v) in enumerate(data)]
    df = spark.createDataFrame(rows, "g string, id long, v long")
    got = ordering.top_k_per_group(df, "g", ["-v", "id"], k, salt_buckets=3) \
        .select("g", "id").toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "id", "v"]).sort_values(
        ["g", "v", "id"], ascending=[True, False, True]).groupby("g").head(k)
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, pdf[["g", "id"]].values.tolist()))


@SETTINGS
@given(labels=st.lists(st.sampled_from(["x", "y", "z"]), min_size=1, max_size=120),
       size=st.sampled_from([0.1, 0.3, 0.5]))
def test_split_sizes_are_exact_and_disjoint(spark, labels, size):
    df = spark.createDataFrame(list(enumerate(labels)), "id long, label string")
    sp = ml.stratified_split(df, "label", size, 7, key_cols=["id"], bits=3)
    got = sp.toPandas()
    assert sorted(got.id) == list(range(len(labels)))
    for lab, part in got.groupby("label"):
        n = len(part)
        assert (part.split == "test").sum() == int(np.floor(n * size + 0.5))


@SETTINGS
@given(pairs=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=80))
def test_auc_equals_mann_whitney(spark, pairs):
    y = np.array([p[0] for p in pairs])
    s = np.array([p[1] / 6.0 for p in pairs])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    got = ev.auc(df, buckets=3).first()[0]
    if y.min() == y.max():
        assert got is None
        return
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (
        len(pos) * len(neg))
    assert abs(got - want) < 1e-12


@SETTINGS
@given(n=st.integers(1, 40), seed=st.integers(0, 10 ** 6))
def test_sample_is_exact_and_layout_independent(spark, n, seed):
    df = spark.range(0, 30).withColumn("v", F.col("id") * 7)
    a = sorted(r.id for r in ordering.sample_n(df, n, seed=seed).collect())
    b = sorted(r.id for r in ordering.sample_n(df.repartition(3), n, seed=seed).collect())
    assert a == b and len(a) == min(n, 30)
