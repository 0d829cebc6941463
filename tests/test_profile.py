"""AGG14-AGG24: statistics, quantiles, correlation, histograms, density, 2-D bins, profiles."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001, rows
from tessel.operators import profile as pf
from tessel.operators import quantiles as qt
from tessel.plans import standins as si


def test_describe_matches_pandas(spark):
    df = si.clinical(spark, SF001)
    got = pf.describe(df).toPandas().set_index("column")
    pdf = df.toPandas()
    want = pdf.describe().T
    for c in want.index:
        for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert got.loc[c, ours] == pytest.approx(want.loc[c, theirs], rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("buckets,max_direct", [(3, 0), (16, 0), (256, 0), (256, 10 ** 6)])
def test_exact_quantiles_with_hot_value_and_few_buckets(spark, buckets, max_direct):
    rng = np.random.default_rng(3)
    hot = np.full(1500, 7.0)  # one value holds a third of the rows
    vals = np.concatenate([hot, rng.normal(0, 10, 2500), rng.integers(0, 5, 500)])
    rng.shuffle(vals)
    pdf = pd.DataFrame({"x": vals, "y": vals[::-1] * 2})
    df = spark.createDataFrame(pdf).repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = qt.exact_quantiles(df, ["x", "y"], probs, buckets=buckets,
                             max_direct=max_direct).toPandas()
    for c in ["x", "y"]:
        for p in probs:
            v = got[(got.column == c) & (got.p == p)]["quantile"].iloc[0]
            assert v == pytest.approx(np.quantile(pdf[c], p), rel=1e-12, abs=1e-12)


def test_quantiles_skip_nulls_and_single_value(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, None), (3.0, None)], "a double, b double")
    for max_direct in (0, 100):
        got = {(r.column, r.p): r.quantile
               for r in qt.exact_quantiles(df, ["a", "b"], [0.5], max_direct=max_direct).collect()}
        assert got == {("a", 0.5): 2.0, ("b", 0.5): 5.0}
    approx = {(r.column, r.p): r.quantile for r in
              qt.approx_quantiles(df, ["a", "b"], [0.5]).collect()}
    assert approx[("b", 0.5)] == 5.0


def test_info_shape_size(spark):
    df = spark.createDataFrame([(1, "ab", None), (2, None, 1.5)], "i int, s string, d double")
    info = rows(pf.table_info(df), ["position"])
    assert info == [(0, "i", "int", 2, 2), (1, "s", "string", 1, 2), (2, "d", "double", 1, 2)]
    assert tuple(pf.table_shape(df).first()) == (2, 3)
    size = {r.column: r.bytes for r in pf.size_profile(df).collect()}
    assert size == {"i": 8, "s": 2, "d": 8}


def test_corr_matrix_pairwise_complete_and_constant(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0, None], "b": [2.0, 4.1, 5.9, 8.2, 1.0],
                        "c": [1.0, 1.0, 1.0, 1.0, 1.0]})
    df = spark.createDataFrame(pdf)
    got = {(r.col_a, r.col_b): r.corr for r in pf.corr_matrix(df).collect()}
    want = pdf.corr()
    assert got[("a", "b")] == pytest.approx(want.loc["a", "b"], rel=1e-12)
    assert got[("b", "a")] == got[("a", "b")]
    assert got[("a", "a")] == 1.0
    assert got[("c", "c")] is None and got[("a", "c")] is None  # undefined, NaN in pandas


def test_histogram_common_and_per_group_ranges(spark):
    pdf = pd.DataFrame({"x": [0.0, 1.0, 2.0, 2.5, 9.0, 10.0, 10.0, None],
                        "g": [0, 0, 0, 1, 1, 1, 1, 1]})
    df = spark.createDataFrame(pdf)
    h = pf.histogram(df, "x", 5, by="g").toPandas()
    assert len(h) == 10 and h["count"].sum() == 7
    for g, part in pdf.dropna().groupby("g"):
        counts, edges = np.histogram(part.x, bins=5, range=(0.0, 10.0))
        got = h[h.g == g].sort_values("bin")
        assert got["count"].tolist() == counts.tolist()
        assert got.bin_lo.tolist() == pytest.approx(edges[:-1].tolist())
    sep = pf.histogram(df, "x", 4, by="g", common_range=False).toPandas()
    g1 = sep[sep.g == 1].sort_values("bin")
    counts, _ = np.histogram([2.5, 9.0, 10.0, 10.0], bins=4)
    assert g1["count"].tolist() == counts.tolist() and g1.bin_lo.iloc[0] == 2.5


def test_histogram_degenerate_range_and_no_group(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    h = rows(pf.histogram(df, "x", 2), ["bin"])
    assert h == [(0, 2.5, 3.0, 0), (1, 3.0, 3.5, 2)]


def test_kde_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(5, 2, 300), 1)
    g = (np.arange(300) % 3 == 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": g}))
    got = pf.kde(df, "x", by="g", gridsize=50).toPandas()
    for grp in (0, 1):
        v = x[g == grp]
        n = len(v)
        h = v.std(ddof=1) * n ** -0.2
        grid = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 50)
        dens = np.exp(-0.5 * ((grid[:, None] - v[None, :]) / h) ** 2).sum(1) / (
            n * h * math.sqrt(2 * math.pi))
        part = got[got.g == grp].sort_values("i")
        assert part.x.values == pytest.approx(grid, rel=1e-9)
        assert part.density.values == pytest.approx(dens, rel=1e-9)
    whole = pf.kde(df, "x", gridsize=20).toPandas()
    assert len(whole) == 20 and (whole.n == 300).all()


def test_pair_bins_counts_every_row_per_pair(spark):
    df = spark.createDataFrame([(1.0, 10.0, 5.0), (2.0, None, 6.0), (3.0, 30.0, 7.0)],
                               "a double, b double, c double")
    out = pf.pair_bins(df, ["a", "b", "c"], 2).toPandas()
    tot = out.groupby(["x_col", "y_col"])["count"].sum().to_dict()
    assert tot[("a", "c")] == 3 and tot[("a", "b")] == 2 and tot[("b", "a")] == 2
    assert len(tot) == 6


def test_column_profile_and_histograms(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", None), ("z", 2.0), (None, 4.0)],
                               "s string, v double")
    prof = {r.column: r for r in pf.column_profile(df).collect()}
    assert (prof["s"].n_unique, prof["s"].n_missing, prof["s"].top1, prof["s"].top1_count,
            prof["s"].top2, prof["s"].top2_count, prof["s"].others_count) == (3, 1, "x", 2, "y", 1, 1)
    assert (prof["v"].n_unique, prof["v"].n_missing, prof["v"].min, prof["v"].max) == (3, 1, 1.0, 4.0)
    hist = pf.column_histograms(df, ["v"], 3).toPandas().sort_values("bin")
    assert hist["count"].tolist() == [1, 2, 1]


def test_profiles_on_test_tables_agree_with_pandas(spark):
    df = si.airports_wide(spark, SF001)
    pdf = df.toPandas()
    prof = {r.column: r for r in pf.column_profile(df).collect()}
    vc = pdf.Country.value_counts()
    top = vc[vc == vc.max()].index.min()
    assert prof["Country"].top1 == top and prof["Country"].top1_count == vc.max()
    assert prof["Altitude"].n_unique == pdf.Altitude.nunique()
    assert pf.table_shape(df).first()[0] == len(pdf)
    assert df.select(F.count("*")).first()[0] == len(pdf)


def test_describe_modes_and_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "a double, b double")
    exact = {r.column: r for r in pf.describe(df).collect()}
    assert exact["a"]["count"] == 3 and exact["a"].mean == pytest.approx(7 / 3)
    assert exact["a"].std == pytest.approx(np.std([1, 2, 4], ddof=1)) and exact["a"].p50 == 2.0
    assert exact["b"]["count"] == 0 and exact["b"].mean is None
    approx = {r.column: r for r in pf.describe(df, exact=False).collect()}
    assert approx["a"]["count"] == 3 and approx["a"].std == pytest.approx(exact["a"].std)
    assert approx["a"].p50 == 2.0
