"""Correlation by co-moment blocks (AGG18)."""

import numpy as np
import pandas as pd
import pytest

from conftest import plan_of
from tessel.operators import comoments as cm
from tessel.operators import profile as pf


def frame(n, d, seed=0, missing=0.1, offset=0.0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) @ r.normal(size=(d, d)) + offset
    x[r.random((n, d)) < missing] = np.nan
    return x


def state_of(x, cut):
    state = None
    for a, b in zip([0, *cut], [*cut, len(x)]):
        if b > a:
            state = cm.merged(state, cm.block_state(x[a:b]))
    return state


@pytest.mark.parametrize("missing", [0.0, 0.2, 0.95])
@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_merged_blocks_equal_the_whole(missing, offset):
    x = frame(300, 6, 1, missing, offset)
    x[:, 5] = 0.1  # constant
    x[:, 4][np.isnan(x[:, 3])] = np.nan
    got = cm.correlation(state_of(x, [1, 2, 50, 51, 299]))
    want = pd.DataFrame(x).corr(min_periods=2).to_numpy()
    want[np.abs(want) == np.inf] = np.nan
    assert np.isnan(got[5]).all() and np.isnan(got[:, 5]).all()
    assert np.allclose(got[:5, :5], want[:5, :5], atol=1e-6 if offset else 1e-10, equal_nan=True)


def test_constant_on_the_pairs_rows_only():
    x = np.array([[0.3, 1.0], [0.3, 2.0], [0.3, 5.0], [7.0, np.nan], [9.0, np.nan]])
    for cut in ([], [1], [2, 3], [1, 2, 3, 4]):
        c = cm.correlation(state_of(x, cut))
        assert np.isnan(c[0, 1]) and np.isnan(c[1, 0]) and c[0, 0] == pytest.approx(1)


def test_infinite_values_spoil_their_own_column_only():
    x = frame(50, 3, 2, 0.0)
    x[7, 1] = np.inf
    c = cm.correlation(state_of(x, [20]))
    assert np.isnan(c[1]).all() and not np.isnan(c[0, 2])


def test_five_hundred_columns_with_nulls_and_a_constant(spark):
    x = frame(700, 500, 3, 0.05, 50.0)
    x[:, 17] = 4.25
    x[:, 18] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(500)])
    df = spark.createDataFrame(pdf).repartition(5)
    out = pf.corr_matrix(df)
    got = out.toPandas().pivot(index="col_a", columns="col_b", values="corr").loc[pdf.columns, pdf.columns].to_numpy(float)
    want = pdf.corr().to_numpy()
    want[17, :] = want[:, 17] = np.nan
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)
    assert (np.diag(np.delete(got, [17, 18], 0)[:, np.delete(np.arange(500), [17, 18])]) == 1).all()


def test_one_pass_and_no_pair_expressions(spark):
    df = spark.range(100).selectExpr(*[f"cast(id * {i + 1} % 17 as double) c{i}" for i in range(40)])
    plan = plan_of(pf.corr_matrix(df))
    assert plan.count("MapInArrow") == 3 and plan.count("Range (") == 1 and "covar" not in plan and "corr(" not in plan


def test_no_rows_and_no_columns(spark):
    empty = spark.createDataFrame([], "a double, `b.c` int")
    assert sorted(map(tuple, pf.corr_matrix(empty).collect())) == sorted((a, b, None) for a in ("a", "b.c") for b in ("a", "b.c"))
    assert pf.corr_matrix(spark.createDataFrame([("x",)], "t string")).count() == 0
