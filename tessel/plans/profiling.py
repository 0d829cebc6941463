"""``profile_table``: every profile of a table (AGG14-AGG22, AGG24)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessel.functions.columns import numeric_columns
from tessel.operators import profile as pf


def profile_table(df: DataFrame, exact_quantiles: bool = True, bins: int = 10,
                  label: str | None = None, hist_cols=None, pair_cols=None) -> dict:
    """``describe`` / ``info`` / ``shape`` / ``size`` / ``correlation`` / ``column_profile`` /
    ``column_histograms`` of one table, the density of each column of ``hist_cols`` (all
    numeric columns by default) under ``density``, and the joint bins of ``pair_cols`` under
    ``pair_bins``.  With ``label`` the densities are per class and ``class_histograms`` holds
    a 25-bin histogram by class of each of ``hist_cols``.
    """
    num = numeric_columns(df, exclude=(label,) if label else ())
    out = {
        "info": pf.table_info(df),
        "shape": pf.table_shape(df),
        "size": pf.size_profile(df),
        "column_profile": pf.column_profile(df),
    }
    if num:
        cols = list(hist_cols) if hist_cols is not None else num
        pairs = list(pair_cols) if pair_cols is not None else num
        out["describe"] = pf.describe(df, exact=exact_quantiles)
        out["correlation"] = pf.corr_matrix(df)
        out["column_histograms"] = pf.column_histograms(df, num, bins)
        out["density"] = {c: pf.kde(df, c, by=label) for c in cols}
        if len(pairs) > 1:
            out["pair_bins"] = pf.pair_bins(df, pairs, bins)
        if label:
            out["class_histograms"] = {c: pf.histogram(df, c, 25, by=label) for c in cols}
    return out
