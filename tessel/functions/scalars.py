"""Scalar expressions (SC8-SC20) kept JVM-side so they stay inside whole-stage codegen."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.columns import col_of


# The labels of a correct / an incorrect prediction.
MATCH_LABELS = ("Correcto", "Incorrecto")


def match_label(a, b, same: str = MATCH_LABELS[0], different: str = MATCH_LABELS[1]) -> Column:
    """SC8: two-way label by equality of two columns."""
    return F.when(col_of(a) == col_of(b), F.lit(same)).otherwise(F.lit(different))


def zero_to_null(c) -> Column:
    """SC9: the sentinel 0 means missing."""
    return F.nullif(col_of(c), F.lit(0))


def nan_to_null(c) -> Column:
    """S1: NaN is not a missing value in Spark; turn it into NULL at load."""
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def fill(c, value) -> Column:
    """SC10: replace NULL with a constant (or another column)."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(col_of(c), v)


def hex_colour(c) -> Column:
    """SC11: deterministic ``#rrggbb`` colour from a text key (NULL stays NULL).

    The first six hex digits of the key's MD5.  Unlike a per-process salted
    hash this is stable across runs and engines.
    """
    return F.concat(F.lit("#"), F.substring(F.md5(col_of(c).cast("string")), 1, 6))


def custom_colour(c, fn) -> Column:
    """UDF1: a caller's own Python function ``key -> colour text``, applied in Arrow
    batches (a pandas UDF), for colour schemes no built-in expression expresses.
    Prefer :func:`hex_colour`, which stays in the JVM."""

    @F.pandas_udf("string")
    def apply(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else fn(k))

    return apply(col_of(c))


def join_text(a, b, sep: str = " → ") -> Column:
    """SC12: ``a + sep + b``; NULL if either side is NULL."""
    return F.concat(col_of(a), F.lit(sep), col_of(b))


def thousands(c) -> Column:
    """SC13: integer with thousands separators, e.g. ``1,234,567``."""
    return F.format_number(col_of(c), 0)


def two_decimals(c) -> Column:
    """SC13: fixed two decimals, e.g. ``12.50``."""
    return F.format_string("%.2f", col_of(c))


def year_month_label(y, m) -> Column:
    """SC13: ``yyyy-MM`` from integer year and month."""
    return F.format_string("%d-%02d", col_of(y), col_of(m))


def round_half_even(c, k: int) -> Column:
    """SC14: round to k decimals, ties to even (NumPy / pandas ``round``)."""
    return F.bround(col_of(c), k)


def clamp(c, lo: float, hi: float) -> Column:
    """SC15: ``max(lo, min(hi, c))``."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col_of(c)))


def vector_element(c, i: int) -> Column:
    """SC16: element i of an ML vector column."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(col_of(c))[i]


def point(lat, lon) -> Column:
    """SC17: ``[lat, lon]``."""
    return F.array(col_of(lat), col_of(lon))


def segment(lat1, lon1, lat2, lon2) -> Column:
    """SC17: polyline ``[[lat1, lon1], [lat2, lon2]]``."""
    return F.array(point(lat1, lon1), point(lat2, lon2))


def lenient_cast(c, to: str) -> Column:
    """SC18 / PRJ2: cast that yields NULL instead of failing on bad input."""
    return col_of(c).try_cast(to)
