"""Column expressions: dates (SC1-SC7) and scalars (SC8-SC20)."""

from tessel.functions import dates, scalars
from tessel.functions.columns import col_of, numeric_columns

__all__ = ["dates", "scalars", "col_of", "numeric_columns"]
