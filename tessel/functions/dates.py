"""Date and time expressions (SC1-SC7).

All parsing is lenient: a value that does not parse becomes NULL instead of
failing the job, which is what ``strict=False`` / ``errors='coerce'`` do in the
dataframe libraries the jobs were first written with.  Under ANSI mode the
plain ``to_date`` / ``cast`` forms throw, so only ``try_*`` forms appear here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.columns import col_of

MICROS_PER_DAY = 86_400_000_000.0
# The delay classes, from late to early.
DELAY_CLASSES = ("long_delay", "short_delay", "on_time")


def parse_date(c, fmt: str | None = None) -> Column:
    """SC1: text -> DATE, unparsable -> NULL."""
    c = col_of(c)
    return F.try_to_date(c, fmt) if fmt else F.try_to_date(c)


def parse_timestamp(c, fmt: str | None = None) -> Column:
    """SC2: text -> TIMESTAMP_NTZ (wall clock, no zone), unparsable -> NULL."""
    c = col_of(c)
    if fmt:
        return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")
    return c.try_cast("timestamp_ntz")


def year(c) -> Column:
    """SC3: calendar year as INT."""
    return F.year(col_of(c))


def month(c) -> Column:
    """SC3: calendar month 1-12 as INT."""
    return F.month(col_of(c))


def quarter_label(c) -> Column:
    """SC4: quarter period label, e.g. ``2018Q2``."""
    return F.date_format(col_of(c), "yyyy'Q'q")


def month_label(c) -> Column:
    """SC5: month period label, e.g. ``2018-05``."""
    return F.date_format(col_of(c), "yyyy-MM")


def days_between(end, start) -> Column:
    """SC6: signed difference ``end - start`` in fractional days (NULL if either is NULL).

    Exact microsecond difference divided by the day length; unlike
    ``timestampdiff(DAY, ...)`` it does not truncate.
    """
    return F.timestamp_diff("MICROSECOND", col_of(start), col_of(end)) / F.lit(MICROS_PER_DAY)


def delay_class(delta_days, long_after: float = 3.0, on_time_upto: float = 0.0,
                missing_label: str | None = None) -> Column:
    """SC7: three-way class of a delay in days.

    ``> long_after`` -> ``long_delay``; ``<= on_time_upto`` -> ``on_time``;
    everything else -> ``short_delay``.  A missing delay fails both tests and
    therefore lands in ``short_delay``, as the nested ``where`` it replaces
    does; pass ``missing_label`` to give it its own class instead.
    """
    d = col_of(delta_days)
    long_delay, short_delay, on_time = DELAY_CLASSES
    expr = F.when(d > F.lit(long_after), F.lit(long_delay)).when(
        d <= F.lit(on_time_upto), F.lit(on_time))
    if missing_label is not None:
        expr = expr.when(d.isNull(), F.lit(missing_label))
    return expr.otherwise(F.lit(short_delay))
