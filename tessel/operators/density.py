"""Kernel density by linear binning and a truncated kernel (AGG21), free of the number of values.

A value's weight is split between the two neighbouring points of a fine grid; the density on the
wanted grid is then the sum over the occupied fine points within the kernel's reach.  With fine
step ``delta`` and bandwidth ``h`` the split replaces the kernel by its linear interpolation, whose
error is at most ``delta**2 / 8`` times the largest second derivative: ``delta**2 / (8 h**2)`` of the
kernel's peak ``1 / (h sqrt(2 pi))``.  The step is chosen so that this is half of ``tolerance``, the
reach so that the tails left out are less than the other half; hence no grid point is off by more
than ``tolerance / (h sqrt(2 pi))``.

Fine points lie within a group's range, so a group has at most ``range / delta`` of them: some
hundred thousand for a billion rows at the default tolerance, whatever the number of values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.scalars import nan_to_null
from tessel.operators.joins import checked_broadcast
from tessel.session import materialize


def kde_binned(df: DataFrame, col: str, by=None, gridsize: int = 200, cut: float = 3.0, tolerance: float = 1e-6) -> DataFrame:
    """AGG21: Gaussian kernel density as :func:`tessel.operators.profile.kde` gives it (Scott's rule,
    same grid, same columns ``by..., i, x, density, n``), within ``tolerance`` of the kernel's peak.

    Missing values (NULL, NaN) are left out; groups without spread have no rows; a NULL group is
    left out.  Two passes over the rows; a task hands on a row per occupied fine point.
    """
    if not 0 < tolerance < 1:
        raise ValueError("tolerance is a share of the kernel's peak")
    by = [by] if isinstance(by, str) else list(by or [])
    key = [f"_by{k}" for k in range(len(by))] or ["_all"]  # names that clash with none below
    groups = [F.col(c).alias(k) for c, k in zip(by, key)] or [F.lit(0).alias("_all")]
    data = df.select(*groups, nan_to_null(F.col(col).cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    for c in key:
        data = data.where(F.col(c).isNotNull())
    h = F.col("s") * F.pow(F.col("n"), F.lit(-0.2))
    params = materialize(
        data.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("_v").alias("s"), F.min("_v").alias("mn"), F.max("_v").alias("mx"))
        .withColumn("h", h).where("h > 0")
        .withColumns({"lo": F.col("mn") - F.lit(cut) * F.col("h"), "step": (F.col("mx") - F.col("mn") + F.lit(2 * cut) * F.col("h")) / F.lit(gridsize - 1),
                      "delta": F.col("h") * F.lit(math.sqrt(4 * tolerance))})
        .select(*key, "n", "h", "mn", "lo", "step", "delta"), "density-params")
    held = checked_broadcast(params)  # a row per group
    place = (F.col("_v") - F.col("mn")) / F.col("delta")
    at = F.floor(place)
    # per fine point: its rows, and the part of them that goes to the next point
    left = (data.join(held, key).select(*key, at.alias("j"), (place - at).alias("f"))
            .groupBy(*key, "j").agg(F.count(F.lit(1)).alias("c"), F.sum("f").alias("f")))
    both = F.explode(F.array(F.struct(F.col("j"), (F.col("c") - F.col("f")).alias("w")), F.struct((F.col("j") + 1).alias("j"), F.col("f").alias("w")))).alias("p")
    fine = left.select(*key, both).select(*key, "p.*").where("w > 0").groupBy(*key, "j").agg(F.sum("w").alias("w"))
    reach = math.sqrt(-2 * math.log(tolerance / 2))
    g = F.col("mn") + F.col("j") * F.col("delta")
    first = F.greatest(F.lit(0), F.ceil((g - reach * F.col("h") - F.col("lo")) / F.col("step"))).cast("int")
    last = F.least(F.lit(gridsize - 1), F.floor((g + reach * F.col("h") - F.col("lo")) / F.col("step"))).cast("int")
    near = (fine.join(checked_broadcast(params), key).withColumns({"g": g, "first": first, "last": last}).where(F.col("first") <= F.col("last"))
            .withColumn("i", F.explode(F.sequence("first", "last"))))
    z = (F.col("lo") + F.col("i") * F.col("step") - F.col("g")) / F.col("h")
    sums = near.groupBy(*key, "i").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("k"))
    grid = params.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))))
    norm = F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))
    return (grid.join(sums, [*key, "i"], "left")
            .select(*[F.col(k).alias(c) for c, k in zip(by, key)], "i", (F.col("lo") + F.col("i") * F.col("step")).alias("x"), (F.coalesce("k", F.lit(0.0)) / norm).alias("density"), "n"))
