"""Binary / multi-class evaluation (ML6-ML9) as aggregates over a predictions table.

The ROC curve needs running sums of positives and negatives in descending
score order.  A window over the whole table would put every row in one
task, so the running sums are built in three steps: counts per distinct
score (partial aggregate), buckets of distinct scores from a sketch, and
a prefix sum over the small bucket table added to per-bucket running sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.quantiles import MAX_BUCKETS, TARGET_PER_BUCKET, count_below
from tessel.session import materialize

DEFAULT_BUCKETS = 256


def _cells(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, count)`` of the pairs that occur; rows that lack either are left out."""
    both = df.select(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
    return (both.where(F.col("label").isNotNull() & F.col("prediction").isNotNull())
            .groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count")))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """ML6: ``(label, prediction, count)`` for every pair of classes seen in either column,
    zero cells included.

    The counts (a row per pair that occurs) are joined with the grid, so k classes cost k * k cells.
    """
    seen = df.select(F.explode(F.array(F.col(label), F.col(prediction))).alias("c")).where(F.col("c").isNotNull())
    classes = seen.agg(F.collect_set("c").alias("cls"))  # a value per class
    grid = classes.select(F.explode("cls").alias("label"), "cls").select("label", F.explode("cls").alias("prediction"))
    return (grid.join(_cells(df, label, prediction), ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce("count", F.lit(0)).alias("count")))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                 target_names: dict | None = None, digits: int | None = 3) -> DataFrame:
    """ML7: precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    Rows ``(name, precision, recall, f1_score, support)`` in the layout of the
    transposed report: the ``accuracy`` row repeats the accuracy in every
    column.  A zero denominator gives 0.  ``digits``: round half to even.
    Empty cells add nothing, so only the pairs that occur are read.
    """
    # every cell counts once for its label and once for its prediction: one pass
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    both = F.array(
        F.struct(F.col("label").alias("cls"), hit.alias("tp"), F.col("count").alias("support"), none.alias("pred")),
        F.struct(F.col("prediction").alias("cls"), none.alias("tp"), none.alias("support"), F.col("count").alias("pred")))
    per = (_cells(df, label, prediction).select(F.explode(both).alias("c")).select("c.*").groupBy("cls")
           .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("pred").alias("pred")))
    p = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                F.lit(2.0) * F.col("precision") * F.col("recall")
                / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    per = per.withColumn("f1_score", f1)
    if target_names:
        name = F.coalesce(F.element_at(F.create_map(*[x for k, v in target_names.items()
                                                      for x in (F.lit(k), F.lit(v))]),
                                       F.col("cls")), F.col("cls").cast("string"))
    else:
        name = F.col("cls").cast("string")
    each = F.struct(name.alias("name"), F.col("cls").cast("double").alias("_order"), "precision",
                    "recall", "f1_score", F.col("support").cast("double").alias("support"))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                  F.avg("f1_score").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("wf"),
                  F.collect_list(each).alias("rows"))  # a row per class
    acc = F.col("tp") / F.col("n")
    def row(name, order, p, r, f, sup):
        return F.struct(F.lit(name).alias("name"), F.lit(order).alias("_order"),
                        p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
                        sup.alias("support"))

    n = F.col("n").cast("double")
    summary = F.array(
        row("accuracy", 1e300, acc, acc, acc, acc),
        row("macro avg", 2e300, F.col("mp"), F.col("mr"), F.col("mf"), n),
        row("weighted avg", 3e300, F.col("wp"), F.col("wr"), F.col("wf"), n))
    out = tot.select(F.explode(F.concat("rows", summary)).alias("s")).select("s.*").orderBy("_order").drop("_order")
    if digits is not None:
        out = out.select("name", *[F.bround(c, digits).alias(c)
                                   for c in ("precision", "recall", "f1_score", "support")])
    return out


def _score_bounds(per_score: DataFrame, buckets: int):
    fractions = [i / buckets for i in range(1, buckets)]
    return per_score.select(F.percentile_approx("score", fractions, 10 * buckets)).scalar()


def cumulative_by_score(df: DataFrame, label: str = "label", score: str = "score",
                        pos_label=1, buckets: int | None = None) -> DataFrame:
    """Per distinct score (descending): own positives ``tp`` / negatives ``fp`` and the
    running totals ``tps`` / ``fps`` down to that score, plus ``next_tp`` / ``next_fp``
    of the next lower score (NULL for the lowest).
    """
    per_score = (df.where(F.col(score).isNotNull())
                 .groupBy(F.col(score).cast("double").alias("score"))
                 .agg(F.sum(F.when(F.col(label) == F.lit(pos_label), 1).otherwise(0)).alias("tp"),
                      F.sum(F.when(F.col(label) == F.lit(pos_label), 0).otherwise(1)).alias("fp")))
    per_score = materialize(per_score)
    if buckets is None:
        # about TARGET_PER_BUCKET distinct scores per bucket (the table is already written)
        buckets = min(MAX_BUCKETS, max(DEFAULT_BUCKETS, -(-per_score.count() // TARGET_PER_BUCKET)))
    bounds = _score_bounds(per_score, buckets)
    # bucket 0 holds the highest scores: b = (number of bounds) - (bounds strictly below)
    ps = count_below(per_score.withColumn("_bounds", bounds), "score", "_bounds", buckets - 1,
                     "_below")
    ps = ps.withColumn("b", F.size("_bounds") - F.col("_below")).drop("_bounds", "_below")
    per_bucket = ps.groupBy("b").agg(
        F.sum("tp").alias("btp"), F.sum("fp").alias("bfp"),
        F.max_by(F.struct("tp", "fp"), "score").alias("first"))
    wb = Window.orderBy("b")  # one row per bucket: a small, bounded table
    per_bucket = per_bucket.select(
        "b",
        F.coalesce(F.sum("btp").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("tp_before"),
        F.coalesce(F.sum("bfp").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("fp_before"),
        F.lead("first").over(wb).alias("next_first"))
    w = Window.partitionBy("b").orderBy(F.col("score").desc())
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = (ps.join(F.broadcast(per_bucket), "b")
           .withColumn("tps", F.col("tp_before") + F.sum("tp").over(run))
           .withColumn("fps", F.col("fp_before") + F.sum("fp").over(run))
           .withColumn("next_tp", F.coalesce(F.lead("tp").over(w), F.col("next_first.tp")))
           .withColumn("next_fp", F.coalesce(F.lead("fp").over(w), F.col("next_first.fp"))))
    return out.select("score", "tp", "fp", "tps", "fps", "next_tp", "next_fp")


def roc_points(df: DataFrame, label: str = "label", score: str = "score", pos_label=1,
               drop_intermediate: bool = True, buckets: int | None = None) -> DataFrame:
    """ML8: ROC curve rows ``(threshold, fpr, tpr)``, thresholds descending from +inf.

    One point per distinct score (tied scores share a point), preceded by
    ``(inf, 0, 0)``.  ``drop_intermediate`` removes points on a straight
    segment: an interior point whose next point adds the same positives and
    negatives as it did itself (the second differences are zero).
    """
    cum = materialize(cumulative_by_score(df, label, score, pos_label, buckets))
    totals = cum.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"), F.count(F.lit(1)).alias("k"),
                     F.max("score").alias("top"))
    P, N = totals.select("P").scalar(), totals.select("N").scalar()
    k, top = totals.select("k").scalar(), totals.select("top").scalar()
    pts = cum
    if drop_intermediate:
        keep = ((k <= 2) | (F.col("score") == top) | F.col("next_tp").isNull()
                | (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp")))
        pts = cum.where(keep)
    curve = pts.select(F.col("score").alias("threshold"),
                       F.try_divide(F.col("fps"), N).alias("fpr"),
                       F.try_divide(F.col("tps"), P).alias("tpr"))
    start = totals.select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                          F.lit(0.0).alias("tpr"))
    return start.unionByName(curve)


def auc(df: DataFrame, label: str = "label", score: str = "score", pos_label=1,
        buckets: int | None = None) -> DataFrame:
    """ML9: area under the ROC curve by the trapezoid rule, one row ``(auc)``.

    Equal to the Mann-Whitney statistic: each distinct score adds its negatives
    times the positives ranked above it plus half its own positives.  NULL when
    one class is absent.
    """
    cum = cumulative_by_score(df, label, score, pos_label, buckets)
    area = F.sum(F.col("fp").cast("double") * (F.col("tps") - F.col("tp") / 2.0))
    return cum.agg(F.try_divide(area, F.sum("tp").cast("double") * F.sum("fp").cast("double")).alias("auc"))
