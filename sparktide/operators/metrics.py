"""Metrics of binary predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are cut into this many ranges a unit when they are summed up in order.
RANGES = 4096


def or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    y_, p = F.col(y), F.col(pred)
    return df.groupBy(*(by or [])).agg(
        F.count_if((p == 1) & (y_ == 1)).alias("tp"), F.count_if((p == 1) & (y_ == 0)).alias("fp"),
        F.count_if((p == 0) & (y_ == 1)).alias("fn"), F.count_if((p == 0) & (y_ == 0)).alias("tn"),
    )


def classification(counts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of either class, sensitivity and specificity; an empty denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *(keep or []), "tp", "fp", "fn", "tn", or_zero(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        or_zero(tp, tp + fp).alias("precision_1"), or_zero(tp, tp + fn).alias("recall_1"), or_zero(2 * tp, 2 * tp + fp + fn).alias("f1_1"),
        or_zero(tn, tn + fn).alias("precision_0"), or_zero(tn, tn + fp).alias("recall_0"), or_zero(2 * tn, 2 * tn + fp + fn).alias("f1_0"),
        or_zero(tp, tp + fn).alias("sensitivity"), or_zero(tn, tn + fp).alias("specificity"),
    )


def curve(df: DataFrame, y: str, score: str, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """(by, score, p, n, tp, fp, positives, negatives): each distinct score as a threshold, with the sums at or above it.

    Rows are first added up by score. The sums over falling scores run within ranges of scores and over the
    ranges' totals, so that no task takes all scores.
    """
    by = by or []
    at = df.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n")).withColumn("__range", F.floor(F.col("score") * ranges))
    above = Window.partitionBy(*by).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*by)
    totals = at.groupBy(*by, "__range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn")).select(
        *by, "__range", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("__tp"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("__fp"),
        F.sum("rp").over(all_).alias("positives"), F.sum("rn").over(all_).alias("negatives"),
    )
    within = Window.partitionBy(*by, "__range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = at.select(*by, "score", "p", "n", "__range", F.sum("p").over(within).alias("tp"), F.sum("n").over(within).alias("fp"))
    return sums.join(totals, [*by, "__range"]).select(*by, "score", "p", "n", (F.col("tp") + F.col("__tp")).alias("tp"), (F.col("fp") + F.col("__fp")).alias("fp"), "positives", "negatives")


def ranking(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """roc_auc by ranks with ties halved, and average precision by steps; null where a class is missing."""
    area = F.sum(F.col("n") * ((F.col("tp") - F.col("p")) + F.col("p") / 2.0))
    steps = F.sum(F.try_divide(F.col("p").cast("double"), F.col("positives")) * F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")))
    both = F.max(F.col("positives") * F.col("negatives"))
    return points.groupBy(*(by or [])).agg(F.try_divide(area, both).alias("roc_auc"), F.when(both > 0, steps).alias("average_precision"))


def roc_points(points: DataFrame) -> DataFrame:
    return points.select("score", F.try_divide(F.col("fp").cast("double"), F.col("negatives")).alias("fpr"), F.try_divide(F.col("tp").cast("double"), F.col("positives")).alias("tpr"))


def precision_recall_points(points: DataFrame) -> DataFrame:
    tp, fp = F.col("tp").cast("double"), F.col("fp")
    f1 = or_zero(2 * tp, tp + fp + F.col("positives"))
    return points.select("score", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, F.col("positives")).alias("recall"), f1.alias("f1"), F.try_divide(F.col("positives").cast("double"), F.col("positives") + F.col("negatives")).alias("prevalence"))


def trapezoid(points: DataFrame) -> DataFrame:
    """Area under the precision-recall points by trapezoids from recall 0 and precision 1, which differs from average precision.

    Each threshold's trapezoid needs the sums above it alone: tp - p and fp - n.
    """
    tp, fp, p, n = (F.col(c).cast("double") for c in ("tp", "fp", "p", "n"))
    before = F.when(tp + fp - p - n > 0, F.try_divide(tp - p, tp + fp - p - n)).otherwise(1.0)
    return points.agg(F.sum(F.try_divide(p, F.col("positives")) * (F.try_divide(tp, tp + fp) + before) / 2).alias("pr_area"))


def best_f1(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The threshold of greatest F1, the lowest of equals; 0.5 where nothing is positive."""
    by = by or []
    pr = points.withColumn("f1", or_zero(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")))
    top = pr.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("score")).alias("low"))).alias("top"), F.max("positives").alias("any"))
    return top.select(*by, F.when(F.col("any") > 0, -F.col("top.low")).otherwise(0.5).alias("threshold"), F.col("top.f1").alias("f1"))


def by_subject(df: DataFrame, subject: str, y: str, pred: str, score: str | None, how: str = "majority") -> DataFrame:
    """(subject, y, pred, score) of each subject: labels by majority, ties going to 0; predictions by majority, or by the mean or largest score at 0.5."""
    majority = lambda c: (2 * F.sum(c) > F.count("*")).cast("int")
    base = [majority(y).alias("y"), majority(pred).alias("voted")]
    if how in ("mean_proba", "max_proba") and score:
        value = F.avg(score) if how == "mean_proba" else F.max(score)
        return df.groupBy(subject).agg(*base, value.alias("score")).withColumn("pred", (F.col("score") >= 0.5).cast("int")).drop("voted")
    return df.groupBy(subject).agg(*base).withColumnRenamed("voted", "pred")
