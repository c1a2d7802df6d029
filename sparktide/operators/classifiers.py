"""Threshold and logistic classifiers."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9


def class_medians(rows: DataFrame, feature: str, label: str, bins: int = 4096) -> DataFrame:
    """(m0, m1, ascending): ascending if the positive class lies higher; equal or missing medians count as descending.

    A first pass counts the values of each class in even bins, a second one ranks the distinct values of the bin that holds the middle, so
    that no task sees all values. Nulls are left out; of an even number of values the middle two are averaged; no rows give nulls.
    """
    own = rows.select(F.col(label).alias("y"), F.col(feature).cast("double").alias("x")).where("x IS NOT NULL AND y IN (0, 1)")
    edges = own.groupBy("y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    part = F.coalesce(F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)), F.lit(0))
    binned = own.join(F.broadcast(edges), "y").select("y", "x", "n", part.alias("bin"))
    before = Window.partitionBy("y").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy("y", "n", "bin").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    middle = F.posexplode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("side", "k")
    wanted = counts.select("y", "bin", "before", "count", middle).where("k >= before AND k < before + count").drop("count")  # four rows
    inside = binned.join(F.broadcast(wanted), ["y", "bin"]).groupBy("y", "side", "k", "before", "x").count()
    upto = F.col("before") + F.sum("count").over(Window.partitionBy("y", "side").orderBy("x"))
    found = inside.withColumn("upto", upto).where("k < upto AND k >= upto - count")
    medians = found.agg(*[F.avg(F.when(F.col("y") == c, F.col("x"))).alias(f"m{c}") for c in (0, 1)])
    return medians.withColumn("ascending", F.coalesce(F.col("m0") < F.col("m1"), F.lit(False)))


def positive(feature: Column, threshold: Column, ascending: Column) -> Column:
    """1 strictly beyond the threshold on the positive side."""
    return F.when(ascending, feature > threshold).otherwise(feature < threshold).cast("int")


def score_expression(metric: str = "f1", weight: float | None = None) -> Column:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, sensitivity, specificity = tp / (tp + fp + EPS), tp / (tp + fn + EPS), tn / (tn + fp + EPS)
    if metric == "youden":
        return sensitivity + specificity - 1 if weight is None else weight * sensitivity + (1 - weight) * specificity
    if metric != "f1":
        raise ValueError(f"unknown metric {metric}")
    f1 = 2 * precision * sensitivity / (precision + sensitivity + EPS)
    return f1 if weight is None else f1 + weight * sensitivity * 0.01


def _grid_point(i: Column, points: int) -> Column:
    lo, hi = F.col("lo"), F.col("hi")
    return F.when(i == points - 1, hi).otherwise(lo + i * ((hi - lo) / (points - 1)))


def threshold_counts(rows: DataFrame, feature: str, label: str, medians: DataFrame, points: int = 100) -> DataFrame:
    """(i, thr, tp, fp, fn, tn) at each of `points` even steps from the smallest to the largest feature, both exact.

    Each row finds its own place among the steps, once; places are counted by class, and the counts, a few hundred rows, meet the steps.
    """
    edges = rows.agg(F.min(feature).cast("double").alias("lo"), F.max(feature).cast("double").alias("hi")).where("lo IS NOT NULL").crossJoin(medians)
    x, up = F.col(feature).cast("double"), F.col("ascending")
    first = F.greatest(F.floor(F.coalesce(F.try_divide(x - F.col("lo"), (F.col("hi") - F.col("lo")) / (points - 1)), F.lit(0.0))).cast("int") - 1, F.lit(0))
    below = lambda i: ((i < points) & F.when(up, _grid_point(i, points) < x).otherwise(_grid_point(i, points) <= x)).cast("int")
    place = F.when(F.col("lo") == F.col("hi"), F.when(up, 0).otherwise(points)).otherwise(first + below(first) + below(first + 1) + below(first + 2))
    held = rows.where(F.col(feature).isNotNull()).select(feature, F.col(label).alias("y")).crossJoin(F.broadcast(edges))
    counts = held.groupBy(place.alias("place"), "y").count()  # place: the steps below the value, or at or below it where smaller values are positive
    steps = edges.select("lo", "hi", "ascending", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    p = F.when(F.col("ascending"), F.col("i") < F.col("place")).otherwise(F.col("i") >= F.col("place"))
    tally = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0))
    return steps.crossJoin(F.broadcast(counts)).groupBy("i", _grid_point(F.col("i"), points).alias("thr")).agg(
        tally(p & (F.col("y") == 1)).alias("tp"), tally(p & (F.col("y") == 0)).alias("fp"), tally(~p & (F.col("y") == 1)).alias("fn"), tally(~p & (F.col("y") == 0)).alias("tn")
    )


def best_threshold(counts: DataFrame, metric: str = "f1", weight: float | None = None) -> DataFrame:
    """(i, thr, score): the first grid point among those of the best score."""
    return counts.select("i", "thr", score_expression(metric, weight).alias("score")).orderBy(F.desc("score"), "i").limit(1)


def fit_threshold(rows: DataFrame, feature: str, label: str, points: int = 100, metric: str = "f1", weight: float | None = None) -> DataFrame:
    """The model as one row: m0, m1, ascending, i, thr, score."""
    medians = class_medians(rows, feature, label)
    return medians.crossJoin(best_threshold(threshold_counts(rows, feature, label, medians, points), metric, weight))


def predict_threshold(rows: DataFrame, feature: str, model: DataFrame) -> DataFrame:
    """Adds pred and proba: the share of the distance to the medians that lies at class 0's side."""
    d0, d1 = F.abs(F.col(feature) - F.col("m0")), F.abs(F.col(feature) - F.col("m1"))
    out = rows.crossJoin(F.broadcast(model.select("m0", "m1", "ascending", "thr")))
    return out.withColumn("pred", positive(F.col(feature), F.col("thr"), F.col("ascending"))).withColumn("proba", d0 / (d0 + d1 + 1e-10)).drop("m0", "m1", "ascending", "thr")


def scaled(rows: DataFrame, features: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Features less their mean, over their population deviation, both of the rows fitted_on (these rows if None); a deviation of zero counts as one."""
    own = rows if fitted_on is None else fitted_on
    stats = own.agg(*[F.avg(f).alias(f"__m_{f}") for f in features], *[F.stddev_pop(f).alias(f"__s_{f}") for f in features])
    out = rows.crossJoin(F.broadcast(stats))
    for f in features:
        sd = F.when(F.col(f"__s_{f}") == 0, 1.0).otherwise(F.col(f"__s_{f}"))
        out = out.withColumn(f, (F.col(f) - F.col(f"__m_{f}")) / sd)
    return out.select(*rows.columns)


def logistic(train: DataFrame, features: list[str], label: str, weight: str, c: float = 1.0):
    """An L2 logistic model on scaled features; c is the inverse strength, as a sum over weighted rows."""
    total = train.agg(F.sum(weight)).first()[0] or 1.0
    stages = [VectorAssembler(inputCols=features, outputCol="features"), LogisticRegression(labelCol=label, weightCol=weight, regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8)]
    return Pipeline(stages=stages).fit(train)


def positive_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("proba", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
