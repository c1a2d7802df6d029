"""Temporal smoothing of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.operators.ordering import WIDTH, centred_mean, dense_index


def smooth(predictions: DataFrame, key: str, pred: str, size: int = 5, threshold: float = 0.5, by: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """Adds smoothed: 1 where the centred mean of size // 2 rows to either side, in the order of an integer key, is at least threshold."""
    indexed = dense_index(predictions, key, by, width)
    out = centred_mean(indexed, pred, size // 2, by, width)
    return out.withColumn("smoothed", (F.col("mean") >= threshold).cast("int")).drop("mean", "idx")


def changed(pred: str, smoothed: str = "smoothed"):
    return F.count_if(F.col(pred) != F.col(smoothed)).cast("long")
