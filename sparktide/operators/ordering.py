"""Positions and neighbours in a total order, without moving a whole order into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, where keys are spread evenly.
WIDTH = 65_536


def dense_index(df: DataFrame, key: str, by: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """Adds idx: the position (from 0) by a unique integer key, within the columns `by`.

    The span from the least to the greatest key of a group is cut into as many equal ranges as it has times `width` rows, so that counters and hashes alike fill ranges of about that many; ranges are
    counted, the counts summed up over the ranges, and rows numbered within their range. Only the counts, one row for each range, meet in one place.
    """
    by = by or []
    at = F.col(key).cast("double")
    spans = df.groupBy(*by).agg(F.min(at).alias("__low"), F.max(at).alias("__high"), F.ceil(F.count("*") / width).alias("__ranges"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    joined = df.alias("l").join(spans.alias("s"), reduce(Column.__and__, same), "inner") if by else df.alias("l").crossJoin(F.broadcast(spans.alias("s")))
    share = F.coalesce(F.try_divide(at - F.col("__low"), F.col("__high") - F.col("__low")), F.lit(0.0))
    cut = joined.withColumn("__range", F.least(F.floor(share * F.col("__ranges")), F.col("__ranges") - 1)).select("l.*", "__range")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*by, "__range").agg(F.count("*").alias("__n")).select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    numbered = cut.withColumn("__row", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(key)))
    return numbered.join(sizes, [*by, "__range"]).withColumn("idx", F.col("__base") + F.col("__row") - 1).drop("__range", "__base", "__row")


def centred_mean(df: DataFrame, value: str, half: int, by: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """Adds mean: the average of value over [idx - half, idx + half], clipped at the ends of idx, within the columns `by`.

    Rows near the edge of a block of `width` positions are copied to the neighbouring block, so that every block is a group of its own.
    """
    by = by or []
    width = max(width, 2 * half + 1)
    block = F.floor(F.col("idx") / width)
    sides = F.array_distinct(F.array(block, F.floor((F.col("idx") - half) / width), F.floor((F.col("idx") + half) / width)))
    spread = df.withColumn("__home", block).withColumn("__block", F.explode(sides))
    frame = Window.partitionBy(*by, "__block").orderBy("idx").rowsBetween(-half, half)
    return spread.withColumn("mean", F.avg(F.col(value).cast("double")).over(frame)).where("__home = __block").drop("__home", "__block")
