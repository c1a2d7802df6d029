"""Segmentation into windows, and the algebra of intervals.

Times are whole numbers of one unit (samples, seconds or microseconds). Keys are column names; each operator works
within a key and shuffles on it at most once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hop_starts(recordings: DataFrame, length: str, window: int, stride: int) -> DataFrame:
    """One row for each start 0, stride, ... whose window ends within the recording; the columns of recordings stay."""
    fits = recordings.where(F.col(length) >= window)
    return fits.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - window, F.lit(stride).cast("long"))))


def label_by_overlap(windows: DataFrame, intervals: DataFrame, keys: list[str], window: int, stride: int) -> DataFrame:
    """label 1 for windows (start, start + window) that overlap an interval (begin, end) of their key, both sides strict, else 0.

    Windows start at multiples of stride, so each interval names the few starts it overlaps: the join is by
    equality and no interval meets windows it does not overlap.
    """
    first = F.greatest(F.lit(0).cast("long"), (F.floor((F.col("begin") - window) / stride) + 1) * stride)
    last = (F.ceil(F.col("end") / stride) - 1) * stride
    hit = intervals.where("begin < end").select(*keys, first.alias("__a"), last.alias("__b")).where("__b >= __a")
    hit = hit.select(*keys, F.explode(F.sequence("__a", "__b", F.lit(stride).cast("long"))).alias("start")).distinct().withColumn("__hit", F.lit(1))
    return windows.join(hit, [*keys, "start"], "left").withColumn("label", F.coalesce("__hit", F.lit(0))).drop("__hit")


def gaps(intervals: DataFrame, recordings: DataFrame, keys: list[str], length: str, least: int, width: int | None = None) -> DataFrame:
    """(keys, begin, end): what intervals(begin, end) leave of [0, length), where at least `least` long.

    The gap before an interval starts at the largest end so far; recordings without intervals are one gap. The largest end
    runs within ranges of `width` (1,000 times least unless given) of begin and over the ranges' largest ends, so a key with very many intervals fills many tasks.
    """
    cut = intervals.withColumn("__range", F.floor(F.col("begin") / (width or 1000 * least)))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(*keys, "__range").agg(F.max("end").alias("__top")).select(*keys, "__range", F.coalesce(F.max("__top").over(earlier), F.lit(0).cast("long")).alias("__before"))
    order = Window.partitionBy(*keys, "__range").orderBy("begin", "end")
    within = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = cut.withColumn("__within", within).join(tops, [*keys, "__range"]).select(*keys, F.greatest("__within", "__before").alias("g"), F.col("begin").alias("h"))
    ends = intervals.groupBy(*keys).agg(F.max("end").alias("__end"))
    tail = recordings.join(ends, keys, "left").select(*keys, F.coalesce("__end", F.lit(0).cast("long")).alias("g"), F.col(length).cast("long").alias("h"))
    return before.union(tail).where(F.col("h") - F.col("g") >= least).select(*keys, F.col("g").alias("begin"), F.col("h").alias("end"))


def windows_per_interval(window: int, stride: int):
    """Column: windows that fit into an interval (begin, end)."""
    size = F.col("end") - F.col("begin")
    return F.when(size >= window, 1 + F.floor((size - window) / stride)).otherwise(0).cast("long")


def windows_in_intervals(intervals: DataFrame, window: int, stride: int) -> DataFrame:
    """Windows that start anew at each interval's begin."""
    fits = intervals.where(F.col("end") - F.col("begin") >= window)
    return fits.withColumn("start", F.explode(F.sequence("begin", F.col("end") - window, F.lit(stride).cast("long"))))


def subject_rates(positive: DataFrame, negative: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Windows by floor(duration / window) of either kind of interval, and the share of positive ones; each interval counts once."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.floor((F.col("end") - F.col("begin")) / window).cast("long").alias("__n"), F.lit(name).alias("__kind"))

    both = count(positive, "p").union(count(negative, "n")).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("__kind") == "p", F.col("__n"))), F.lit(0)).alias("n_positive"), F.coalesce(F.sum(F.when(F.col("__kind") == "n", F.col("__n"))), F.lit(0)).alias("n_negative")
    )
    return both.withColumn("rate", F.coalesce(F.try_divide("n_positive", F.col("n_positive") + F.col("n_negative")), F.lit(0.0)))


def event_time_hops(events: DataFrame, keys: list[str], time: str, window: str, stride: str) -> DataFrame:
    """Counts of events in hopping windows that lie within the key's first and last event."""
    span = events.groupBy(*keys).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    hops = events.groupBy(*keys, F.window(time, window, stride).alias("w")).agg(F.count("*").alias("n")).join(span, keys)
    return hops.where("w.start >= __lo AND w.end <= __hi").select(*keys, F.col("w.start").alias("start"), "n")
