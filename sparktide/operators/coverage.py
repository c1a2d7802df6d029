"""Channel coverage, modal values and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Channels up to which they are broadcast.
FEW = 100_000


def channel_coverage(held: DataFrame, unit: list[str], channel: str) -> DataFrame:
    """(channel, n, missing, in_all, nearly) of distinct rows held(unit, channel): units with it, without it, whether it is in all, and in all but one or two."""
    units = held.select(*unit).distinct().agg(F.count("*").alias("units"))
    counts = held.groupBy(channel).agg(F.count("*").alias("n")).crossJoin(F.broadcast(units))
    return counts.select(channel, "n", (F.col("units") - F.col("n")).alias("missing"), (F.col("n") == F.col("units")).alias("in_all"), ((F.col("n") >= F.col("units") - 2) & (F.col("n") < F.col("units"))).alias("nearly"))


def by_count(coverage: DataFrame, channel: str) -> DataFrame:
    """Adds place: channels from the most frequent to the rarest, by name where equal; the one order runs over channels, not rows."""
    return coverage.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), channel)))


def missing_channels(held: DataFrame, unit: list[str], channel: str, few: int = FEW) -> DataFrame:
    """(unit, channel) of the channels known anywhere that a unit lacks; the channels are broadcast if they are at most `few`."""
    known = held.select(channel).distinct()
    every = F.broadcast(known) if known.limit(few + 1).count() <= few else known
    return held.select(*unit).distinct().crossJoin(every).join(held, [*unit, channel], "left_anti")


def modal(rows: DataFrame, value: str, first: str) -> DataFrame:
    """(value, n, modal): counts of the values; the most frequent one is modal, the one seen first among equals."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(first).alias("__seen"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "__seen"))  # one row for each distinct value
    return counts.select(value, "n", (rank == 1).alias("modal"))


def only_valid(rows: DataFrame, valid: DataFrame | None, key: str) -> DataFrame:
    """Rows of valid keys; no table means no filter."""
    return rows if valid is None else rows.join(valid.select(key), key, "left_semi")


def dead_letters(rows: DataFrame, other: DataFrame, key: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a partner in other, and (row, reason) of those without."""
    joined = rows.join(other.withColumn("__there", F.lit(True)), key, "left")
    return joined.where("__there").drop("__there"), joined.where("__there IS NULL").select(*rows.columns).withColumn("reason", F.lit(reason))
