"""Clock strings, elapsed time and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def clock_seconds(text: Column, drop_spaces: bool = True) -> Column:
    """Seconds of the first HH.MM.SS in the text, else of the first HH:MM.SS, else null; parts aren't range-checked."""
    text = F.regexp_replace(text, " ", "") if drop_spaces else text

    def seconds(pattern: str) -> Column:
        h, m, s = (F.regexp_extract(text, pattern, k).try_cast("int") for k in (1, 2, 3))
        return h * 3600 + m * 60 + s

    return F.coalesce(seconds(r"(\d{1,2})\.(\d{1,2})\.(\d{1,2})"), seconds(r"(\d{1,2}):(\d{1,2})\.(\d{1,2})"))


def wrapped_difference(later: Column, earlier: Column, day: int = DAY) -> Column:
    """later - earlier, one day more if that is negative; a difference above a day is kept."""
    return F.when(later - earlier >= 0, later - earlier).otherwise(later - earlier + day)


def to_samples(seconds: Column, rate: float) -> Column:
    """Samples of a time, halves rounded to even."""
    return F.bround(seconds * F.lit(float(rate)), 0).cast("long")


def rate_hz(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]+)\s*Hz", 1).try_cast("double")


def after_colon(text: Column) -> Column:
    return F.trim(F.get(F.split(text, ":", 2), 1))
