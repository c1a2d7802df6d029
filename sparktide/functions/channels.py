"""Channel names and channel-major signal arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalised_name(name: Column) -> Column:
    """Upper case without the prefix 'EEG ' and blanks at the ends."""
    return F.upper(F.trim(F.replace(F.replace(name, F.lit("EEG "), F.lit("")), F.lit("eeg "), F.lit(""))))


def has_all(names: Column, required) -> Column:
    """Whether the array holds every required name."""
    return F.size(F.array_except(_strings(required), names)) == 0


def reordered(entries: Column, order) -> Column:
    """Values of array<struct<key, value>> in the wanted order, null where a key is missing; the last of equal keys counts."""
    newest = F.reverse(entries)
    return F.transform(_strings(order), lambda k: F.get(F.filter(newest, lambda e: e["key"] == k), F.lit(0))["value"])


def harmonised(signal: Column, n_channels: int, n_samples: int) -> Column:
    """The first n_channels arrays; missing ones are zeros."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), n_samples)
    return F.slice(F.concat(signal, F.array_repeat(zero, n_channels)), 1, n_channels)


def as_matrix(flat: Column, n_channels: int, n_samples: int) -> Column:
    """A flat array, channel by channel, as an array of channels."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_channels - 1)), lambda c: F.slice(flat, c * n_samples + 1, F.lit(n_samples)))


def transposed(matrix: Column, columns: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.transform(matrix, lambda row: F.get(row, j)))


def window_slice(signal: Column, start: Column, length: int) -> Column:
    """Samples [start, start + length) of every channel, as floats."""
    return F.transform(signal, lambda c: F.slice(c, start + 1, F.lit(length)).cast("array<float>"))


def intersection_in_order(names: Column, kept) -> Column:
    return F.filter(names, lambda x: F.array_contains(_strings(kept), x))
