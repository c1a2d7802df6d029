"""Forests over statistics of intervals: random, supervised and canonical intervals, and trees grown from histograms that the executors add up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows that a task looks at together.
STEP_ROWS = 512
#: Ranges of equal width between a feature's least and largest value: their edges are the thresholds that a node may choose.
BINS = 20
SHORTEST = 3


def _slope(v: np.ndarray) -> np.ndarray:
    at = np.arange(v.shape[1]) - (v.shape[1] - 1) / 2
    return v @ at / max(float(at @ at), 1e-12)


def _crossings(v: np.ndarray) -> np.ndarray:
    above = v > v.mean(axis=1, keepdims=True)
    return (above[:, 1:] != above[:, :-1]).sum(axis=1).astype(float)


def _longest_above(v: np.ndarray) -> np.ndarray:
    above, run, best = v > v.mean(axis=1, keepdims=True), np.zeros(len(v)), np.zeros(len(v))
    for t in range(v.shape[1]):
        run = np.where(above[:, t], run + 1, 0)
        best = np.maximum(best, run)
    return best


def _autocorrelation(v: np.ndarray) -> np.ndarray:
    c = v - v.mean(axis=1, keepdims=True)
    whole = (c * c).sum(axis=1)
    return np.divide((c[:, 1:] * c[:, :-1]).sum(axis=1), whole, out=np.zeros(len(v)), where=whole > 1e-12)


STATISTICS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "mean": lambda v: v.mean(axis=1),
    "std": lambda v: v.std(axis=1),
    "slope": _slope,
    "median": lambda v: np.median(v, axis=1),
    "iqr": lambda v: np.subtract(*np.percentile(v, [75, 25], axis=1)),
    "min": lambda v: v.min(axis=1),
    "max": lambda v: v.max(axis=1),
    "crossings": _crossings,
    "longest_above": _longest_above,
    "autocorrelation": _autocorrelation,
    "step": lambda v: np.abs(np.diff(v, axis=1)).mean(axis=1) if v.shape[1] > 1 else np.zeros(len(v)),
}
SIMPLE = ("mean", "std", "slope")
SUPERVISED = ("mean", "std", "slope", "median", "iqr", "min", "max")

#: What a statistic looks at: the values, their differences, or the squared spectrum without its first term.
VIEWS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "values": lambda s: s,
    "differences": lambda s: np.diff(s, axis=1),
    "spectrum": lambda s: np.abs(np.fft.rfft(s, axis=1))[:, 1:] ** 2,
}


@dataclass(frozen=True)
class Feature:
    """A statistic over [first, first + length) of a view of one channel, or of the channels' average (-1)."""

    view: str
    channel: int
    first: int
    length: int
    statistic: str


def values(x: np.ndarray, features: list[Feature]) -> np.ndarray:
    """(windows, features) for windows of (windows, channels, time)."""
    out, seen = np.empty((len(x), len(features))), {}
    for k, f in enumerate(features):
        if (f.view, f.channel) not in seen:
            seen[f.view, f.channel] = VIEWS[f.view](x.mean(axis=1) if f.channel < 0 else x[:, f.channel])
        out[:, k] = STATISTICS[f.statistic](seen[f.view, f.channel][:, f.first : f.first + f.length])
    return out


def _view_length(view: str, samples: int) -> int:
    return {"values": samples, "differences": samples - 1, "spectrum": samples // 2}[view]


def _random_interval(rng: np.random.Generator, n: int) -> tuple[int, int]:
    length = int(rng.integers(min(SHORTEST, n), n + 1))
    return int(rng.integers(0, n - length + 1)), length


def random_intervals(trees: int, samples: int, seed: int = 42) -> list[list[Feature]]:
    """For each tree about sqrt(samples) random intervals of the channels' average, each with mean, deviation and slope."""
    rng = np.random.default_rng(seed)
    return [[Feature("values", -1, *at, s) for _ in range(max(1, round(samples**0.5))) for at in [_random_interval(rng, samples)] for s in SIMPLE] for _ in range(trees)]


def canonical_intervals(trees: int, channels: int, samples: int, views: tuple[str, ...] = ("values",), statistics: int = 6, seed: int = 42) -> list[list[Feature]]:
    """For each tree a random choice of the statistics over about sqrt(samples) random intervals of random channels and of each view in turn."""
    rng, out = np.random.default_rng(seed), []
    usable = [v for v in views if _view_length(v, samples) > 0]
    for _ in range(trees):
        chosen = rng.permutation(list(STATISTICS))[:statistics]
        tree = []
        for k in range(max(1, round(samples**0.5)) * len(usable)):
            view = usable[k % len(usable)]
            at, channel = _random_interval(rng, _view_length(view, samples)), int(rng.integers(channels))
            tree += [Feature(view, channel, *at, str(s)) for s in chosen]
        out.append(tree)
    return out


def _matrix(column: pa.Array, channels: int):
    for first in range(0, len(column), STEP_ROWS):
        part = column.slice(first, STEP_ROWS)
        yield first, part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), channels, -1)


def separation(rows: DataFrame, features: list[Feature], channels: int) -> np.ndarray:
    """For rows(v, y) the squared gap between the classes' means of each feature over the sum of their variances, by sums that the executors add up; 0 where a class is missing."""

    def run(batches):
        total = np.zeros((2, 3, len(features)))
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for first, x in _matrix(batch.column("v"), channels):
                f = values(x, features)
                for c in (0, 1):
                    own = f[y[first : first + len(x)] == c]
                    total[c] += np.stack([np.full(len(features), float(len(own))), own.sum(axis=0), (own * own).sum(axis=0)])
        yield pa.record_batch([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "value"])

    got = rows.select("v", "y").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(2 * 3 * len(features))
    total[got.column("at").to_numpy()] = got.column("value").to_numpy()
    n, s, q = total.reshape(2, 3, -1).transpose(1, 0, 2)
    mean = s / np.maximum(n, 1)
    spread = np.maximum(q / np.maximum(n, 1) - mean**2, 0).sum(axis=0)
    return np.where((n > 0).all(axis=0), (mean[0] - mean[1]) ** 2 / np.maximum(spread, 1e-12), 0.0)


def supervised_intervals(rows: DataFrame, trees: int, channels: int, samples: int, seed: int = 42) -> list[list[Feature]]:
    """For each tree intervals chosen by class separation on rows(v, y): each view and statistic of one random channel starts with the whole window, cuts it at a random place and goes on with
    the half that separates the classes better, which becomes a feature, until it is too short. All trees' cuts of one level are judged by one job."""
    rng = np.random.default_rng(seed)
    usable = [v for v in VIEWS if _view_length(v, samples) >= 2 * SHORTEST]
    open_ = [(tree, Feature(view, channel, 0, _view_length(view, samples), s)) for tree in range(trees) for view in usable for channel in [int(rng.integers(channels))] for s in SUPERVISED]
    out: list[list[Feature]] = [[] for _ in range(trees)]
    while open_:
        halves = []
        for tree, f in open_:
            cut = int(rng.integers(SHORTEST, f.length - SHORTEST + 1))
            halves.append((tree, Feature(f.view, f.channel, f.first, cut, f.statistic), Feature(f.view, f.channel, f.first + cut, f.length - cut, f.statistic)))
        judged = separation(rows, [f for _, a, b in halves for f in (a, b)], channels).reshape(-1, 2)
        better = [(tree, (a, b)[int(right > left)]) for (tree, a, b), (left, right) in zip(halves, judged, strict=True)]
        for tree, f in better:
            out[tree].append(f)
        open_ = [(tree, f) for tree, f in better if f.length >= 2 * SHORTEST]
    whole = Feature("values", 0, 0, samples, "mean")
    return [t or [whole] for t in out]


@dataclass
class Tree:
    """Nodes by number (children of k: 2k + 1 and 2k + 2): the feature's place and the bin up to which rows go left; leaves have the chance of class 1."""

    splits: dict[int, tuple[int, int]]
    leaves: dict[int, float]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins (rows, features) comes to, as far as the tree is grown."""
        at = np.zeros(len(bins), np.int64)
        for node in sorted(self.splits):
            place, cut = self.splits[node]
            own = np.flatnonzero(at == node)
            at[own] = 2 * node + 1 + (bins[own, place] > cut)
        return at


def _entropy(n: np.ndarray) -> np.ndarray:
    """For counts (..., 2) the entropy times the count."""
    total = n.sum(axis=-1, keepdims=True)
    share = np.divide(n, total, out=np.zeros_like(n, dtype=float), where=total > 0)
    return -(np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0)).sum(axis=-1) * total[..., 0]


def best_split(histogram: np.ndarray) -> tuple[int, int] | None:
    """(feature, bin) of the largest gain of entropy of a node's counts (features, bins, 2), the first of equals; None without a gain."""
    left = histogram.cumsum(axis=1)[:, :-1]
    whole = histogram[:1].sum(axis=1)[0]
    gain = _entropy(whole.astype(float)) - _entropy(left) - _entropy(whole - left)
    at = int(np.round(gain, 9).argmax())
    place, cut = divmod(at, gain.shape[1])
    return (place, cut) if gain[place, cut] > 1e-9 else None


class IntervalForest:
    """Trees with features of their own, and the ranges by which these are cut into bins."""

    def __init__(self, specs: list[list[Feature]], channels: int, low: np.ndarray, high: np.ndarray, trees: list[Tree]):
        self.specs, self.channels, self.low, self.high, self.trees = specs, channels, low, high, trees
        self.features = [f for spec in specs for f in spec]
        self.starts = np.cumsum([0, *[len(s) for s in specs]])

    def bins(self, x: np.ndarray) -> np.ndarray:
        width = np.where(self.high > self.low, self.high - self.low, 1.0)
        return np.clip(np.floor((values(x, self.features) - self.low) / width * BINS), 0, BINS - 1).astype(np.uint8)

    def chances(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for k, tree in enumerate(self.trees):
            at = tree.nodes(bins[:, self.starts[k] : self.starts[k + 1]])
            out += np.array([tree.leaves[n] for n in at.tolist()])
        return out / max(len(self.trees), 1)

    def score(self, rows: DataFrame, flat: str) -> DataFrame:
        """Adds proba, the mean of the trees' chances, and pred (1 from one half on)."""
        model = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def run(column: pd.Series) -> pd.Series:
            forest = model.value
            out = [forest.chances(forest.bins(x)) for _, x in _matrix(pa.array(column.tolist(), pa.list_(pa.float64())), forest.channels)]
            return pd.Series(np.concatenate(out) if out else [])

        return rows.withColumn("proba", run(flat)).withColumn("pred", (F.col("proba") >= 0.5).cast("int"))


def labelled(rows: DataFrame, flat: str, label: str) -> DataFrame:
    """rows(v, y) with both."""
    return rows.select(F.col(flat).cast("array<double>").alias("v"), F.col(label).cast("int").alias("y")).where("v IS NOT NULL AND y IS NOT NULL")


def grow_forest(rows: DataFrame, specs: list[list[Feature]], channels: int, depth: int = 5, least: int = 2) -> IntervalForest:
    """Trees for rows(v flat channel-major array, y 0 or 1), all grown together, one level a job.

    One job finds the features' ranges, one cuts all features into bins, a byte each; a level then counts rows by tree, node, feature, bin and class, the executors add the counts up, and the
    driver picks each node's split. A node with fewer than `least` rows, of one class or without a gain is a leaf. No rows raise ValueError.
    """
    forest = IntervalForest(specs, channels, np.empty(0), np.empty(0), [Tree({}, {}) for _ in specs])
    features = forest.features

    def ranges(batches):
        low, high = np.full(len(features), np.inf), np.full(len(features), -np.inf)
        for batch in batches:
            for _, x in _matrix(batch.column("v"), channels):
                f = values(x, features)
                low, high = np.minimum(low, f.min(axis=0)), np.maximum(high, f.max(axis=0))
        yield pa.record_batch([pa.array(np.arange(len(features)), pa.int32()), pa.array(low), pa.array(high)], names=["at", "low", "high"])

    got = rows.select("v").mapInArrow(ranges, "at int, low double, high double").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").toArrow()
    forest.low, forest.high = got.column("low").to_numpy(), got.column("high").to_numpy()
    if not len(forest.low) or not np.isfinite(forest.low).all():
        raise ValueError("no rows to learn from")

    def cut(batches):
        for batch in batches:
            for first, x in _matrix(batch.column("v"), channels):
                yield pa.record_batch([pa.array([b.tobytes() for b in forest.bins(x)], pa.binary()), batch.column("y").slice(first, len(x))], names=["bins", "y"])

    binned = rows.select("v", "y").mapInArrow(cut, "bins binary, y int").persist()
    open_ = [{0} for _ in specs]
    starts = forest.starts
    for level in range(depth + 1):
        base, size = {}, 0
        for k, nodes in enumerate(open_):
            for node in sorted(nodes):
                base[k, node] = size
                size += (starts[k + 1] - starts[k]) * BINS * 2
        if not base:
            break

        def count(batches, base=base, size=size):
            total = np.zeros(size, np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(batch), -1).astype(np.int64)
                y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
                for k, tree in enumerate(forest.trees):
                    part = bins[:, starts[k] : starts[k + 1]]
                    at = tree.nodes(part)
                    for node in np.unique(at):
                        if (k, int(node)) in base:
                            own, width = at == node, part.shape[1]
                            flat = (np.arange(width) * BINS + part[own]) * 2 + y[own][:, None]
                            total[base[k, int(node)] :][: width * BINS * 2] += np.bincount(flat.ravel(), minlength=width * BINS * 2)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "n"])

        got = binned.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(size, np.int64)
        total[got.column("at").to_numpy()] = got.column("n").to_numpy()
        grown: list[set[int]] = [set() for _ in specs]
        for (k, node), first in base.items():
            histogram = total[first : first + (starts[k + 1] - starts[k]) * BINS * 2].reshape(-1, BINS, 2)
            n = histogram[0].sum(axis=0)
            split = best_split(histogram) if level < depth and n.sum() >= least and n.min() > 0 else None
            if split:
                forest.trees[k].splits[node] = split
                grown[k] |= {2 * node + 1, 2 * node + 2}
            else:
                forest.trees[k].leaves[node] = float(n[1] / max(n.sum(), 1))
        open_ = grown
    binned.unpersist()
    return forest
