"""Random convolution kernels over several channels with pooled statistics, and a ridge classifier that chooses its penalty by exact leave-one-out errors."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.operators.splits import draw

LENGTH = 9
#: The 84 kernels of nine weights, three of them 2 and the others -1, by the places of the 2s.
PLACES = tuple(combinations(range(LENGTH), 3))
#: Penalties that the classifier chooses from.
ALPHAS = tuple(np.logspace(-3, 3, 10))
#: Training windows whose convolutions give the biases; windows that a task looks at together.
BIAS_WINDOWS = 64
STEP_ROWS = 256
POOLS = ("share", "mean", "place", "stretch")


@dataclass(frozen=True)
class Kernel:
    """Places of the weights 2, the dilation, the channels whose convolutions are added up, whether the ends are padded, and the biases."""

    places: tuple[int, ...]
    dilation: int
    channels: tuple[int, ...]
    padded: bool
    biases: tuple[float, ...] = ()

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """(windows, times) for windows of (windows, channels, time): -1 times the sum of all nine taps plus 3 times that of the three."""
        s, reach = x[:, list(self.channels)].sum(axis=1), self.dilation * (LENGTH - 1)
        if self.padded:
            s = np.pad(s, ((0, 0), (reach // 2, reach - reach // 2)))
        n = s.shape[1] - reach
        taps = [s[:, k * self.dilation : k * self.dilation + n] for k in range(LENGTH)]
        return 3 * sum(taps[k] for k in self.places) - sum(taps)


def plan_kernels(channels: int, samples: int, features: int = 504, seed: int = 42) -> list[tuple[Kernel, int]]:
    """Kernels with the number of biases of each, about `features` in all: every one of the 84 at dilations spread by powers of two, each over a random choice of channels."""
    rng = np.random.default_rng(seed)
    each = max(1, features // len(PLACES))
    most = np.log2(max(1.0, (samples - 1) / (LENGTH - 1)))
    dilations = np.unique((2 ** np.linspace(0, most, min(each, 32))).astype(int))
    counts = np.full(len(dilations), each // len(dilations)) + (np.arange(len(dilations)) < each % len(dilations))
    out = []
    for k, (dilation, count) in enumerate(zip(dilations.tolist(), counts.tolist(), strict=True)):
        for j, places in enumerate(PLACES):
            chosen = int(2 ** rng.uniform(0, np.log2(min(channels, LENGTH) + 1)))
            picked = tuple(sorted(rng.choice(channels, min(chosen, channels), replace=False).tolist()))
            out.append((Kernel(places, dilation, picked, (j + k) % 2 == 0 or dilation * (LENGTH - 1) >= samples), count))
    return out


def fit_biases(rows: DataFrame, flat: str, key: str, channels: int, plan: list[tuple[Kernel, int]], windows: int = BIAS_WINDOWS, seed: int = 42) -> list[Kernel]:
    """The kernels with biases: evenly spread quantiles of their values over the first `windows` training windows of a random order."""
    picked = rows.where(F.col(flat).isNotNull()).orderBy(draw(seed, key), F.col(key)).select(F.col(flat).cast("array<double>")).limit(windows).collect()
    if not picked:
        raise ValueError("no rows to learn from")
    x = np.array([r[0] for r in picked]).reshape(len(picked), channels, -1)
    golden, at, out = (5**0.5 + 1) / 2, 0, []
    for kernel, count in plan:
        shares = (np.arange(at + 1, at + count + 1) * golden) % 1
        at += count
        biases = tuple(np.quantile(kernel.convolve(x), shares).tolist())
        out.append(Kernel(kernel.places, kernel.dilation, kernel.channels, kernel.padded, biases))
    return out


def pooled(values: np.ndarray, bias: float, pools: tuple[str, ...]) -> list[np.ndarray]:
    """Of the values above the bias: their share; the mean of their excess; their mean place, from 0 to 1 (-1 where there are none); their longest stretch as a share."""
    above = values > bias
    n, count = values.shape[1], above.sum(axis=1)
    out = []
    for pool in pools:
        if pool == "share":
            out.append(count / n)
        elif pool == "mean":
            out.append(np.where(above, values - bias, 0).sum(axis=1) / np.maximum(count, 1))
        elif pool == "place":
            out.append(np.where(count > 0, (above * np.arange(n)).sum(axis=1) / np.maximum(count, 1) / max(n - 1, 1), -1.0))
        elif pool == "stretch":
            last = np.maximum.accumulate(np.where(above, -1, np.arange(n)), axis=1)
            out.append(np.where(above, np.arange(n) - last, 0).max(axis=1) / n)
        else:
            raise ValueError(f"unknown pool {pool}")
    return out


def transform(rows: DataFrame, flat: str, channels: int, kernels: list[Kernel], pools: tuple[str, ...] = ("share",)) -> DataFrame:
    """Adds features, of every kernel, bias and pool, by Arrow batches: a narrow map without a shuffle."""
    held = rows.sparkSession.sparkContext.broadcast(kernels)

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        out = []
        for first in range(0, len(column), STEP_ROWS):
            part = column.iloc[first : first + STEP_ROWS]
            x = np.stack([np.asarray(v, float).reshape(channels, -1) for v in part])
            parts = [f for kernel in held.value for values in [kernel.convolve(x)] for bias in kernel.biases for f in pooled(values, bias, pools)]
            out += list(np.stack(parts, axis=1))
        return pd.Series(out)

    return rows.withColumn("features", run(flat))


@dataclass(frozen=True)
class Ridge:
    """Weights, intercept and penalty, and the mean squared leave-one-out error of each penalty."""

    weights: np.ndarray
    intercept: float
    alpha: float
    errors: dict[float, float]

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds margin and pred (1 above zero)."""
        w = F.array(*[F.lit(float(x)) for x in self.weights])
        value = F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(self.intercept), lambda a, x: a + x)
        return rows.withColumn("margin", value).withColumn("pred", (F.col("margin") > 0).cast("int"))


def _stacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), batch.column("y").to_numpy(zero_copy_only=False).astype(float)


def fit_ridge(rows: DataFrame, label: str, alphas: tuple[float, ...] = ALPHAS) -> Ridge:
    """A ridge classifier of labels -1 and 1 for rows(features array, label 0 or 1), intercept free.

    One job adds up the Gram matrix; its eigenvectors, from the driver, serve all penalties: a second job adds up each penalty's squared leave-one-out errors, (y - fit) / (1 - leverage),
    row by row. The first penalty of least error is taken; no rows raise ValueError. The driver holds squares of the number of features, the executors of no more.
    """
    data = rows.select(F.col("features").cast("array<double>").alias("features"), (2 * F.col(label).cast("double") - 1).alias("y")).where("features IS NOT NULL AND y IS NOT NULL")

    def grams(batches):
        total = None
        for batch in batches:
            if len(batch):
                x, y = _stacked(batch)
                z = np.column_stack([x, np.ones(len(x)), y])
                total = (0 if total is None else total) + z.T @ z
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "g"])

    got = data.mapInArrow(grams, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()
    if not len(got):
        raise ValueError("no rows to learn from")
    i, j, g = (got.column(c).to_numpy() for c in ("i", "j", "g"))
    gram = np.zeros((int(j.max()) + 1,) * 2)
    gram[i, j] = gram[j, i] = g
    n = gram[-2, -2]
    mean, y_mean = gram[:-2, -2] / n, gram[-1, -2] / n
    values, vectors = np.linalg.eigh(gram[:-2, :-2] - n * np.outer(mean, mean))
    values = np.maximum(values, 0)
    along = vectors.T @ (gram[:-2, -1] - n * mean * y_mean)
    grid = np.asarray(alphas, float)

    def errors(batches):
        total = np.zeros(len(grid))
        for batch in batches:
            if len(batch):
                x, y = _stacked(batch)
                z = (x - mean) @ vectors
                inverse = 1 / (values[:, None] + grid)
                fit, leverage = y_mean + z @ (along[:, None] * inverse), 1 / n + (z * z) @ inverse
                total += (((y[:, None] - fit) / np.maximum(1 - leverage, 1e-12)) ** 2).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(len(grid)), pa.int32()), pa.array(total)], names=["at", "e"])

    sums = data.mapInArrow(errors, "at int, e double").groupBy("at").agg(F.sum("e").alias("e")).orderBy("at").toArrow().column("e").to_numpy() / n
    best = int(np.argmin(sums))
    weights = vectors @ (along / (values + grid[best]))
    return Ridge(weights, float(y_mean - mean @ weights), float(grid[best]), dict(zip(grid.tolist(), sums.tolist(), strict=True)))
