"""Time-varying multivariate autoregression and the variation of its coefficient matrices.

The relational form of each step (columns basis, lagged products, ridge for one channel) is here beside the numeric one: dense solves run
in Arrow batches of whole windows, a narrow map without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MvarConfig:
    order: int = 3
    n_basis: int = 10
    basis: str = "bspline"
    regularization: float = 0.1
    norm: str = "fro"
    n_time_points: int = 50
    upper_lags: tuple[int, int] | None = None

    def lags(self) -> range:
        """Lags (from 0) whose variation counts: the upper half unless given."""
        first, end = self.upper_lags or (self.order // 2, self.order)
        return range(first, min(end, self.order))


def basis_matrix(t: np.ndarray, n_basis: int, kind: str, degree: int = 3) -> np.ndarray:
    """Values (len(t) x n_basis) of a clamped uniform B-spline basis on [0, 1], or of the powers of 2t - 1."""
    t = np.asarray(t, float)
    if kind == "polynomial":
        return (2 * t - 1)[:, None] ** np.arange(n_basis)
    if kind != "bspline":
        raise ValueError(f"unknown basis {kind}")
    if n_basis <= degree:
        raise ValueError("a B-spline basis needs more functions than its degree")
    knots = np.concatenate([np.zeros(degree), np.linspace(0, 1, n_basis - degree + 1), np.ones(degree)])
    span = np.clip(np.searchsorted(knots, t, side="right") - 1, degree, n_basis - 1)  # the right end belongs to the last piece
    values = np.zeros((len(t), n_basis + degree))
    values[np.arange(len(t)), span] = 1.0
    for d in range(1, degree + 1):
        width = knots[d : d + n_basis + degree - d] - knots[: n_basis + degree - d]
        rise = np.divide(t[:, None] - knots[: n_basis + degree - d], width, out=np.zeros((len(t), len(width))), where=width > 0)
        rising = rise * values[:, : n_basis + degree - d]
        values = rising + np.concatenate([(values[:, : n_basis + degree - d] - rising)[:, 1:], np.zeros((len(t), 1))], axis=1)
    return values[:, :n_basis]


@lru_cache(maxsize=64)
def _basis(n: int, n_basis: int, kind: str) -> np.ndarray:
    return basis_matrix(np.linspace(0, 1, n), n_basis, kind)


@lru_cache(maxsize=64)
def _differences(times: int, n_basis: int, kind: str) -> np.ndarray:
    """The basis' difference between any two times."""
    phi = _basis(times, n_basis, kind)
    i, j = np.triu_indices(times, 1)
    return phi[i] - phi[j]


def _standardised(signal: np.ndarray) -> np.ndarray:
    """(samples x channels), by each channel's population deviation, one of zero staying as it is."""
    z = signal.T if signal.shape[0] < signal.shape[1] else signal
    sd = z.std(axis=0)
    return (z - z.mean(axis=0)) / np.where(sd == 0, 1, sd)


def _design(z: np.ndarray, phi: np.ndarray, order: int, first: int, end: int) -> np.ndarray:
    """Rows [first, end) of the design: by lag, channel and basis function."""
    lagged = np.stack([z[first - j : end - j] for j in range(1, order + 1)], axis=1)
    return np.einsum("tjc,tk->tjck", lagged, phi[first:end]).reshape(end - first, order * z.shape[1] * phi.shape[1])


def fit_window(signal: np.ndarray, c: MvarConfig) -> np.ndarray:
    """Ridge coefficients (order x channels out x channels in x n_basis) of one window (channels x samples; transposed if it is taller than wide).

    Channels are standardised by their population deviation, one of zero staying as it is. All channels share one
    factorisation, of the smaller of the two Gram matrices.
    """
    z = _standardised(signal)
    n, p = z.shape
    x, y = _design(z, _basis(n, c.n_basis, c.basis), c.order, c.order, n), z[c.order :]
    if c.regularization == 0:
        w = np.linalg.lstsq(x, y, rcond=None)[0]
    elif x.shape[1] <= x.shape[0]:
        w = np.linalg.solve(x.T @ x + c.regularization * np.eye(x.shape[1]), x.T @ y)
    else:
        w = x.T @ np.linalg.solve(x @ x.T + c.regularization * np.eye(x.shape[0]), y)
    return w.reshape(c.order, p, c.n_basis, p).transpose(0, 3, 1, 2)


def fit_grid(signal: np.ndarray, configs: list[MvarConfig]) -> list[np.ndarray]:
    """fit_window() for each configuration, with shared work: the Gram matrix of the largest order serves all orders, as its leading block and the few rows that a smaller order has before it;
    one eigendecomposition serves all penalties. Where the design has more columns than rows, that of its rows' products serves instead."""
    z = _standardised(signal)
    n, p = z.shape
    out: list[np.ndarray | None] = [None] * len(configs)
    for kind, k in dict.fromkeys((c.basis, c.n_basis) for c in configs):
        here = [i for i, c in enumerate(configs) if (c.basis, c.n_basis) == (kind, k)]
        most, phi = max(configs[i].order for i in here), _basis(n, k, kind)
        whole = _design(z, phi, most, most, n)
        gram = cross = None
        for order in dict.fromkeys(configs[i].order for i in here):
            width, own = order * p * k, [i for i in here if configs[i].order == order]
            early, late = _design(z, phi, order, order, most), whole[:, :width]
            if width <= n - order:
                if gram is None:
                    gram, cross = whole.T @ whole, whole.T @ z[most:]
                values, vectors = np.linalg.eigh(gram[:width, :width] + early.T @ early)
                left, right = vectors, vectors.T @ (cross[:width] + early.T @ z[order:most])
            else:
                x = np.concatenate([early, late])
                values, vectors = np.linalg.eigh(x @ x.T)
                left, right = x.T @ vectors, vectors.T @ z[order:]
            for i in own:
                c = configs[i]
                if c.regularization == 0:
                    out[i] = fit_window(signal, c)
                else:
                    out[i] = (left @ (right / (np.maximum(values, 0) + c.regularization)[:, None])).reshape(order, p, k, p).transpose(0, 3, 1, 2)
    return out


def lag_variation(coefficients: np.ndarray, c: MvarConfig, norm: str | None = None) -> np.ndarray:
    """For each lag the largest norm of the difference of two of its matrices along n_time_points times.

    The Frobenius norm of a difference is a quadratic form of the basis' difference with the Gram matrix of the coefficients, so no matrix is built for it.
    """
    delta = _differences(c.n_time_points, c.n_basis, c.basis)
    if (norm or c.norm) not in ("fro", "spectral", "operator"):
        raise ValueError(f"unknown norm {norm or c.norm}")
    gram = np.einsum("labk,labm->lkm", coefficients, coefficients)
    fro = np.sqrt(np.maximum(((delta @ gram) * delta).sum(axis=2), 0))
    if (norm or c.norm) == "fro":
        return fro.max(axis=1)
    return np.array([_largest_spectral(lag, delta, bound) for lag, bound in zip(coefficients, fro, strict=True)])


def _largest_spectral(lag: np.ndarray, delta: np.ndarray, bound: np.ndarray, step: int = 32) -> float:
    """The largest spectral norm: pairs are taken by falling Frobenius norm, which bounds it, until no bound exceeds the best."""
    order, best = np.argsort(-bound), 0.0
    for k in range(0, len(order), step):
        part = order[k : k + step]
        if bound[part[0]] <= best:
            break
        best = max(best, float(np.linalg.norm(np.einsum("abk,dk->dab", lag, delta[part]), 2, axis=(1, 2)).max()))
    return best


def scalar_feature(signal: np.ndarray, c: MvarConfig) -> float:
    lags = list(c.lags())
    return float(lag_variation(fit_window(signal, c), c)[lags].max()) if lags else 0.0


def feature_names(c: MvarConfig, per_lag: bool = False) -> list[str]:
    names = [f"S_{stat}_{norm}" for norm in ("fro", "spec") for stat in ("max", "mean", "std")]
    return names + [f"D_lag{j + 1}_fro" for j in c.lags()] * per_lag


def vector_feature(signal: np.ndarray, c: MvarConfig, per_lag: bool = False) -> list[float]:
    """Largest, mean and population deviation over the counted lags, for both norms; the lags' own values if per_lag."""
    return coefficient_features(fit_window(signal, c), c, per_lag)


def coefficient_features(w: np.ndarray, c: MvarConfig, per_lag: bool = False) -> list[float]:
    lags = list(c.lags())
    fro, spec = lag_variation(w, c, "fro")[lags], lag_variation(w, c, "spectral")[lags]
    stats = [f(v) if len(v) else 0.0 for v in (fro, spec) for f in (np.max, np.mean, np.std)]
    return [float(x) for x in (*stats, *(fro if per_lag else ()))]


def extract(windows: DataFrame, signal: str, c: MvarConfig, vector: bool = False, per_lag: bool = False) -> DataFrame:
    """Adds the scalar feature S, or the columns of feature_names(), for signal: array<array<float>> (channels x samples)."""
    names = feature_names(c, per_lag) if vector else ["S"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(column: pd.Series) -> pd.DataFrame:
        out = []
        for value in column:
            m = np.stack([np.asarray(row, float) for row in value])
            out.append(vector_feature(m, c, per_lag) if vector else [scalar_feature(m, c)])
        return pd.DataFrame(out, columns=names, dtype=float)

    return spread_out(windows).withColumn("__f", run(signal)).select("*", "__f.*").drop("__f")


def spread_out(windows: DataFrame) -> DataFrame:
    """The windows in as many partitions as there are cores, where they come in fewer: they cost far more than their move."""
    cores = windows.sparkSession.sparkContext.defaultParallelism
    return windows.repartition(cores) if windows.rdd.getNumPartitions() < cores else windows


def extract_grid(windows: DataFrame, signal: str, configs: list[MvarConfig]) -> tuple[DataFrame, list[str]]:
    """Adds the columns of feature_names() for each configuration, named name_ck for the k-th, and returns their names in that order; each window is read once."""
    names = [f"{name}_c{k}" for k in range(len(configs)) for name in feature_names(configs[0])]

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def run(column: pd.Series) -> pd.DataFrame:
        out = []
        for value in column:
            fits = fit_grid(np.stack([np.asarray(row, float) for row in value]), configs)
            out.append([x for w, c in zip(fits, configs, strict=True) for x in coefficient_features(w, c)])
        return pd.DataFrame(out, columns=names, dtype=float)

    return spread_out(windows).withColumn("__f", run(signal)).select("*", "__f.*").drop("__f"), names


# The relational form.


def long_form(windows: DataFrame, key: str, flat: str, n_samples: int) -> DataFrame:
    """(key, ch, t, x) of a flat channel-major array."""
    at = windows.select(key, F.posexplode(flat).alias("pos", "x"))
    return at.select(key, F.floor(F.col("pos") / n_samples).cast("int").alias("ch"), (F.col("pos") % n_samples).alias("t"), F.col("x").cast("double").alias("x"))


def standardised(samples: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key, "ch")
    sd = F.stddev_pop("x").over(w)
    return samples.withColumn("z", (F.col("x") - F.avg("x").over(w)) / F.when(sd == 0, 1.0).otherwise(sd))


def polynomial(t: Column, n_samples: int, k: Column | int) -> Column:
    """(2 t / (n - 1) - 1) ** k."""
    return F.pow(2.0 * t / F.lit(float(n_samples - 1)) - 1.0, k)


def bernstein(t: Column, n_samples: int) -> list[Column]:
    """The four clamped cubic B-splines without inner knots."""
    u = t.cast("double") / F.lit(float(n_samples - 1))
    return [(1 - u) * (1 - u) * (1 - u), 3 * u * (1 - u) * (1 - u), 3 * u * u * (1 - u), u * u * u]


def design_rows(samples: DataFrame, key: str, n_samples: int, order: int, n_basis: int) -> DataFrame:
    """(key, t, col, value): the design matrix for the polynomial basis, columns by lag, channel, basis function."""
    w = Window.partitionBy(key, "ch").orderBy("t")
    lagged = samples.withColumn("lags", F.array(*[F.lag("z", j).over(w) for j in range(1, order + 1)])).where(F.col("t") >= order)
    p = F.max("ch").over(Window.partitionBy(key)) + 1
    wide = lagged.withColumn("p", p).select(key, "ch", "t", "p", F.posexplode("lags").alias("j", "v"))
    basis = F.explode(F.sequence(F.lit(0), F.lit(n_basis - 1))).alias("k")
    return wide.select(key, "ch", "t", "p", "j", "v", basis).select(
        key, "t", ((F.col("j") * F.col("p") + F.col("ch")) * n_basis + F.col("k")).alias("col"), (F.col("v") * polynomial(F.col("t"), n_samples, F.col("k"))).alias("value")
    )


def closed_form_variation(samples: DataFrame, key: str, n_samples: int, alpha: float) -> DataFrame:
    """(key, c0, c1, variation) for one channel, order 1 and the basis 1, 2t - 1: ridge by Cramer's rule; the variation is 2 |c1|."""
    w = Window.partitionBy(key, "ch").orderBy("t")
    rows = samples.withColumn("u", F.lag("z", 1).over(w)).where("u IS NOT NULL").withColumn("v", F.col("u") * polynomial(F.col("t"), n_samples, 1))
    s = rows.groupBy(key).agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("uu", "uv", "vv", "uz", "vz")])
    a, b, d = F.col("uu") + alpha, F.col("uv"), F.col("vv") + alpha
    det = a * d - b * b
    c0, c1 = (d * F.col("uz") - b * F.col("vz")) / det, (a * F.col("vz") - b * F.col("uz")) / det
    return s.select(key, c0.alias("c0"), c1.alias("c1"), (2 * F.abs(c1)).alias("variation"))


def path_variation(coefficients: DataFrame, key: list[str], times: int) -> DataFrame:
    """(key, lag, variation) of coefficients(key, lag, i, j, k, c): the largest Frobenius norm between two of `times` points of the polynomial path."""
    spread = coefficients.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    path = spread.groupBy(*key, "lag", "i", "j", "m").agg(F.sum(F.col("c") * polynomial(F.col("m"), times, F.col("k"))).alias("a"))
    b = path.select(*key, "lag", "i", "j", F.col("m").alias("m2"), F.col("a").alias("a2"))
    pairs = path.join(b, [*key, "lag", "i", "j"]).where("m < m2")
    norms = pairs.groupBy(*key, "lag", "m", "m2").agg(F.sqrt(F.sum((F.col("a") - F.col("a2")) * (F.col("a") - F.col("a2")))).alias("norm"))
    return norms.groupBy(*key, "lag").agg(F.max("norm").alias("variation"))
