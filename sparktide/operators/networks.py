"""Convolutional and recurrent networks over windows: executors add up gradients, the driver takes the optimiser's steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.operators.splits import draw

Params = dict[str, np.ndarray]
Gradient = Callable[[Params, np.ndarray, np.ndarray], tuple[float, Params]]

#: Windows that a task takes through a network at a time.
STEP_ROWS = 256
KERNEL = 5
WIDTHS = (32, 64)
HIDDEN = 64


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _uniform(rng: np.random.Generator, reach: float, *shape: int) -> np.ndarray:
    return rng.uniform(-reach, reach, shape)


# Convolutions: two layers with padding, each with rectification; the average over time; one linear unit.


def conv_params(channels: int, seed: int = 42, widths: tuple[int, int] = WIDTHS, kernel: int = KERNEL) -> Params:
    rng, (a, b) = np.random.default_rng(seed), widths
    r1, r2, r3 = (channels * kernel) ** -0.5, (a * kernel) ** -0.5, b**-0.5
    return {"w1": _uniform(rng, r1, channels * kernel, a), "b1": _uniform(rng, r1, a), "w2": _uniform(rng, r2, a * kernel, b), "b2": _uniform(rng, r2, b), "w": _uniform(rng, r3, b), "b": _uniform(rng, r3, 1)}


def _taps(x: np.ndarray, kernel: int) -> np.ndarray:
    """(n, time, channels * kernel): around each time `kernel` values of each channel, zero beyond the ends."""
    padded = np.pad(x, ((0, 0), (kernel // 2, kernel - 1 - kernel // 2), (0, 0)))
    return np.lib.stride_tricks.sliding_window_view(padded, kernel, axis=1).reshape(*x.shape[:2], -1)


def _layers(p: Params, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Taps and values of both layers, and the logits, for x: (n, channels, time)."""
    x = x.transpose(0, 2, 1)
    kernel = p["w1"].shape[0] // x.shape[2]
    taps1 = _taps(x, kernel)
    h1 = np.maximum(taps1 @ p["w1"] + p["b1"], 0)
    taps2 = _taps(h1, p["w2"].shape[0] // h1.shape[2])
    h2 = np.maximum(taps2 @ p["w2"] + p["b2"], 0)
    return taps1, h1, taps2, h2, h2.mean(axis=1) @ p["w"] + p["b"][0]


def conv_gradient(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """The sum over windows of the cross-entropy of the logits, and its gradient."""
    taps1, h1, taps2, h2, logits = _layers(p, x)
    off, n_time = sigmoid(logits) - y, h1.shape[1]
    d2 = (off[:, None, None] * p["w"] / n_time) * (h2 > 0)
    kernel = p["w2"].shape[0] // h1.shape[2]
    dtaps = (d2 @ p["w2"].T).reshape(*h1.shape, kernel)
    padded = np.zeros((len(x), n_time + kernel - 1, h1.shape[2]))
    for k in range(kernel):
        padded[:, k : k + n_time] += dtaps[..., k]
    d1 = padded[:, kernel // 2 : kernel // 2 + n_time] * (h1 > 0)
    grad = {
        "w1": np.einsum("ntk,ntc->kc", taps1, d1, optimize=True), "b1": d1.sum(axis=(0, 1)), "w2": np.einsum("ntk,ntc->kc", taps2, d2, optimize=True), "b2": d2.sum(axis=(0, 1)),
        "w": h2.mean(axis=1).T @ off, "b": np.array([off.sum()]),
    }
    return float(np.logaddexp(0, logits).sum() - y @ logits), grad


# A recurrence of long short-term memory over time; one linear unit on its last state.


def lstm_params(channels: int, seed: int = 42, hidden: int = HIDDEN) -> Params:
    rng, r = np.random.default_rng(seed), hidden**-0.5
    return {"wx": _uniform(rng, r, channels, 4 * hidden), "wh": _uniform(rng, r, hidden, 4 * hidden), "bh": _uniform(rng, r, 4 * hidden), "w": _uniform(rng, r, hidden), "b": _uniform(rng, r, 1)}


def _states(p: Params, x: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each time the gates (in, forget, new, out), the cell before and after, and the state before and after."""
    n, hidden = len(x), p["wh"].shape[0]
    cell, state, out = np.zeros((n, hidden)), np.zeros((n, hidden)), []
    for t in range(x.shape[2]):
        z = x[:, :, t] @ p["wx"] + state @ p["wh"] + p["bh"]
        i, f, o = sigmoid(z[:, :hidden]), sigmoid(z[:, hidden : 2 * hidden]), sigmoid(z[:, 3 * hidden :])
        g = np.tanh(z[:, 2 * hidden : 3 * hidden])
        after = f * cell + i * g
        new = o * np.tanh(after)
        out.append((i, f, g, o, cell, after, state, new))
        cell, state = after, new
    return out


def lstm_gradient(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """The sum over windows of the cross-entropy of the logits, and its gradient by the chain of all times."""
    steps = _states(p, x)
    last = steps[-1][-1]
    logits = last @ p["w"] + p["b"][0]
    off = sigmoid(logits) - y
    grad = {k: np.zeros_like(v) for k, v in p.items()} | {"w": last.T @ off, "b": np.array([off.sum()])}
    d_state, d_cell = off[:, None] * p["w"], np.zeros_like(last)
    for t in range(len(steps) - 1, -1, -1):
        i, f, g, o, cell, after, state, _ = steps[t]
        bent = np.tanh(after)
        d_cell = d_cell + d_state * o * (1 - bent * bent)
        dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * cell * f * (1 - f), d_cell * i * (1 - g * g), d_state * bent * o * (1 - o)], axis=1)
        grad["wx"] += x[:, :, t].T @ dz
        grad["wh"] += state.T @ dz
        grad["bh"] += dz.sum(axis=0)
        d_state, d_cell = dz @ p["wh"].T, d_cell * f
    return float(np.logaddexp(0, logits).sum() - y @ logits), grad


def logits(kind: str, p: Params, x: np.ndarray) -> np.ndarray:
    return _layers(p, x)[-1] if kind == "conv" else _states(p, x)[-1][-1] @ p["w"] + p["b"][0]


GRADIENTS: dict[str, Gradient] = {"conv": conv_gradient, "lstm": lstm_gradient}


# Training and scoring.


def _flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k], at = flat[at : at + like[k].size].reshape(like[k].shape), at + like[k].size
    return out


def _windows(column: pa.Array, channels: int):
    """(rows, channels, time) arrays of at most STEP_ROWS flat channel-major windows."""
    for first in range(0, len(column), STEP_ROWS):
        part = column.slice(first, STEP_ROWS)
        yield first, part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), channels, -1)


def summed_gradient(rows: DataFrame, kind: str, p: Params, channels: int, mean: float = 0.0, deviation: float = 1.0) -> tuple[float, int, Params]:
    """(loss, windows, gradient) summed over all rows(v, y); each task adds up its own, Spark the tasks', and one number for each parameter reaches the driver."""
    gradient, size = GRADIENTS[kind], _flat(p).size

    def run(batches):
        total = np.zeros(size + 2)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            for first, x in _windows(batch.column("v"), channels):
                loss, grad = gradient(p, (x - mean) / deviation, y[first : first + len(x)])
                total += np.concatenate([_flat(grad), [loss, len(x)]])
        yield pa.record_batch([pa.array(np.arange(size + 2), pa.int32()), pa.array(total)], names=["at", "value"])

    got = rows.select("v", "y").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(size + 2)
    total[got.column("at").to_numpy()] = got.column("value").to_numpy()
    return float(total[-2]), int(total[-1]), _shaped(total[:-2], p)


class Network:
    """A fitted network: its kind, parameters, channels and the scale of its inputs."""

    def __init__(self, kind: str, params: Params, channels: int, mean: float, deviation: float, losses: list[float]):
        self.kind, self.params, self.channels, self.mean, self.deviation, self.losses = kind, params, channels, mean, deviation, losses

    def score(self, rows: DataFrame, flat: str) -> DataFrame:
        """Adds proba and pred (1 from one half on)."""
        model = rows.sparkSession.sparkContext.broadcast((self.kind, self.params, self.channels, self.mean, self.deviation))

        @F.pandas_udf("double")
        def run(column):
            import pandas as pd

            kind, params, channels, mean, deviation = model.value
            out = [sigmoid(logits(kind, params, (x - mean) / deviation)) for _, x in _windows(pa.array(column.tolist(), pa.list_(pa.float64())), channels)]
            return pd.Series(np.concatenate(out) if out else [])

        return rows.withColumn("proba", run(flat)).withColumn("pred", (F.col("proba") >= 0.5).cast("int"))


def fit_network(
    rows: DataFrame, flat: str, label: str, key: str, channels: int, kind: str = "conv", epochs: int = 10, batches: int = 4, rate: float = 0.02, seed: int = 42, params: Params | None = None
) -> Network:
    """A network of one logit for rows(key, flat channel-major array, label 0 or 1), by Adam on the mean cross-entropy.

    Rows are dealt to `batches` by a random order of their keys; an epoch takes a step for each batch, by the gradient summed over its rows, so that a step is one job over a part of the rows and
    nothing of a window leaves its executor. Gradients longer than 1 are cut to that length, and the rate falls to zero over the steps. Inputs are scaled by the mean and deviation of all training
    values. Rows without a window or label are left out; no rows raise ValueError.
    """
    if kind not in GRADIENTS:
        raise ValueError(f"unknown network {kind}")
    data = rows.select(F.col(flat).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y"), F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("long").alias("deal"))
    data = data.where("v IS NOT NULL AND y IS NOT NULL").withColumn("deal", F.col("deal") % batches).persist()
    add = lambda f: F.aggregate("v", F.lit(0.0), lambda a, x: a + f(x))
    n, s, q = data.agg(F.sum(F.size("v")), F.sum(add(lambda x: x)), F.sum(add(lambda x: x * x))).first()
    if not n:
        raise ValueError("no rows to learn from")
    mean, deviation = s / n, max(q / n - (s / n) ** 2, 0.0) ** 0.5 or 1.0
    p = params or {"conv": conv_params, "lstm": lstm_params}[kind](channels, seed)
    at, m, v, losses = _flat(p), 0.0, 0.0, []
    steps = epochs * batches
    for t in range(steps):
        loss, count, grad = summed_gradient(data.where(F.col("deal") == t % batches), kind, _shaped(at, p), channels, mean, deviation)
        if count:
            g = _flat(grad) / count
            g = g / max(1.0, float(np.linalg.norm(g)))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            at = at - rate * (1 - t / steps) * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
            losses.append(loss / count)
    data.unpersist()
    return Network(kind, _shaped(at, p), channels, mean, deviation, losses)
