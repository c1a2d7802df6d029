"""Baseline classifiers over windows: shapelets, a perceptron, and the dispatch to kernels, interval forests and networks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.operators import interval_forests, kernels, metrics, networks
from sparktide.operators.splits import draw


def kernel_ppv(series: Column, weights: list[float], bias: float = 0.0) -> Column:
    """The share of positive values in the convolution of an array with a kernel."""
    n = len(weights)
    at = F.sequence(F.lit(0), F.size(series) - n)
    value = lambda i: sum((F.get(series, i + k) * float(w) for k, w in enumerate(weights)), F.lit(-float(bias)))
    return F.size(F.filter(at, lambda i: value(i) > 0)) / (F.size(series) - n + 1)


def shapelet_distance(series: Column, shapelet: list[float]) -> Column:
    """The least squared distance of the shapelet to a slice of the array."""
    n = len(shapelet)
    at = F.sequence(F.lit(0), F.size(series) - n)
    return F.array_min(F.transform(at, lambda i: sum(((F.get(series, i + k) - float(w)) * (F.get(series, i + k) - float(w)) for k, w in enumerate(shapelet)), F.lit(0.0))))


def learn_shapelets(train: DataFrame, series: str, label: str, key: str, lengths=(8, 16), windows: int = 40, keep: int = 6, seed: int = 42) -> list[list[float]]:
    """The `keep` slices whose distances to the training windows differ most between the classes, against their spread.

    Candidates are one slice of each length from each of `windows` windows, in the order of draw(), so their number is fixed; all training
    windows judge them, by sums that the executors add up.
    """
    picked = train.orderBy(draw(seed, key)).select(series).limit(windows).collect()
    rng, candidates = np.random.default_rng(seed), []
    for row in picked:
        values = np.asarray(row[0], float)
        candidates += [values[a : a + n] for n in lengths if len(values) >= n for a in [rng.integers(len(values) - n + 1)]]

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            x, y = np.stack([np.asarray(v, float) for v in pdf["v"]]), pdf["y"].to_numpy()
            d = np.stack([((np.lib.stride_tricks.sliding_window_view(x, len(c), axis=1) - c) ** 2).sum(axis=2).min(axis=1) for c in candidates], axis=1)
            for c in (0, 1):
                own = d[y == c]
                total[c] = total.get(c, 0) + np.stack([np.full(len(candidates), float(len(own))), own.sum(axis=0), (own * own).sum(axis=0)])
        for c, t in total.items():
            yield pd.DataFrame({"y": c, "k": np.arange(len(candidates)), "n": t[0], "s": t[1], "q": t[2]})

    got = train.select(F.col(series).alias("v"), F.col(label).alias("y")).mapInPandas(sums, "y int, k int, n double, s double, q double").groupBy("y", "k").agg(*[F.sum(c).alias(c) for c in "nsq"])
    mean, var = F.col("s") / F.col("n"), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2
    each = got.where("n > 0").groupBy("k").agg((F.max(mean) - F.min(mean)).alias("gap"), F.sqrt(F.greatest(F.sum(var), F.lit(1e-12))).alias("spread"))
    best = each.orderBy(F.desc(F.col("gap") / F.col("spread")), "k").limit(keep).collect()
    return [candidates[r.k].tolist() for r in best]


def interval_statistics(series: Column, first: int, length: int) -> list[Column]:
    """Mean, population deviation and least-squares slope over a slice."""
    part = F.slice(series, first + 1, length)
    total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    mean = total / length
    squares = F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x)
    middle = (length - 1) / 2.0
    cross = F.aggregate(F.transform(part, lambda x, i: (i - middle) * x), F.lit(0.0), lambda a, x: a + x)
    return [mean, F.sqrt(F.greatest(squares / length - mean * mean, F.lit(0.0))), cross / (length * (length * length - 1) / 12.0)]


def channel_mean(matrix: Column, n_channels: int, n_samples: int) -> Column:
    """The average over channels at each sample, of a flat channel-major array."""
    at = F.sequence(F.lit(0), F.lit(n_samples - 1))
    return F.transform(at, lambda t: sum((F.get(matrix, t + c * n_samples) for c in range(n_channels)), F.lit(0.0)) / n_channels)


def forest(rows: DataFrame, features: list[str], label: str, trees: int = 50, seed: int = 42):
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="vec"), RandomForestClassifier(featuresCol="vec", labelCol=label, numTrees=trees, seed=seed)]).fit(rows)


def as_vector(rows: DataFrame, flat: str) -> DataFrame:
    return rows.withColumn("vec", array_to_vector(flat))


def network(rows: DataFrame, flat: str, label: str, inputs: int, hidden: int = 16, seed: int = 42):
    """A perceptron on the samples of a window."""
    data = as_vector(rows, flat)
    model = MultilayerPerceptronClassifier(featuresCol="vec", labelCol=label, layers=[inputs, hidden, 2], maxIter=50, seed=seed).fit(data)
    return model, data


#: Names of the methods, aliases included.
METHODS = {
    "rocket": "kernels", "multirocket": "kernels", "minirocket": "kernel_shares", "arsenal": "kernel_votes", "tsf": "random_intervals", "timeseriesforest": "random_intervals", "stsf": "supervised_intervals",
    "stsforest": "supervised_intervals", "cif": "canonical_intervals", "canonicalintervalforest": "canonical_intervals", "drcif": "canonical_views", "drcanonicalintervalforest": "canonical_views",
    "shapelet": "shapelets", "shapelettransformclassifier": "shapelets", "cnn": "conv", "timecnn": "conv", "rnn": "lstm", "timernn": "lstm", "perceptron": "perceptron",
}


@dataclass(frozen=True)
class Sizes:
    """How much each method takes on."""

    kernel_features: int = 504
    members: int = 3
    trees: int = 50
    depth: int = 6
    epochs: int = 10
    batches: int = 4
    rate: float = 0.02


def predict(kind: str, train: DataFrame, test: DataFrame, flat: str, label: str, key: str, channels: int, samples: int, sizes: Sizes | None = None, seed: int = 42) -> DataFrame:
    """test with pred (0 or 1) by a method of METHODS' values, trained on train(key, flat channel-major array, label 0 or 1)."""
    z = sizes or Sizes()
    if kind in ("conv", "lstm"):
        return networks.fit_network(train, flat, label, key, channels, kind, z.epochs, z.batches, z.rate, seed).score(test, flat)
    if kind == "perceptron":
        model, _ = network(train, flat, label, channels * samples, seed=seed)
        return model.transform(as_vector(test, flat)).withColumn("pred", F.col("prediction").cast("int"))
    if kind == "shapelets":
        shapes = learn_shapelets(train, flat, label, key, seed=seed)
        names = [f"__d{k}" for k in range(len(shapes))]
        add = lambda rows: rows.select("*", *[shapelet_distance(F.col(flat), s).alias(n) for n, s in zip(names, shapes, strict=True)])
        return forest(add(train), names, label, z.trees, seed).transform(add(test)).withColumn("pred", F.col("prediction").cast("int"))
    if kind in ("kernels", "kernel_shares", "kernel_votes"):
        pools, members = ("share",) if kind == "kernel_shares" else kernels.POOLS, range(z.members if kind == "kernel_votes" else 1)
        out = test
        for k in members:
            fitted = kernels.fit_biases(train, flat, key, channels, kernels.plan_kernels(channels, samples, z.kernel_features // len(pools), seed + k), seed=seed + k)
            model = kernels.fit_ridge(kernels.transform(train, flat, channels, fitted, pools), label)
            out = model.score(kernels.transform(out, flat, channels, fitted, pools)).withColumnsRenamed({"pred": f"__v{k}", "margin": f"__m{k}"}).drop("features")
        votes, margins = (sum((F.col(f"__{c}{k}") for k in members), F.lit(0)) for c in "vm")
        out = out.withColumn("pred", (2 * votes > len(members)).cast("int")).withColumn("margin", margins / len(members))
        return out.drop(*[f"__{c}{k}" for k in members for c in "vm"])
    rows = interval_forests.labelled(train, flat, label)
    if kind == "random_intervals":
        specs = interval_forests.random_intervals(z.trees, samples, seed)
    elif kind == "supervised_intervals":
        rows = rows.persist()
        specs = interval_forests.supervised_intervals(rows, z.trees, channels, samples, seed)
    elif kind in ("canonical_intervals", "canonical_views"):
        specs = interval_forests.canonical_intervals(z.trees, channels, samples, ("values",) if kind == "canonical_intervals" else tuple(interval_forests.VIEWS), seed=seed)
    else:
        raise ValueError(f"unknown method {kind}")
    return interval_forests.grow_forest(rows, specs, channels, z.depth).score(test, flat)


def evaluate_methods(names: list[str], train: DataFrame, test: DataFrame, flat: str, label: str, key: str, channels: int, samples: int, sizes: Sizes | None = None, seed: int = 42) -> DataFrame:
    """(method, accuracy, roc_auc, error) of each named method, trained on train and applied to test (see predict()); a method that fails has its error and nulls.

    roc_auc is that of the chance or margin of class 1 where a method has one and test has both classes.
    """
    out = []
    for name in names:
        try:
            kind = METHODS.get(name.lower())
            if kind is None:
                raise ValueError(f"unknown method {name}")
            scored = predict(kind, train, test, flat, label, key, channels, samples, sizes, seed)
            score = next((c for c in ("proba", "margin") if c in scored.columns), None)
            own = scored.select(F.col(label).alias("y"), "pred", *([F.col(score).cast("double").alias("s")] if score else [])).persist()
            accuracy = own.agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
            auc = metrics.ranking(metrics.curve(own, "y", "s")).first().roc_auc if score and accuracy is not None else None
            own.unpersist()
            out.append((name, accuracy, auc, None))
        except Exception as e:  # noqa: BLE001  a failed method is a result of its own
            out.append((name, None, None, f"{type(e).__name__}: {str(e)[:300]}"))
    return train.sparkSession.createDataFrame(out, "method string, accuracy double, roc_auc double, error string")


def run_methods(names: list[str], train, spark) -> DataFrame:
    """(method, accuracy, error): each method's accuracy by train(kind), or the error that ended it."""
    out = []
    for name in names:
        try:
            out.append((name, float(train(METHODS[name.lower()])), None))
        except Exception as e:  # noqa: BLE001  a failed method is a result of its own
            out.append((name, None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(out, "method string, accuracy double, error string")
