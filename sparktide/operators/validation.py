"""Parameter grids, cross-validation and its summary."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktide.operators import metrics
from sparktide.operators.mvar import MvarConfig, extract_grid
from sparktide.operators.splits import random_rank

#: Rows up to which the table of dealt ranks is broadcast; beyond, it is joined by a shuffle.
BROADCAST_PIECES = 100_000
FULL_GRID = {"C": [0.1, 1.0], "mvar_order": [2, 3], "n_basis": [5, 10], "regularization": [0.1, 1.0]}


def parameter_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """(param_idx, one column for each name): names in order, the last varying fastest."""
    names = sorted(grid)
    rows = [(k, *values) for k, values in enumerate(product(*(grid[n] for n in names)))]
    return spark.createDataFrame(rows, ["param_idx", *names]).withColumn("param_idx", F.col("param_idx").cast("int"))


def summary(fold_metrics: DataFrame, names: list[str]) -> DataFrame:
    """(metric, mean, std): over folds, population deviation, nulls left out."""
    long = fold_metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def best_parameters(inner: DataFrame) -> DataFrame:
    """(fold, param_idx, score) of inner(fold, param_idx, score): the first parameter set of the greatest mean score."""
    mean = inner.groupBy("fold", "param_idx").agg(F.avg("score").alias("score"))
    first = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("score"), "param_idx"))
    return mean.withColumn("__r", first).where("__r = 1").drop("__r")


def deal_pieces(histogram: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """(n, first, end, cycle) for a histogram (n, groups of n rows): of the groups of n rows, in some order, those of ranks [first, end) go to the folds of `cycle` in turn.

    It is the deal of the largest group to the lightest fold, and so on, without a step for each group: of equal groups a fold takes one at each of the loads load, load + n, load + 2n, ..., so the deal
    merges these sequences by (load, fold), and folds join the turn where their first load is reached.
    """
    load, out = [0] * folds, []
    for n, left in sorted(histogram, reverse=True):
        first, levels = 0, sorted({x // n for x in load})
        for k, level in enumerate(levels):
            cycle = sorted((j for j in range(folds) if load[j] // n <= level), key=lambda j: (load[j] % n, j))
            taken = left if k + 1 == len(levels) else min(left, (levels[k + 1] - level) * len(cycle))
            if taken:
                out.append((n, first, first + taken, cycle))
                for place, j in enumerate(cycle):
                    load[j] += n * (taken // len(cycle) + (place < taken % len(cycle)))
            first, left = first + taken, left - taken
            if not left:
                break
    return out


def group_folds(counts: DataFrame, group: str, folds: int, by: str | None = None, seed: int = 42) -> DataFrame:
    """Adds fold to counts(group, n, ...): the largest group to the lightest fold so far, and so on, the first of equal folds; equal groups in a random order, each `by` dealt for itself.

    Groups are ranked among those of equal size in slices; the driver deals the histogram of sizes, whose length grows with the square root of the rows at most, and not the groups. A null group is one of its own.
    """
    keys = [by] if by else []
    ranked = random_rank(counts.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))), [*keys, "n"], "__key", seed).drop("__key")
    histograms: dict[object, list[tuple[int, int]]] = {}
    for r in counts.groupBy(*keys, "n").agg(F.count("*").alias("groups")).collect():
        histograms.setdefault(r[by] if by else None, []).append((r["n"], r["groups"]))
    pieces = [(*([b] if by else []), *piece) for b, histogram in histograms.items() for piece in deal_pieces(histogram, folds)]
    kinds = [*(f"{by} {counts.schema[by].dataType.simpleString()}" for _ in keys), "n long, __first long, __end long, __cycle array<int>"]
    table = counts.sparkSession.createDataFrame(pieces, ", ".join(kinds))
    joined = ranked.join(F.broadcast(table) if len(pieces) <= BROADCAST_PIECES else table, [*keys, "n"]).where("rank > __first AND rank <= __end")
    turn = ((F.col("rank") - 1 - F.col("__first")) % F.size("__cycle")).cast("int")
    return joined.withColumn("fold", F.get("__cycle", turn)).drop("rank", "__first", "__end", "__cycle")


def nested_folds(rows: DataFrame, subject: str, outer: int, inner: int) -> DataFrame:
    """(subject, fold, inner): the outer fold of each subject, and its inner fold among the training subjects of each outer fold (-1 in its own), by group_folds() each time."""
    counts = rows.groupBy(subject).agg(F.count("*").alias("n")).persist()
    spread = group_folds(counts, subject, outer).withColumnRenamed("fold", "outer").withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).persist()
    dealt = group_folds(spread.where("outer <> held"), subject, inner, "held").select(subject, "outer", "held", "fold")
    own = spread.where("outer = held").select(subject, "outer", "held", F.lit(-1).alias("fold"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("held", "fold"))), lambda x: x["fold"])
    return dealt.unionByName(own).groupBy(subject, F.col("outer").alias("fold")).agg(parts.alias("inner"))


def newton_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float, rounds: int = 50) -> np.ndarray:
    """Weighted L2 logistic regression with a free intercept; x is scaled first, the scaling is folded into the result."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd == 0, 1, sd)
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], 1.0 / c), 0.0)
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-10 * np.eye(len(beta)), z.T @ (w * (p - y)) + penalty * beta)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(beta[:-1] / sd, beta[-1] - (beta[:-1] * mean / sd).sum())


@dataclass(frozen=True)
class Task:
    """One fit of cross-validation: on rows outside the outer fold `held`, and outside the inner fold `inner` if given, with inverse strength c, on the features at the places `columns` (None: all)."""

    held: int
    inner: int | None
    param_idx: int
    c: float
    columns: tuple[int, ...] | None = None


def fit_tasks(rows: DataFrame, features: list[str], tasks: list[Task], squared_weights: bool = True, rounds: int = 50) -> list[np.ndarray]:
    """Coefficients with intercept of weighted L2 logistic regressions, all tasks together, on rows(y, fold, inner, features).

    Each round adds up every task's gradient and curvature over the partitions, a few numbers for each task, and the driver takes
    a Newton step; no task's rows are copied or gathered. Features are scaled by the task's own rows. A task with one class alone predicts that class, one without rows one half. All tasks
    have equally many features.
    """
    places = [list(t.columns) if t.columns is not None else list(range(len(features))) for t in tasks]
    width = len(places[0]) + 1
    data = rows.select("y", "fold", "inner", *features)

    def total(of) -> np.ndarray:
        """Sums over all rows of of(z, y, task number) for each task: matrices of `width` rows and width + 2 columns."""

        def run(batches):
            sums = np.zeros((len(tasks), width, width + 2))
            for pdf in batches:
                if len(pdf):
                    z = np.column_stack([pdf[features].to_numpy(float), np.ones(len(pdf))])
                    y, fold, inner = pdf["y"].to_numpy(float), pdf["fold"].to_numpy(), np.stack(pdf["inner"].to_numpy())
                    for k, t in enumerate(tasks):
                        own = (fold != t.held) & ((inner[:, t.held] != t.inner) if t.inner is not None else True)
                        sums[k] += of(z[own][:, [*places[k], -1]], y[own], k)
            yield pd.DataFrame({"at": np.arange(sums.size), "value": sums.ravel()})

        got = data.mapInPandas(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        out = np.zeros(len(tasks) * width * (width + 2))
        out[got["at"]] = got["value"]
        return out.reshape(len(tasks), width, width + 2)

    moments = total(lambda z, y, k: np.column_stack([z.T @ z, z.T @ y, np.zeros(width)]))
    n, positive = moments[:, -1, -3], moments[:, -1, -2]
    mean = moments[:, :-1, -3] / np.maximum(n, 1)[:, None]
    spread = np.sqrt(np.maximum(np.stack([np.diag(m)[:-1] for m in moments]) / np.maximum(n, 1)[:, None] - mean**2, 0))
    spread = np.where(spread < 1e-12, 1, spread)
    open_ = (positive > 0) & (positive < n)
    weight = np.stack([n / np.maximum(2 * (n - positive), 1), n / np.maximum(2 * positive, 1)], axis=1) ** (2 if squared_weights else 1)
    penalty = np.stack([np.append(np.full(width - 1, 1.0 / t.c), 0.0) for t in tasks])
    beta, moving = np.zeros((len(tasks), width)), open_.copy()

    def newton(z, y, k):
        if not moving[k]:
            return 0.0
        z = np.column_stack([(z[:, :-1] - mean[k]) / spread[k], z[:, -1]])
        p, w = 1 / (1 + np.exp(-np.clip(z @ beta[k], -35, 35))), np.where(y == 1, weight[k, 1], weight[k, 0])
        return np.column_stack([(z * (w * p * (1 - p))[:, None]).T @ z, z.T @ (w * (p - y)), np.zeros(width)])

    for _ in range(rounds):
        if not moving.any():
            break
        sums = total(newton)
        for k in np.flatnonzero(moving):
            step = np.linalg.solve(sums[k, :, :width] + np.diag(penalty[k]) + 1e-10 * np.eye(width), sums[k, :, width] + penalty[k] * beta[k])
            beta[k] -= step
            moving[k] = np.abs(step).max() >= 1e-9
    scale = beta[:, :-1] / spread
    raw = np.column_stack([scale, beta[:, -1] - (scale * mean).sum(axis=1)])
    constant = np.where(n == 0, 0.0, np.where(positive == 0, -35.0, 35.0))
    return [raw[k] if open_[k] else np.append(np.zeros(width - 1), constant[k]) for k in range(len(tasks))]


def score_tasks(rows: DataFrame, features: list[str], tasks: list[Task], betas: list[np.ndarray]) -> DataFrame:
    """(held, inner_held, param_idx, y, proba): the rows that each task leaves out, scored by its model; the small table of models is broadcast."""
    models = []
    for t, b in zip(tasks, betas, strict=True):
        full = np.zeros(len(features) + 1)
        full[[*(t.columns if t.columns is not None else range(len(features))), -1]] = b
        models.append((t.held, t.inner, t.param_idx, full.tolist()))
    table = rows.sparkSession.createDataFrame(models, "held int, inner_held int, param_idx int, beta array<double>")
    own = F.when(F.col("inner_held").isNull(), F.col("fold") == F.col("held")).otherwise((F.col("fold") != F.col("held")) & (F.get("inner", F.col("held")) == F.col("inner_held")))
    margin = sum((F.col(f).cast("double") * F.col("beta")[k] for k, f in enumerate(features)), F.col("beta")[len(features)])
    proba = 1 / (1 + F.exp(-F.greatest(F.least(margin, F.lit(35.0)), F.lit(-35.0))))
    return rows.crossJoin(F.broadcast(table)).where(own).select("held", "inner_held", "param_idx", "y", F.round(proba, 9).alias("proba"))


def _nested(rows: DataFrame, features: list[str], settings: list[tuple[float, tuple[int, ...] | None]], outer: int, inner: int) -> DataFrame:
    """(fold, param_idx, threshold, n, roc_auc, average_precision, f1) for rows(y, fold, inner, features) and settings (c, columns): the inner fits choose a setting by mean average precision and the
    threshold by the median of the best F1; a model refitted on the training part scores the outer fold."""
    tasks = [Task(k, i, j, c, columns) for k in range(outer) for i in range(inner) for j, (c, columns) in enumerate(settings)]
    by = ["held", "inner_held", "param_idx"]
    points = metrics.curve(score_tasks(rows, features, tasks, fit_tasks(rows, features, tasks)), "y", "proba", by).cache()
    ap = metrics.ranking(points, by).select(F.col("held").alias("fold"), "inner_held", "param_idx", F.col("average_precision").alias("score"))
    best = best_parameters(ap).select(F.col("fold").alias("held"), "param_idx")
    cut = metrics.best_f1(points, by).join(best, ["held", "param_idx"]).groupBy("held", "param_idx").agg(F.median("threshold").alias("threshold"))
    chosen = [(r.held, r.param_idx, r.threshold) for r in cut.collect()]  # one row for each outer fold
    final = [Task(held, None, j, *settings[j]) for held, j, _ in chosen]
    table = rows.sparkSession.createDataFrame(chosen, "held int, param_idx int, threshold double")
    scored = score_tasks(rows, features, final, fit_tasks(rows, features, final)).drop("param_idx")
    out = scored.join(F.broadcast(table), "held").withColumn("pred", (F.col("proba") >= F.col("threshold")).cast("int")).cache()
    counts = metrics.classification(metrics.confusion(out, "y", "pred", ["held"]), ["held"]).select("held", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), F.col("f1_1").alias("f1"))
    ranks = metrics.ranking(metrics.curve(out, "y", "proba", ["held"]), ["held"])
    return table.join(counts, "held").join(ranks, "held").select(F.col("held").alias("fold"), "param_idx", "threshold", "n", "roc_auc", "average_precision", "f1")


def nested_cv(windows: DataFrame, features: list[str], cs: list[float], outer: int = 3, inner: int = 2) -> DataFrame:
    """(fold, c, threshold, n, roc_auc, average_precision, f1) for each outer fold of windows(window_id, subject, y, features).

    Subjects are dealt to outer folds, and the training subjects of each to inner folds; c is chosen among `cs`, see _nested().
    """
    rows = windows.join(nested_folds(windows, "subject", outer, inner), "subject").select("y", "fold", "inner", *features).cache()
    table = windows.sparkSession.createDataFrame(list(enumerate(map(float, cs))), "param_idx int, c double")
    found = _nested(rows, features, [(c, None) for c in cs], outer, inner)
    return found.join(F.broadcast(table), "param_idx").select("fold", "c", "threshold", "n", "roc_auc", "average_precision", "f1")


def nested_cv_grid(windows: DataFrame, signal: str, grid: dict[str, list] | None = None, base: MvarConfig | None = None, outer: int = 5, inner: int = 3) -> DataFrame:
    """(fold, C, mvar_order, n_basis, regularization, threshold, n, roc_auc, average_precision, f1) for each outer fold of windows(subject, y, signal): the autoregression's own parameters are tuned with C.

    Each window is read once: the features of all orders, bases and penalties come from shared Gram matrices (see extract_grid()), and all fits of all settings run together.
    """
    grid, base = grid or FULL_GRID, base or MvarConfig()
    names = sorted(grid)
    settings = [dict(zip(names, values, strict=True)) for values in product(*(grid[n] for n in names))]
    shapes = [MvarConfig(s.get("mvar_order", base.order), s.get("n_basis", base.n_basis), base.basis, s.get("regularization", base.regularization), base.norm, base.n_time_points, base.upper_lags) for s in settings]
    configs = list(dict.fromkeys(shapes))
    featured, features = extract_grid(windows, signal, configs)
    width = len(features) // len(configs)
    rows = featured.join(nested_folds(windows, "subject", outer, inner), "subject").select("y", "fold", "inner", *features).cache()
    tuned = [(float(s.get("C", 1.0)), tuple(range(k * width, (k + 1) * width))) for s, k in ((s, configs.index(c)) for s, c in zip(settings, shapes, strict=True))]
    return _nested(rows, features, tuned, outer, inner).join(F.broadcast(parameter_grid(windows.sparkSession, grid)), "param_idx").select("fold", *names, "threshold", "n", "roc_auc", "average_precision", "f1")
