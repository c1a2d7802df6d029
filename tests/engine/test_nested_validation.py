"""Group folds without a deal group by group, and nested validation over the autoregression's parameters, against plain loops."""

import hashlib
import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from sparktide.operators import mvar, splits, validation


def test_deal_equals_the_sequential_one():
    r = random.Random(1)
    for _ in range(300):
        folds = r.randint(1, 6)
        histogram = [(n, r.randint(1, r.choice([1, 3, 40]))) for n in r.sample(range(1, r.choice([6, 30, 1000])), r.randint(1, 5))]
        load, want = [0] * folds, {}
        for n, groups in sorted(histogram, reverse=True):
            for rank in range(groups):
                k = load.index(min(load))
                want[n, rank] = k
                load[k] += n
        got = {(n, rank): cycle[(rank - first) % len(cycle)] for n, first, end, cycle in validation.deal_pieces(histogram, folds) for rank in range(first, end)}
        assert got == want
    assert len(validation.deal_pieces([(7, 3), (2, 5), (1, 2_000_000_000)], 5)) <= 15


def test_group_folds(spark):
    r = random.Random(2)
    rows = [(None if k == 0 else f"s{k}",) for k in range(200) for _ in range(r.choice([1, 1, 2, 2, 3, 9, 60]))]
    table = spark.createDataFrame(rows, "subject string").repartition(3)
    found = {x.subject: (x.fold, x.inner) for x in validation.nested_folds(table, "subject", 4, 3).collect()}
    counts = {s: sum(x[0] == s for x in rows) for s in {x[0] for x in rows}}
    order = lambda s: (-counts[s], hashlib.md5(f"42-{'=' + s if s is not None else ''}".encode()).hexdigest())

    def deal(subjects, folds):
        load, out = [0] * folds, {}
        for s in sorted(subjects, key=order):
            k = load.index(min(load))
            out[s], load[k] = k, load[k] + counts[s]
        return out

    outer = deal(counts, 4)
    inner = [deal([s for s in counts if outer[s] != k], 3) for k in range(4)]
    assert found == {s: (outer[s], [part.get(s, -1) for part in inner]) for s in counts}
    assert validation.nested_folds(table.where("false"), "subject", 4, 3).count() == 0


def test_many_subjects_are_dealt(spark):
    dealt = validation.group_folds(spark.range(1_200_000).select(F.col("id").alias("subject"), (1 + F.col("id") % 3).alias("n")), "subject", 5)
    loads = dealt.groupBy("fold").agg(F.sum("n").alias("rows"), F.count("*").alias("subjects")).collect()
    assert len(loads) == 5 and sum(x.subjects for x in loads) == 1_200_000 and max(x.rows for x in loads) - min(x.rows for x in loads) <= 3


def test_grid_features_equal_single_fits():
    r = np.random.default_rng(3)
    for p, n in ((2, 80), (4, 20)):  # more rows than columns, and fewer
        signal = r.normal(size=(p, n)).cumsum(axis=1)
        configs = [mvar.MvarConfig(order, k, kind, alpha, n_time_points=8) for order, k, kind, alpha in product((2, 3), (5, 10), ("bspline", "polynomial"), (0.1, 1.0, 0.0))]
        for c, w in zip(configs, mvar.fit_grid(signal, configs), strict=True):
            want = mvar.fit_window(signal, c)
            assert np.allclose(w, want, atol=1e-6 * max(1, np.abs(want).max())), c
            assert np.allclose(mvar.coefficient_features(w, c), mvar.vector_feature(signal, c), rtol=1e-5)


def plain_average_precision(y, score):
    total = hits = 0
    out, seen = 0.0, 0
    for s in sorted(set(score), reverse=True):
        own = [b for a, b in zip(score, y, strict=True) if a == s]
        hits += sum(own)
        seen += len(own)
        out += sum(own) / max(sum(y), 1) * hits / seen
        total += 1
    return out


def plain_best_threshold(y, score):
    best = (-1.0, 0.0)
    for s in set(score):
        tp = sum(b for a, b in zip(score, y, strict=True) if a >= s)
        f1 = 2 * tp / (sum(a >= s for a in score) + sum(y))
        best = max(best, (f1, -s))
    return -best[1] if sum(y) else 0.5


def test_nested_grid(spark):
    r = np.random.default_rng(4)
    rows = []
    for k in range(72):
        y = int(r.random() < 0.5)
        x = r.normal(size=(2, 40))
        if y:
            x[0, 1:] += 0.8 * np.linspace(-1, 1, 39) * x[0, :-1]
        rows.append((k, k % 9, y, x.tolist()))
    table = spark.createDataFrame(rows, "window_id long, subject long, y int, signal array<array<double>>").repartition(2)
    base = mvar.MvarConfig(n_time_points=6)
    got = {x.fold: x for x in validation.nested_cv_grid(table, "signal", None, base, 3, 2).collect()}
    held = {x.subject: (x.fold, x.inner) for x in validation.nested_folds(table, "subject", 3, 2).collect()}
    grid = [dict(zip(sorted(validation.FULL_GRID), v, strict=True)) for v in product(*(validation.FULL_GRID[n] for n in sorted(validation.FULL_GRID)))]
    assert len(grid) == 16
    y, subject = np.array([x[2] for x in rows]), [x[1] for x in rows]
    data = {}
    for g in grid:
        c = mvar.MvarConfig(g["mvar_order"], g["n_basis"], "bspline", g["regularization"], n_time_points=6)
        data[tuple(g.values())] = np.array([mvar.vector_feature(np.array(x[3]), c) for x in rows])

    def scores(g, train, test):
        x, n, p = data[tuple(g.values())], train.sum(), y[train].sum()
        w = np.where(y[train] == 1, n / (2 * p), n / (2 * (n - p))) ** 2
        beta = validation.newton_logistic(x[train], y[train].astype(float), w, g["C"])
        return np.round(1 / (1 + np.exp(-(x[test] @ beta[:-1] + beta[-1]))), 9).tolist()

    for k in range(3):
        outside = np.array([held[s][0] != k for s in subject])
        results = []
        for g in grid:
            ap, cuts = [], []
            for i in range(2):
                inner = np.array([held[s][1][k] == i for s in subject])
                z = scores(g, outside & ~inner, inner)
                ap.append(plain_average_precision(y[inner].tolist(), z))
                cuts.append(plain_best_threshold(y[inner].tolist(), z))
            results.append((np.mean(ap), cuts))
        best = max(range(16), key=lambda j: round(results[j][0], 12))
        x = got[k]
        assert [x[n] for n in sorted(validation.FULL_GRID)] == list(grid[best].values())
        assert abs(x.threshold - np.median(results[best][1])) < 1e-6 and x.n == (~outside).sum()
        z = scores(grid[best], outside, ~outside)
        assert abs(x.average_precision - plain_average_precision(y[~outside].tolist(), z)) < 1e-6


def test_sequential_deal_of_small_tables():
    assert splits.greedy_group_folds([("a", 5), ("b", 4), ("c", 3), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
