"""Small fixtures with results worked out by hand, and properties of the numeric core."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktide.config import STANDARD_CHANNELS, EngineConfig
from sparktide.functions import channels, clock
from sparktide.operators import baselines, classifiers, coverage, intervals, metrics, mvar, smoothing, splits, validation
from sparktide.sources import annotations, artifacts, recordings
from sparktide.streaming import segments


def test_clock(spark):
    rows = spark.createDataFrame([("16.49.25",), ("16:49.25",), ("16:49:25",), ("at 1 6.49.25",), (None,)], "t string")
    assert [r.s for r in rows.select(clock.clock_seconds(F.col("t")).alias("s")).collect()] == [60565, 60565, None, 60565, None]
    d = spark.createDataFrame([(100, 86000), (5, 3), (200000, 3)], "a int, b int")
    assert [r[0] for r in d.select(clock.wrapped_difference(F.col("a"), F.col("b"))).collect()] == [500, 2, 199997]
    assert spark.range(1).select(clock.to_samples(F.lit(0.5), 5), clock.rate_hz(F.lit("Sampling Rate: 512 Hz")), clock.after_colon(F.lit("a: b:c "))).first()[:] == (2, 512.0, "b:c")


def test_channels(spark):
    one = spark.range(1)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("A", 1), ("B", 2), ("A", 3))])
    got = one.select(channels.normalised_name(F.lit(" EEG fp1 ")), channels.reordered(entries, ["B", "X", "A"]), channels.has_all(F.array(F.lit("A"), F.lit("B")), ["B"])).first()
    assert got[0] == "FP1" and got[1] == [2, None, 3] and got[2]
    m = channels.as_matrix(F.array(*[F.lit(float(k)) for k in range(6)]).cast("array<float>"), 2, 3)
    got = one.select(channels.harmonised(m, 3, 3), channels.harmonised(m, 1, 3), channels.transposed(m, 3), channels.window_slice(m, F.lit(1), 2)).first()
    assert got[0] == [[0, 1, 2], [3, 4, 5], [0, 0, 0]] and got[1] == [[0, 1, 2]] and got[2] == [[0, 3], [1, 4], [2, 5]] and got[3] == [[1, 2], [4, 5]]
    assert len(STANDARD_CHANNELS) == 18 and EngineConfig().order == 3


def test_intervals(spark):
    rec = spark.createDataFrame([(1, 45), (2, 10), (3, 3)], "k int, n long")
    seiz = spark.createDataFrame([(1, 10, 20), (1, 15, 30), (1, 40, 41)], "k int, begin long, end long")
    for width in (None, 1, 12):
        free = intervals.gaps(seiz, rec, ["k"], "n", 4, width)
        assert sorted(map(tuple, free.collect())) == [(1, 0, 10), (1, 30, 40), (1, 41, 45), (2, 0, 10)]
    assert sorted((r.begin, r.w) for r in free.where("k = 1").withColumn("w", intervals.windows_per_interval(4, 4)).collect()) == [(0, 2), (30, 2), (41, 1)]
    assert intervals.windows_in_intervals(free.where("k = 1"), 4, 4).count() == 5
    starts = intervals.hop_starts(rec, "n", 4, 3)
    assert sorted(r.start for r in starts.where("k = 2").collect()) == [0, 3, 6] and starts.where("k = 3").count() == 0
    w = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "k int, start long")
    i = spark.createDataFrame([(1, 4, 6), (2, 3, 5)], "k int, begin long, end long")
    assert sorted((r.k, r.label) for r in intervals.label_by_overlap(w, i, ["k"], 2, 2).collect()) == [(1, 0), (2, 1), (3, 0)]


@pytest.mark.parametrize("size,width", [(5, 65536), (4, 65536), (5, 2), (4, 3)])
def test_smoothing(spark, size, width):
    rows = spark.createDataFrame([(10 * k, "s", p) for k, p in enumerate([0, 1, 0, 1, 1, 0, 0])], "id long, s string, p int")
    for by in (None, ["s"]):
        assert [r.smoothed for r in smoothing.smooth(rows, "id", "p", size, by=by, width=width).orderBy("id").collect()] == [0, 1, 1, 1, 0, 1, 0]


def test_splits(spark):
    rates = spark.createDataFrame([(c, k / 10) for k, c in enumerate("abcdef")], "s string, rate double")
    split = splits.stratified_subject_split(rates, "s", 0.4)
    assert {r.s for r in split.where("split = 'test'").collect()} == {"a", "d"}
    assert splits.leakage(split, "s").count() == 0
    assert splits.stratified_subject_split(rates.limit(0), "s", 0.4).count() == 0
    assert splits.greedy_group_folds([("a", 5), ("b", 4), ("c", 3), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    rows = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(300)], "id long, y int")
    ranked = splits.random_rank(rows, ["y"], "id", 1).collect()
    assert sorted(r["rank"] for r in ranked if r.y == 1) == list(range(1, 31))
    assert splits.undersample(rows, "y", "id", 1).groupBy("y").count().collect() and splits.undersample(rows, "y", "id", 1).count() == 60
    assert {r["count"] for r in splits.oversample(rows, "y", "id", 1).groupBy("y").count().collect()} == {270}


def test_metrics(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 30, 200) / 10.0 - 1
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    got = metrics.ranking(metrics.curve(df, "y", "s")).first()
    p, n = s[y == 1], s[y == 0]
    assert got.roc_auc == pytest.approx(np.mean([(a > n).mean() + (a == n).mean() / 2 for a in p]))
    cuts = np.unique(s)[::-1]
    recall = np.array([(p >= c).mean() for c in cuts])
    precision = np.array([(y[s >= c] == 1).mean() for c in cuts])
    assert got.average_precision == pytest.approx(np.sum(np.diff(np.concatenate(([0], recall))) * precision))
    assert metrics.ranking(metrics.curve(df.where("y = 1"), "y", "s")).first().roc_auc is None
    tie = spark.createDataFrame([("a", 0, 1, 0.5), ("a", 1, 1, 0.5)], "g string, y int, p int, s double")
    assert metrics.by_subject(tie, "g", "y", "p", None).first()[:] == ("a", 0, 1)
    assert metrics.best_f1(metrics.curve(df.where("y = 0"), "y", "s")).first().threshold == 0.5


def test_basis():
    t = np.array([0, 0.5, 1])
    assert mvar.basis_matrix(t, 3, "polynomial").tolist() == [[1, -1, 1], [1, 0, 0], [1, 1, 1]]
    assert np.allclose(mvar.basis_matrix([0.5], 4, "bspline"), [[0.125, 0.375, 0.375, 0.125]])
    assert np.allclose(mvar.basis_matrix(np.linspace(0, 1, 101), 10, "bspline").sum(axis=1), 1)
    with pytest.raises(ValueError):
        mvar.basis_matrix(t, 3, "bspline")
    with pytest.raises(ValueError):
        mvar.basis_matrix(t, 3, "other")
    assert list(mvar.MvarConfig(order=3).lags()) == [1, 2] and list(mvar.MvarConfig(order=1).lags()) == [0]


def test_autoregression(spark):
    rng = np.random.default_rng(2)
    c = mvar.MvarConfig(order=2, n_basis=5)
    x = rng.normal(size=(3, 80))
    w = mvar.fit_window(x, c)
    wide = mvar.fit_window(x[:, :20], c)  # more columns than rows: the dual form
    z = (x[:, :20] - x[:, :20].mean(axis=1, keepdims=True)) / x[:, :20].std(axis=1, keepdims=True)
    phi = mvar.basis_matrix(np.linspace(0, 1, 20), 5, "bspline")[2:]
    design = np.concatenate([np.einsum("ct,tk->tck", z[:, 2 - j : 20 - j], phi).reshape(18, -1) for j in (1, 2)], axis=1)
    primal = np.linalg.solve(design.T @ design + 0.1 * np.eye(30), design.T @ z[:, 2:].T).reshape(2, 3, 5, 3).transpose(0, 3, 1, 2)
    assert np.allclose(wide, primal)
    path = np.einsum("labk,mk->lmab", w, mvar.basis_matrix(np.linspace(0, 1, 50), 5, "bspline"))
    for norm, order in (("fro", "fro"), ("spectral", 2)):
        naive = [max(np.linalg.norm(lag[i] - lag[j], order) for i in range(50) for j in range(i)) for lag in path]
        assert np.allclose(mvar.lag_variation(w, c, norm), naive)
    one = mvar.MvarConfig(order=1, n_basis=2, basis="polynomial")
    series = spark.createDataFrame([(0, [float(v) for v in rng.normal(size=64)])], "id long, v array<double>")
    closed = mvar.closed_form_variation(mvar.standardised(mvar.long_form(series, "id", "v", 64), "id"), "id", 64, 0.1).first().variation
    got = mvar.extract(series.withColumn("signal", F.array("v")), "signal", one).first().S
    assert got == pytest.approx(closed)
    assert len(mvar.vector_feature(x, c, per_lag=True)) == len(mvar.feature_names(c, per_lag=True))


def test_classifiers(spark):
    rows = spark.createDataFrame([(float(k), int(k >= 6)) for k in range(10)], "f double, y int")
    model = classifiers.fit_threshold(rows, "f", "y")
    scored = classifiers.predict_threshold(rows, "f", model).collect()
    assert all(r.pred == r.y for r in scored)
    at = spark.createDataFrame([(3.0, 1.0, 7.0, True, 3.0)], "f double, m0 double, m1 double, ascending boolean, thr double")
    got = classifiers.predict_threshold(at.select("f"), "f", at.drop("f")).first()
    assert got.pred == 0 and got.proba == pytest.approx(2 / 6)
    x, y = np.random.default_rng(3).normal(size=(80, 2)), np.arange(80) % 2
    beta = validation.newton_logistic(x, y, np.ones(80), 1.0)
    df = spark.createDataFrame([(float(a), float(b), int(c), 1.0) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int, w double")
    m = classifiers.logistic(classifiers.scaled(df, ["a", "b"]), ["a", "b"], "y", "w").stages[-1]
    assert np.allclose(m.coefficients.toArray(), beta[:-1] * x.std(axis=0), atol=1e-4)
    errors = baselines.run_methods(["rocket", "nothing"], lambda kind: 1.0, spark).collect()
    assert errors[0].accuracy == 1.0 and errors[1].error.startswith("KeyError")


def test_annotations(spark, tmp_path):
    text = "Sampling Rate: 256 Hz\nFile name: a.edf\nRegistration start time: 23.00.00\nRegistration end time: 01.00.00\nSeizure start time: 23.30.00\nSeizure end time: 00:10.00\nFile name: b.edf\nSeizure start time: 1.0.0\nSeizure end time: 1.0.5\nRegistration start time: 1.0.0\nRegistration end time: 2.0.0\nChannel 1: Fp1\nChannel 2: EKG\nChannel 3: 1\n"
    (tmp_path / "list.txt").write_text(text)
    lines = annotations.read_lines(spark, str(tmp_path))
    first = ("a.edf", 7200.0, 1800.0, 4200.0, 256.0)
    assert [tuple(r)[1:] for r in annotations.blocks(lines, ["file"], ["line"], "text").collect()][0] == first
    assert [tuple(r)[1:] for r in annotations.blocks_exact(lines, "file", "line", "text").collect()] == [first, ("b.edf", 3600.0, 0.0, 5.0, 256.0)]
    whole = spark.createDataFrame([("f", text)], "file string, text string")
    assert [r.channel for r in annotations.channel_names(whole, ["file"], "text").collect()] == ["Fp1"]
    pairs = annotations.start_end_pairs(lines, ["file"], "line", "text").collect()
    assert [(r.start_s, r.end_s) for r in pairs] == [(3600, 3605)]  # the first one ends before it starts


def edf(path, labels, rate, records, values):
    ns = len(labels)
    pad = lambda x, n: str(x).ljust(n).encode()
    head = pad(0, 8) + pad("p", 80) + pad("r", 80) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(256 * (ns + 1), 8) + pad("", 44) + pad(records, 8) + pad(1, 8) + pad(ns, 4)
    for value, width in ((None, 16), ("", 80), ("uV", 8), (-100, 8), (100, 8), (-32768, 8), (32767, 8), ("", 80), (rate, 8), ("", 32)):
        head += b"".join(pad(x if value is None else value, width) for x in labels)
    digital = np.round((values + 100) / 200 * 65535 - 32768).astype("<i2")
    path.write_bytes(head + b"".join(digital[:, r * rate : (r + 1) * rate].tobytes() for r in range(records)))


def test_recordings(spark, tmp_path):
    t = np.arange(512) / 128
    values = np.stack([50 * np.sin(2 * np.pi * 3 * t), 20 * np.cos(2 * np.pi * 5 * t)])
    edf(tmp_path / "a.edf", ["EEG Fp1", "EEG Fp2"], 128, 4, values)
    files = recordings.discover(spark, str(tmp_path))
    h = recordings.headers(files).first()
    assert (h.sfreq, h.n_samples, h.channels) == (128.0, 512, ["EEG Fp1", "EEG Fp2"])
    s = recordings.signals(files, 256.0).first()
    want = 50 * np.sin(2 * np.pi * 3 * np.arange(1024) / 256)
    assert len(s.signal[0]) == 1024 and np.allclose(s.signal[0], want, atol=0.01)
    assert len(recordings.signals(files, 64.0).first().signal[1]) == 256


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 3, k % 2, "test" if k % 3 == 0 else "train") for k in range(12)], "id long, subject long, y int, split string")
    artifacts.write_windows(rows, str(tmp_path / "w"))
    test = artifacts.read_windows(spark, str(tmp_path / "w"), "test")
    assert test.count() == 4 and "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().toString()
    m = artifacts.manifest(rows, 256.0, 4)
    assert (m.first().n_train, m.first().train_class_1, m.first().n_subjects_test) == (8, 4, 1)
    artifacts.write_json(m.withColumn("x", F.lit(float("nan"))), str(tmp_path / "m"))
    assert artifacts.read_manifest(spark, str(tmp_path / "m"), "n_train long, x double").first()[:] == (8, None)
    (tmp_path / "s.csv").write_text(" patient_id , eeg_channel\nPN00, 29\nPN01,30\n")
    assert [r.subject for r in artifacts.valid_subjects(spark, str(tmp_path / "s.csv")).collect()] == ["PN00"] and artifacts.valid_subjects(spark, None) is None
    held = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "u int, c string")
    assert [tuple(r) for r in coverage.missing_channels(held, ["u"], "c").collect()] == [(2, "b")]


def test_streams(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' + id * INTERVAL 20 MINUTES AS ts, id % 2 AS user_id, if(id = 7, 'error', 'view') AS event_type FROM range(60)").write.parquet(str(tmp_path / "e"))
    stream = segments.event_stream(spark, str(tmp_path / "e"), schema)
    for name, df in (("hops", segments.hop_rates(stream)), ("talks", segments.sessions(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("hops").where("label = 1").select("user_id").distinct().collect()[0][0] == 1 and spark.table("talks").count() > 0
    spark.createDataFrame([(1, k, p) for k, p in enumerate([0, 1, 1, 0, 0])], "subject long, idx long, pred int").coalesce(1).write.parquet(str(tmp_path / "p"))
    preds = spark.readStream.schema("subject long, idx long, pred int").parquet(str(tmp_path / "p"))
    segments.smooth_stream(preds, 3).writeStream.format("memory").queryName("smooth").outputMode("append").option("checkpointLocation", str(tmp_path / "c-s")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.smoothed for r in spark.table("smooth").orderBy("idx").collect()] == [0, 1, 1, 1, 0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_medians_and_thresholds(spark):
    """Exact medians by bins and threshold counts by places, against plain loops, with ties, nulls and one value alone."""
    rng = np.random.default_rng(6)
    for values in (rng.normal(size=301), np.round(rng.normal(size=200), 1), np.full(9, 2.5), np.concatenate([np.zeros(150), [1e9]])):
        for flip in (1, -1):
            y = rng.integers(0, 2, len(values))
            x = values + flip * y * 0.5
            rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)] + [(None, 0)], "f double, y int")
            got = classifiers.class_medians(rows, "f", "y", bins=16).first()
            assert (got.m0, got.m1) == pytest.approx((np.median(x[y == 0]), np.median(x[y == 1])))
            medians = classifiers.class_medians(rows, "f", "y")
            for r in classifiers.threshold_counts(rows, "f", "y", medians, 20).collect():
                p = x > r.thr if got.ascending else x < r.thr
                assert (r.tp, r.fp, r.fn, r.tn) == ((p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum(), (~p & (y == 0)).sum())
    empty = spark.createDataFrame([], "f double, y int")
    assert classifiers.class_medians(empty, "f", "y").first()[:] == (None, None, False) and classifiers.threshold_counts(empty, "f", "y", classifiers.class_medians(empty, "f", "y")).count() == 0


def test_scaling_ignores_test_rows(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "a double")
    for other in (5.0, 500.0):
        rows = train.union(spark.createDataFrame([(other,)], "a double"))
        assert sorted(r.a for r in classifiers.scaled(rows, ["a"], train).collect())[:2] == [-1.0, 1.0]


def test_nested_fits(spark):
    """All tasks' models at once, against one fit after the other on each task's own rows."""
    rng = np.random.default_rng(8)
    x, subject = rng.normal(size=(240, 2)) * [1, 20], np.arange(240) % 12
    y = (x[:, 0] + rng.normal(size=240) > 0).astype(int)
    rows = spark.createDataFrame([(int(s), int(b), float(u), float(v)) for s, b, (u, v) in zip(subject, y, x, strict=True)], "subject long, y int, a double, b double")
    folds = validation.nested_folds(rows, "subject", 3, 2)
    held = {r.subject: (r.fold, r.inner) for r in folds.collect()}
    assert all(inner[fold] == -1 and set(inner) == {-1, 0, 1} or len(set(inner)) == 2 for fold, inner in held.values())
    tasks = [validation.Task(k, i, j, c) for k in range(3) for i in (0, 1, None) for j, c in enumerate((0.1, 1.0))]
    joined = rows.join(folds, "subject").repartition(3)
    for task, beta in zip(tasks, validation.fit_tasks(joined, ["a", "b"], tasks), strict=True):
        own = np.array([held[s][0] != task.held and (task.inner is None or held[s][1][task.held] != task.inner) for s in subject])
        n, p = own.sum(), y[own].sum()
        w = np.where(y[own] == 1, n / (2 * p), n / (2 * (n - p))) ** 2
        assert np.allclose(beta, validation.newton_logistic(x[own], y[own].astype(float), w, task.c), atol=1e-6)
    result = validation.nested_cv(rows.withColumn("window_id", F.monotonically_increasing_id()), ["a", "b"], [0.1, 1.0]).collect()
    assert sum(r.n for r in result) == 240 and all(r.roc_auc > 0.7 for r in result)


def test_learned_shapelets(spark):
    rng = np.random.default_rng(9)
    bump, rows = np.array([0, 2, 4, 4, 4, 4, 2, 0.0]), []
    for k in range(80):
        v = rng.normal(size=48) * 0.1
        if k % 2:
            at = rng.integers(40)
            v[at : at + 8] += bump
        rows.append((k, k % 2, v.tolist()))
    train = spark.createDataFrame(rows, "id long, y int, v array<double>")
    shapes = baselines.learn_shapelets(train, "v", "y", "id")
    scored = train.select("y", baselines.shapelet_distance(F.col("v"), shapes[0]).alias("d")).groupBy("y").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).orderBy("y").collect()
    assert len(shapes) == 6 and (scored[0].lo > scored[1].hi or scored[1].lo > scored[0].hi or max(shapes[0]) > 1)
    assert {"stsf", "timeseriesforest", "canonicalintervalforest"} <= set(baselines.METHODS)
