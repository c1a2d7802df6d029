"""The whole way from written recordings to results."""

from xml.etree import ElementTree

import numpy as np

from sparktide import __main__ as command
from sparktide.config import EngineConfig
from sparktide.operators import metrics
from sparktide.plans import pipeline
from sparktide.sources import recordings, reports

from .test_engine import edf


def test_pipeline(spark, tmp_path):
    rng, names = np.random.default_rng(4), ["EEG Fp1", "EEG Fp2", "EKG"]
    for k in range(4):
        (tmp_path / "r" / f"PN0{k}").mkdir(parents=True)
        x = rng.normal(size=(3, 32 * 40)) * 10
        x[:, 32 * 10 : 32 * 20] = np.cumsum(rng.normal(size=(3, 320)), axis=1)  # another process during the episode
        edf(tmp_path / "r" / f"PN0{k}" / "a.edf", names, 32, 40, x)
        text = "File name: a.edf\nRegistration start time: 10.00.00\nRegistration end time: 10.00.40\n"
        text += "Seizure start time: 10.00.10\nSeizure end time: 10.00.20\n" if k < 3 else ""
        (tmp_path / "r" / f"PN0{k}" / f"Seizures-list-PN0{k}.txt").write_text(text)
    config = EngineConfig(sample_rate=32.0, order=2, n_basis=4, n_time_points=10, n_grid_points=20, test_size=0.5)
    windows = pipeline.build_windows(spark, str(tmp_path / "r"), config, ("FP1", "FP2"))
    got = windows.groupBy("subject").agg({"y": "sum", "*": "count"}).orderBy("subject").collect()
    assert [(r[0], r["sum(y)"], r["count(1)"]) for r in got] == [("PN00", 5, 20), ("PN01", 5, 20), ("PN02", 5, 20), ("PN03", 0, 20)]
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence" in plan and "signal" not in "".join(x for x in plan.split("\n") if "Generate" in x) and "content" not in "".join(x for x in plan.split("\n") if "Generate" in x)
    (tmp_path / "r" / "PN00" / "broken.edf").write_text("not a recording")
    files = recordings.discover(spark, str(tmp_path / "r"))
    good, bad = pipeline.checked_recordings(files, ("FP1", "FP2"))
    assert good.count() == 4 and [r.reason.split(":")[0] for r in bad.collect()] == ["ValueError"] and pipeline.checked_recordings(files, ("FP1", "O2"))[1].count() == 5
    first = windows.first().signal
    assert len(first) == 2 and len(first[0]) == 64
    assert pipeline.build_windows(spark, str(tmp_path / "r"), config, ("FP1", "O2")).count() == 0
    manifest = pipeline.prepare(spark, str(tmp_path / "r"), str(tmp_path / "o"), config, ("FP1", "FP2")).first()
    assert manifest.n_train == manifest.n_test == 40 and manifest.test_class_1 > 0
    assert pipeline.limit_classes(windows, negative_ratio=1.0).count() == 30 and pipeline.limit_classes(windows, max_negative=7, max_positive=4).count() == 11
    flags = ["--out", str(tmp_path / "o"), "--sample-rate", "32", "--order", "2", "--n-basis", "4", "--n-time-points", "10", "--n-grid-points", "20", "--folds", "2", "--balance", "undersample"]
    command.main(["train", *flags])
    levels = {r.level: r for r in spark.read.json(str(tmp_path / "o" / "evaluation")).collect()}
    assert set(levels) == {"window", "subject_majority", "subject_mean_proba"} and levels["window"].tp + levels["window"].fn + levels["window"].fp + levels["window"].tn == 40
    assert spark.read.parquet(str(tmp_path / "o" / "model")).count() == 1
    figures = tmp_path / "o" / "figures"
    for name, tag in (("roc.svg", "polyline"), ("precision_recall.svg", "polyline"), ("confusion.svg", "rect")):
        root = ElementTree.fromstring((figures / name).read_text())
        assert root.findall(f"{{http://www.w3.org/2000/svg}}{tag}")
    assert "subject_majority" in (figures / "report.txt").read_text() and "subjects on both sides: 0" in (tmp_path / "o" / "splits.txt").read_text()
    command.main(["validate", *flags])
    assert spark.read.json(str(tmp_path / "o" / "folds")).count() == 2 and spark.read.json(str(tmp_path / "o" / "summary")).count() == 6


def test_figures(spark):
    """A thinned curve keeps to the whole one; single classes and empty tables have figures too."""
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 20_000)
    p = np.round(np.clip(0.5 + 0.2 * (2 * y - 1) + 0.2 * rng.normal(size=len(y)), 0, 1), 6)
    scored = spark.createDataFrame([(int(a), float(b), int(b >= 0.5)) for a, b in zip(y, p, strict=True)], "y int, proba double, pred int")
    line = reports.thinned(metrics.roc_points(metrics.curve(scored, "y", "proba")), "fpr", "tpr")
    assert len(line) <= 2 * (reports.STEPS + 1)
    for t in (0.2, 0.5, 0.8):
        fpr, tpr = (p[y == 0] >= t).mean(), (p[y == 1] >= t).mean()
        assert abs(np.interp(fpr, [a for a, _ in line], [b for _, b in line]) - tpr) < 0.01
    auc = metrics.ranking(metrics.curve(scored, "y", "proba")).first().roc_auc
    assert f"area {auc:.3f}" in reports.roc_figure(scored) and str(int(((p >= 0.5) & (y == 1)).sum())) in reports.confusion_figure(scored)
    for part in (scored.where("y = 1"), scored.where("false")):
        assert "undefined" in reports.roc_figure(part) and reports.precision_recall_figure(part) and reports.confusion_figure(part)
