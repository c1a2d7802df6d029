"""Recordings read in ranges of records, dead letters of headers and bodies, versions and the run log."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktide import __main__ as command
from sparktide.config import EngineConfig, Paths
from sparktide.plans import pipeline
from sparktide.sources import artifacts, recordings

from .test_engine import edf


def subject(folder, name, file, rate, seconds, seed=1, seizure=(10, 20)):
    rng = np.random.default_rng(seed)
    (folder / name).mkdir(parents=True, exist_ok=True)
    t = np.arange(rate * seconds) / rate
    x = np.stack([30 * np.sin(2 * np.pi * (1.5 + k) * t + k) + rng.normal(size=len(t)) for k in range(3)])
    edf(folder / name / file, ["EEG Fp1", "EEG Fp2", "EKG"], rate, seconds, x)
    text = f"File name: {file}\nRegistration start time: 10.00.00\nRegistration end time: 10.02.00\n"
    text += f"Seizure start time: 10.00.{seizure[0]}\nSeizure end time: 10.00.{seizure[1]}\n" if seizure else ""
    (folder / name / f"Seizures-list-{name}.txt").write_text(text)


@pytest.mark.parametrize("rate", [32.0, 16.0, 48.0])
def test_ranges_equal_whole_recordings(spark, tmp_path, monkeypatch, rate):
    monkeypatch.setattr(recordings, "BLOCK_SEC", 7.0)
    subject(tmp_path, "PN 01", "a b+c%20.edf", 32, 120)  # blanks and signs in the path
    files = recordings.discover(spark, str(tmp_path))
    head = recordings.headers(files).first()
    assert head.error is None and head.n_samples == 32 * 120
    whole = dict(zip(*recordings.decoded((tmp_path / "PN 01" / "a b+c%20.edf").read_bytes(), rate), strict=True))
    n = int(2 * rate)
    hops = files.select("path", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("k")).select("path", (F.col("k") * n).alias("start"), (F.col("k") % 2).alias("label"))
    found = recordings.windows(hops, ("FP2", "FP1"), n, rate)
    plan = found._jdf.queryExecution().toString()
    assert "content" not in plan.split("Physical Plan")[1].replace("binaryFile", "")
    got = found.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 60 and len({g.task for g in got}) > 1 and all(g.error is None and g.label == g.start // n % 2 for g in got)
    for g in got:
        want = np.stack([whole["EEG Fp2"], whole["EEG Fp1"]])[:, g.start : g.start + n]
        edge = g.start < 5 * rate or g.start > 115 * rate  # a whole recording's spectrum joins its ends, a range's doesn't
        assert np.abs(np.array(g.signal) - want).max() < (1e-5 if rate == 32.0 else 3.0 if edge else 0.15)


def test_bad_bodies_are_dead_letters(spark, tmp_path):
    raw = tmp_path / "r"
    for k in range(3):
        subject(raw, f"PN0{k}", "a.edf", 32, 40, k)
    cut = raw / "PN00" / "a.edf"
    cut.write_bytes(cut.read_bytes()[:-4001])  # in the midst of a record, an odd number of bytes
    head = bytearray((raw / "PN01" / "a.edf").read_bytes())
    head[256 + 3 * 120 : 256 + 3 * 120 + 8] = head[256 + 3 * 128 : 256 + 3 * 128 + 8]  # no digital range
    (raw / "PN01" / "flat.edf").write_bytes(head)
    (raw / "PN01" / "broken.edf").write_text("not a recording")
    config = EngineConfig(sample_rate=32.0, test_size=0.4)
    table = pipeline.prepare(spark, str(raw), str(tmp_path / "o"), config, ("FP1", "FP2")).first()
    assert table.n_train + table.n_test == 20 * 3 - (4001 // 192 + 1) // 2 - (4001 // 192 + 1) % 2 or table.n_train + table.n_test > 40
    letters = {r.path.rsplit("/", 2)[1] + "/" + r.path.rsplit("/", 1)[1]: r.reason for r in spark.read.json(str(tmp_path / "o" / "dead_letters")).collect()}
    assert set(letters) == {"PN00/a.edf", "PN01/flat.edf", "PN01/broken.edf"} and letters["PN00/a.edf"].startswith("truncated: ") and "digital range" in letters["PN01/flat.edf"]
    log = {r.stage: r for r in spark.read.json(str(tmp_path / "o" / "log")).collect()}
    assert set(log) == {"decode", "dead_letters", "windows", "manifest"} and log["decode"].details.errors == "3" and log["windows"].rows == table.n_train + table.n_test
    assert int(log["windows"].details.train) == table.n_train and all(x.error is None for x in log.values())
    assert table.channel_names == ["FP1", "FP2"] and table.n_samples_per_window == 64 and table.x_test.endswith("windows/split=test") and table.train_per_class is None and len(table.asDict()) >= 27
    index = spark.read.parquet(table.subject_windows_train).groupBy("subject").agg(F.max("pos").alias("last"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in index) == table.n_train and all(r.last == r.n - 1 for r in index)
    gone = recordings.windows(spark.createDataFrame([(f"file:{raw}/PN00/none.edf", 0, 1), (f"file:{raw}/PN02/a.edf", 0, 1), (f"file:{raw}/PN02/a.edf", 10**6, 1)], "path string, start long, label int"), ("FP1",), 64, 32.0).collect()
    assert sorted((r.error or "")[:10] for r in gone) == ["", "FileNotFou", "ValueError"]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "a table")
    with pytest.raises(FileNotFoundError):
        artifacts.read_version(spark, path)
    first = artifacts.write_version(spark.range(3), path)
    held = artifacts.read_version(spark, path)
    spark.range(9).write.parquet(f"{path}/v-99999999999999999999-dead")  # a run that ended before its move
    assert artifacts.read_version(spark, path).count() == 3
    failing = spark.range(4).select(F.raise_error(F.lit("halt")).alias("id"))
    with pytest.raises(Exception, match="halt"):
        artifacts.write_version(failing, path)
    assert artifacts.current_version(spark, path) == first and held.count() == 3
    second = artifacts.write_version(spark.range(5), path)
    assert artifacts.current_version(spark, path) == second and artifacts.read_version(spark, path).count() == 5 and held.count() == 3
    artifacts.write_version(spark.range(6), path, keep=1)
    assert artifacts.read_version(spark, path).count() == 6 and not (tmp_path / "a table" / first.rsplit("/", 1)[1]).exists()


def test_run_log_keeps_failures(spark, tmp_path):
    log = artifacts.RunLog(spark, str(tmp_path / "log"))
    log.stage("count", spark.range(7), lambda x: x.write.format("noop").mode("overwrite").save(), odd=F.count_if(F.col("id") % 2 == 1))
    with pytest.raises(Exception, match="halt"):
        log.stage("fail", spark.range(1).select(F.raise_error(F.lit("halt"))), lambda x: x.collect())
    rows = {r.stage: r for r in spark.read.json(str(tmp_path / "log")).collect()}
    assert rows["count"].rows == 7 and rows["count"].details.odd == "3" and "halt" in rows["fail"].error and rows["fail"].run == rows["count"].run


def test_split_before_reading_and_commands(spark, tmp_path):
    raw, out = tmp_path / "data" / "raw", tmp_path / "data" / "features"
    for k in range(6):
        subject(raw, f"PN0{k}", "a.edf", 32, 40, k, (10, 12 + 4 * k) if k < 4 else None)
    config = EngineConfig(sample_rate=32.0, test_size=0.34)
    rates = {r.subject: r for r in pipeline.approximate_split(spark, str(raw), config, ("FP1", "FP2")).collect()}
    assert [rates[f"PN0{k}"].n_positive for k in range(6)] == [1, 3, 5, 7, 0, 0] and [rates[f"PN0{k}"].n_negative for k in range(4)] == [19, 17, 15, 13]
    assert sum(r.split == "test" for r in rates.values()) == 2
    pipeline.prepare(spark, str(raw), str(out), config, ("FP1", "FP2"), approximate=True)
    assert {r.subject: r.split for r in artifacts.read_windows(spark, str(out / "windows")).select("subject", "split").distinct().collect()} == {s: r.split for s, r in rates.items()}
    (tmp_path / "paths").write_text(f"# folders\nproject_root: '{tmp_path}'\n")
    assert Paths.from_text("project_root: /a\nlogs_path: /b/ # here") == Paths("/a", "/a/data/raw", "/a/data/features", "/a/results", "/b")
    with pytest.raises(ValueError):
        Paths.from_text("raw_data_path: x")
    command.main(["nested", "--paths", str(tmp_path / "paths"), "--sample-rate", "32", "--n-time-points", "6", "--folds", "2", "--inner-folds", "2"])
    command.main(["baselines", "--out", str(out), "--methods", "TSF", "none", "--baseline-trees", "3", "--baseline-depth", "2"])
    compared = {r.method: r for r in spark.read.json(str(out / "baselines")).collect()}
    assert compared["TSF"].error is None and 0 <= compared["TSF"].accuracy <= 1 and "unknown method" in compared["none"].error
    folds = spark.read.json(str(out / "nested_folds")).collect()
    assert len(folds) == 2 and sum(f.n for f in folds) == 120 and {f.mvar_order for f in folds} <= {2, 3} and spark.read.json(str(out / "nested_summary")).count() == 3
