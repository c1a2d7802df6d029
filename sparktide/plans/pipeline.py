"""From recordings and annotations to evaluated models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.config import STANDARD_CHANNELS, EngineConfig
from sparktide.functions import channels, clock
from sparktide.operators import baselines, intervals, metrics, smoothing, splits, validation
from sparktide.operators.estimator import MvarFeatures, ThresholdClassifier, ThresholdModel
from sparktide.operators.mvar import MvarConfig
from sparktide.sources import annotations, artifacts, recordings, reports

_SUBJECT = r"([^/]+)/[^/]+$"


def _held(spark: SparkSession, folder: str, c: EngineConfig, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(path, subject, file, n samples at the configured rate) of the usable recordings, and the dead letters; by headers alone."""
    good, bad = checked_recordings(recordings.discover(spark, folder), required)
    n = F.when(F.col("sfreq") == c.sample_rate, F.col("n_samples")).otherwise(F.bround(F.col("n_samples") * c.sample_rate / F.col("sfreq"))).cast("long")
    return good.select("path", F.regexp_extract("path", _SUBJECT, 1).alias("subject"), F.element_at(F.split("path", "/"), -1).alias("file"), n.alias("n")), bad


def _seizures(spark: SparkSession, folder: str, c: EngineConfig) -> DataFrame:
    """(subject, file, begin, end) in samples from the registration's start."""
    found = annotations.blocks_exact(annotations.read_lines(spark, f"{folder}/*/Seizures-list-*.txt"), "file", "line", "text")
    place = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    return found.select(F.regexp_extract(place, _SUBJECT, 1).alias("subject"), F.col("file_name").alias("file"), clock.to_samples(F.col("start_s"), c.sample_rate).alias("begin"), clock.to_samples(F.col("end_s"), c.sample_rate).alias("end"))


def approximate_split(spark: SparkSession, folder: str, config: EngineConfig | None = None, required: tuple[str, ...] = STANDARD_CHANNELS) -> DataFrame:
    """(subject, n_positive, n_negative, rate, split) before any sample is read: rates from the lengths of seizures and of what lies between them, by headers and annotations alone."""
    c = config or EngineConfig()
    window = int(c.window_sec * c.sample_rate)
    held, _ = _held(spark, folder, c, required)
    own = _seizures(spark, folder, c).join(held.select("subject", "file"), ["subject", "file"], "left_semi")
    free = intervals.gaps(own, held, ["subject", "file"], "n", window)
    rates = intervals.subject_rates(own, free, ["subject"], window)
    return splits.swap_for_positives(splits.stratified_subject_split(rates, "subject", c.test_size), "subject")


def decode_windows(spark: SparkSession, folder: str, config: EngineConfig | None = None, required: tuple[str, ...] = STANDARD_CHANNELS) -> DataFrame:
    """(window_id, subject, file, start, y, signal, path, error) of folder/<subject>/*.edf and folder/<subject>/Seizures-list-*.txt: windows, and rows of an error instead of one.

    One decoding pass gives both: recordings that can't be used have a row of checked_recordings(), blocks that can't be read one of recordings.windows(). Signals come in the order of the channels, at the
    configured rate. A window is positive if it overlaps a seizure of its own file, whose times count from the registration's start.
    """
    c = config or EngineConfig()
    window, stride = int(c.window_sec * c.sample_rate), int(c.stride_sec * c.sample_rate)
    held, bad = _held(spark, folder, c, required)
    hops = intervals.label_by_overlap(intervals.hop_starts(held, "n", window, stride), _seizures(spark, folder, c), ["subject", "file"], window, stride)
    rows = recordings.windows(hops.select("path", "start", "label"), required, window, c.sample_rate)
    rows = rows.unionByName(bad.select("path", F.col("reason").alias("error")), allowMissingColumns=True)
    named = rows.withColumn("subject", F.regexp_extract("path", _SUBJECT, 1)).withColumn("file", F.element_at(F.split("path", "/"), -1))
    key = F.when(F.col("error").isNull(), F.xxhash64("subject", "file", "start"))
    return named.select(key.alias("window_id"), "subject", "file", "start", F.col("label").alias("y"), "signal", "path", "error")


def build_windows(spark: SparkSession, folder: str, config: EngineConfig | None = None, required: tuple[str, ...] = STANDARD_CHANNELS) -> DataFrame:
    """(window_id, subject, file, start, y, signal): the windows of decode_windows()."""
    return decode_windows(spark, folder, config, required).where("error IS NULL").drop("path", "error")


def dead_letters(decoded: DataFrame) -> DataFrame:
    """(subject, path, reason, n): what went wrong with each recording, and how many times."""
    return decoded.where("error IS NOT NULL").groupBy("subject", "path", F.col("error").alias("reason")).agg(F.count("*").alias("n"))


def checked_recordings(files: DataFrame, required: tuple[str, ...] = STANDARD_CHANNELS) -> tuple[DataFrame, DataFrame]:
    """The headers of usable files, and the dead letters (path, reason): files that can't be read as EDF, files without a required channel, and files cut short, whose whole records are usable all the same."""
    heads = recordings.headers(files)
    missing = F.array_except(F.array(*[F.lit(x) for x in required]), F.transform("channels", channels.normalised_name))
    lost = F.when(F.col("channels").isNull(), F.col("error")).when(F.size("channels") == 0, F.lit("no channels")).when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, " ")))
    judged = heads.withColumn("lost", lost).withColumn("reason", F.coalesce("lost", "error"))
    return judged.where("lost IS NULL").drop("lost", "reason", "error"), judged.where("reason IS NOT NULL").select("path", "reason")


def limit_classes(windows: DataFrame, max_negative: int | None = None, max_positive: int | None = None, negative_ratio: float | None = None, seed: int = 42) -> DataFrame:
    """Caps on either class; a ratio to the positive windows comes before max_negative."""
    caps = windows.groupBy("y").count()
    positives = F.max(F.when(F.col("y") == 1, F.col("count")))
    negative = F.floor(positives * negative_ratio) if negative_ratio is not None else F.lit(max_negative).cast("long")
    caps = caps.agg(negative.alias("n"), F.lit(max_positive).cast("long").alias("p"))
    caps = caps.select(F.explode(F.array(F.struct(F.lit(0).alias("y"), F.col("n").alias("cap")), F.struct(F.lit(1).alias("y"), F.col("p").alias("cap")))).alias("c")).select("c.*").where("cap IS NOT NULL")
    return splits.cap_classes(windows, "y", "window_id", caps, seed)


def with_split(windows: DataFrame, config: EngineConfig | None = None, split: DataFrame | None = None) -> DataFrame:
    """Adds split by subject, as given, or evenly spaced over the rates of these windows, test holding a positive subject if any can move there."""
    c = config or EngineConfig()
    if split is None:
        split = splits.swap_for_positives(splits.stratified_subject_split(splits.subject_rates(windows, "subject", "y"), "subject", c.test_size), "subject")
    return windows.join(split.select("subject", "split"), "subject")


def prepare(spark: SparkSession, folder: str, out: str, config: EngineConfig | None = None, required: tuple[str, ...] = STANDARD_CHANNELS, approximate: bool = False) -> DataFrame:
    """Writes the windows, the subjects' windows, the dead letters, the manifest and a log of the run below `out`; returns the manifest.

    Recordings are decoded once, into a version of `out`/decoded; a run that fails leaves the last valid one. The split is made on the windows' rates, or on approximate_split().
    """
    c = config or EngineConfig()
    split = approximate_split(spark, folder, c, required) if approximate else None
    log = artifacts.RunLog(spark, f"{out}/log")
    log.stage("decode", decode_windows(spark, folder, c, required), lambda rows: artifacts.write_version(rows, f"{out}/decoded", keep=1), errors=F.count_if(F.col("error").isNotNull()), positive=F.count_if(F.col("y") == 1))
    decoded = artifacts.read_version(spark, f"{out}/decoded")
    log.stage("dead_letters", dead_letters(decoded), lambda rows: artifacts.write_json(rows, f"{out}/dead_letters"))
    rows = decoded.where("error IS NULL").drop("path", "error")
    log.stage("windows", with_split(rows, c, split), lambda x: artifacts.write_windows(x, f"{out}/windows"), train=F.count_if(F.col("split") == "train"), test=F.count_if(F.col("split") == "test"))
    rows = artifacts.read_windows(spark, f"{out}/windows")
    artifacts.write_subject_windows(rows, f"{out}/subject_windows")
    table = artifacts.manifest(rows, c.sample_rate, len(required), c.window_sec, c.stride_sec, c.test_size, c.seed, required, out, "stratified_by_approximate_rate" if approximate else "stratified_by_subject")
    artifacts.write_text(spark, f"{out}/splits.txt", reports.split_report(rows.select("subject", "y", "split")))
    log.stage("manifest", table, lambda x: artifacts.write_json(x, f"{out}/manifest"))
    return table


def features(windows: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Each window's feature, worked out once for prediction, probabilities and every fold."""
    c = config or EngineConfig()
    m = MvarConfig(c.order, c.n_basis, c.basis, c.regularization, c.norm, c.n_time_points)
    return MvarFeatures(m).transform(windows).drop("signal")


def balanced(rows: DataFrame, how: str | None, seed: int = 42) -> DataFrame:
    if how in (None, "none"):
        return rows
    if how not in ("undersample", "oversample"):
        raise ValueError(f"unknown balance {how}")
    return splits.undersample(rows, "y", "window_id", seed) if how == "undersample" else splits.oversample(rows, "y", "window_id", seed).drop("copy")


def fit(train: DataFrame, config: EngineConfig | None = None, weight: float | None = None) -> ThresholdModel:
    c = config or EngineConfig()
    return ThresholdClassifier("S", "y", c.threshold_metric, weight, c.n_grid_points).fit(train)


def evaluate(model: ThresholdModel, rows: DataFrame, config: EngineConfig | None = None, smooth: bool = True) -> DataFrame:
    """(level, the metrics of classification() and ranking()) by window and by subject; windows are smoothed within their file, in the order of their start."""
    c = config or EngineConfig()
    scored = model.transform(rows)
    if smooth:
        scored = smoothing.smooth(scored, "start", "pred", c.smoothing_window, c.smoothing_threshold, by=["subject", "file"]).drop("pred").withColumnRenamed("smoothed", "pred")
    levels = {"window": scored, "subject_majority": metrics.by_subject(scored, "subject", "y", "pred", None).withColumn("proba", F.col("pred").cast("double")), "subject_mean_proba": metrics.by_subject(scored, "subject", "y", "pred", "proba", "mean_proba").withColumnRenamed("score", "proba")}
    out = None
    for name, part in levels.items():
        row = metrics.classification(metrics.confusion(part, "y", "pred")).crossJoin(metrics.ranking(metrics.curve(part, "y", "proba"))).withColumn("level", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def report(model: ThresholdModel, rows: DataFrame, levels: DataFrame, out: str) -> None:
    """Writes report.txt, roc.svg, precision_recall.svg and confusion.svg below `out`, of the model on rows and of evaluate()'s levels."""
    scored = model.transform(rows).select("y", "pred", "proba").persist()
    spark = rows.sparkSession
    for name, text in (("report.txt", reports.evaluation_report(levels)), ("roc.svg", reports.roc_figure(scored)), ("precision_recall.svg", reports.precision_recall_figure(scored)), ("confusion.svg", reports.confusion_figure(scored))):
        artifacts.write_text(spark, f"{out}/{name}", text)
    scored.unpersist()


def compare_baselines(windows: DataFrame, names: list[str], sizes: baselines.Sizes | None = None, seed: int = 42) -> DataFrame:
    """(method, accuracy, roc_auc, error) of baselines.evaluate_methods() on windows(window_id, split, y, signal)."""
    flat = windows.select("window_id", "split", "y", F.flatten("signal").cast("array<double>").alias("v"), F.size("signal").alias("channels"))
    first = flat.select("channels", F.size("v").alias("n")).first()
    if first is None:
        raise ValueError("no windows")
    train, test = (flat.where(F.col("split") == s).select("window_id", "y", "v") for s in ("train", "test"))
    return baselines.evaluate_methods(names, train, test, "v", "y", "window_id", first.channels, first.n // first.channels, sizes, seed)


def nested_validate(windows: DataFrame, config: EngineConfig | None = None, grid: dict[str, list] | None = None, outer: int = 5, inner: int = 3) -> tuple[DataFrame, DataFrame]:
    """(per fold, summary) of validation.nested_cv_grid() over windows(window_id, subject, y, signal), with the configuration's values for whatever the grid leaves out."""
    c = config or EngineConfig()
    base = MvarConfig(c.order, c.n_basis, c.basis, c.regularization, c.norm, c.n_time_points)
    folds = validation.nested_cv_grid(windows.select("window_id", "subject", "y", "signal"), "signal", grid, base, outer, inner).cache()
    return folds, validation.summary(folds, ["roc_auc", "average_precision", "f1"])


def cross_validate(rows: DataFrame, folds: int, config: EngineConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(per fold, summary): subjects dealt by their majority label, a threshold fitted on the other folds each time."""
    c = config or EngineConfig()
    subjects = rows.groupBy("subject").agg((2 * F.sum("y") > F.count("*")).cast("int").alias("maj"))
    dealt = rows.join(splits.subject_folds(subjects, "subject", "maj", folds, c.seed).select("subject", "fold"), "subject").cache()
    out = None
    for k in range(folds):
        part = evaluate(fit(dealt.where(F.col("fold") != k), c), dealt.where(F.col("fold") == k).drop("fold"), c).where("level = 'window'").withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out, validation.summary(out, ["accuracy", "f1_1", "sensitivity", "specificity", "roc_auc", "average_precision"])

