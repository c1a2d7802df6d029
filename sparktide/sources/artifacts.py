"""Windows, manifests, results, versions and run logs on disk."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparktide.operators.ordering import dense_index


def write_windows(windows: DataFrame, path: str) -> None:
    """Windows with their label and subject as columns, one folder for each split."""
    windows.write.mode("overwrite").partitionBy("split").parquet(path)


def read_windows(spark: SparkSession, path: str, split: str | None = None, cache: bool = False) -> DataFrame:
    """All windows, or those of one split, whose folder alone is read."""
    rows = spark.read.parquet(path)
    rows = rows if split is None else rows.where(F.col("split") == split)
    return rows.cache() if cache else rows


#: Columns of a manifest beside its counts and parameters.
MANIFEST = "created string, channel_names array<string>, channel_system string, n_samples_per_window long, x_train string, y_train string, x_test string, y_test string, subject_windows_train string, subject_windows_test string, split_method string, train_per_class long, test_per_class long"


def manifest(
    windows: DataFrame, sample_rate: float, n_channels: int, window_sec: float = 2.0, stride_sec: float = 2.0, test_size: float = 0.2, seed: int = 42, channel_names: tuple[str, ...] = (), path: str | None = None,
    split_method: str = "stratified_by_subject", balanced: tuple[str, ...] = (),
) -> DataFrame:
    """One row of counts, shapes (windows, channels, samples), parameters and places of windows(subject, y, split, ...).

    x_, y_ and subject_windows_ name the folders below `path` that hold a split's windows, its labels (a column of the same rows) and subject_index(); they are null without a path. A split named in
    `balanced` also has its windows of each class, null elsewhere.
    """
    counts = []
    for split in ("train", "test"):
        here = F.col("split") == split
        counts += [F.count_if(here).alias(f"n_{split}"), *[F.count_if(here & (F.col("y") == c)).alias(f"{split}_class_{c}") for c in (0, 1)], F.countDistinct(F.when(here, F.col("subject"))).alias(f"n_subjects_{split}")]
    for split in ("train", "test"):
        counts.append(F.array(F.count_if(F.col("split") == split), F.lit(n_channels).cast("long"), F.lit(round(window_sec * sample_rate)).cast("long")).alias(f"shape_{split}"))
    fixed = {"sample_rate": float(sample_rate), "n_channels": n_channels, "window_sec": window_sec, "stride_sec": stride_sec, "test_size": test_size, "random_seed": seed, "split_method": split_method}
    rows = windows.agg(*counts).select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])
    rows = rows.withColumn("created", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).withColumn("n_samples_per_window", F.lit(round(window_sec * sample_rate)).cast("long"))
    rows = rows.withColumn("channel_names", F.lit(list(channel_names)).cast("array<string>")).withColumn("channel_system", F.lit("10-20 International System"))
    for split in ("train", "test"):
        place = F.lit(path and f"{path}/windows/split={split}")
        rows = rows.withColumn(f"x_{split}", place).withColumn(f"y_{split}", place).withColumn(f"subject_windows_{split}", F.lit(path and f"{path}/subject_windows/split={split}"))
        rows = rows.withColumn(f"{split}_per_class", F.col(f"{split}_class_1") if split in balanced else F.lit(None).cast("long"))
    return rows


def subject_index(windows: DataFrame, subject: str, key: str) -> DataFrame:
    """(key, subject, pos): the place of each window in its subject's list, as rows instead of one list for each subject."""
    return dense_index(windows.select(key, subject), key, [subject]).select(key, subject, F.col("idx").alias("pos"))


def write_subject_windows(windows: DataFrame, path: str, key: str = "window_id") -> None:
    """subject_index() of either split, one folder each."""
    parts = [subject_index(windows.where(F.col("split") == split), "subject", key).withColumn("split", F.lit(split)) for split in ("train", "test")]
    parts[0].unionByName(parts[1]).write.mode("overwrite").partitionBy("split").parquet(path)


#: Name of the file below a versioned table that names its valid version.
CURRENT = "_CURRENT"


def _files(spark: SparkSession, path: str):
    """Hadoop's file context and path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration()).getDefaultFileSystem().getUri(), spark._jsc.hadoopConfiguration()), hadoop


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file aside and moves it over the one at path, in one step."""
    files, hadoop = _files(spark, path)
    target = hadoop.Path(path)
    aside = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    new_array = spark.sparkContext._gateway.new_array
    flags = spark._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE, hadoop.CreateFlag.OVERWRITE)
    made = new_array(hadoop.Options.CreateOpts, 1)
    made[0] = hadoop.Options.CreateOpts.createParent()
    stream = files.create(aside, flags, made)
    stream.write(bytearray(text.encode()))
    stream.close()
    moves = new_array(hadoop.Options.Rename, 1)
    moves[0] = hadoop.Options.Rename.OVERWRITE
    files.rename(aside, target, moves)


def valid_versions(spark: SparkSession, path: str) -> list[str]:
    """The folders of the table's valid version and of those kept from before, the latest first."""
    files, hadoop = _files(spark, path)
    marker = hadoop.Path(f"{path}/{CURRENT}")
    if not files.util().exists(marker):
        return []
    stream = files.open(marker)
    try:
        return [f"{path}/{name}" for name in bytes(stream.readAllBytes()).decode().split()]
    finally:
        stream.close()


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the table's valid version; None before its first."""
    return next(iter(valid_versions(spark, path)), None)


def write_version(rows: DataFrame, path: str, keep: int = 2) -> str:
    """Writes rows as a new version of the table below path and makes it the valid one; returns its folder.

    A version is a folder of its own; a small file that names it is written aside and then moved over the last one, in one step, once the folder is whole. A reader sees the old rows or the new ones, and a run that ends
    before the move leaves the old ones valid, and a folder that nobody reads. The last `keep` valid versions stay, for readers that have begun; the one before them is deleted. Of two runs at a time the one
    that moves its file last counts.
    """
    spark = rows.sparkSession
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(f"{path}/{version}")
    files, hadoop = _files(spark, path)
    before = valid_versions(spark, path)
    write_text(spark, f"{path}/{CURRENT}", "\n".join([version, *(x.rsplit("/", 1)[1] for x in before[: keep - 1])]))
    for name in before[max(0, keep - 1) :]:
        files.delete(hadoop.Path(name), True)
    return f"{path}/{version}"


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the valid version; FileNotFoundError without one."""
    where = current_version(spark, path)
    if where is None:
        raise FileNotFoundError(f"no valid version below {path}")
    return spark.read.parquet(where)


class RunLog:
    """Rows (run, stage, rows, details, seconds, error) about the stages of a run, counted by observed metrics while the stages' own jobs run, and appended to a table as JSON lines."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.run, self.logger = spark, path, uuid.uuid4().hex, logging.getLogger("sparktide")

    def stage(self, name: str, rows: DataFrame, action: Callable[[DataFrame], object], **counts: Column) -> object:
        """action(rows), with the number of rows and each of `counts` (aggregates) observed on the way; a failure is logged and raised."""
        seen, began, error = Observation(f"{name}-{self.run}"), time.time(), None
        try:
            return action(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()]))
        except Exception as e:
            error = f"{type(e).__name__}: {str(e)[:500]}"
            raise
        finally:
            got = {} if error else dict(seen.get)
            seconds = round(time.time() - began, 3)
            n, details = got.pop("rows", None), {k: str(v) for k, v in got.items()}
            self.logger.log(logging.ERROR if error else logging.INFO, "%s: %s rows in %s s %s", name, n, seconds, error or details)
            self.spark.createDataFrame([(self.run, name, n, details, seconds, error)], "run string, stage string, rows long, details map<string,string>, seconds double, error string").coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(self.path)


def write_json(rows: DataFrame, path: str) -> None:
    """Results as JSON lines; a NaN becomes null."""
    kinds = dict(rows.dtypes)
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in rows.columns]
    rows.select(*clean).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_manifest(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def valid_subjects(spark: SparkSession, path: str | None, channels: int = 29) -> DataFrame | None:
    """Subjects of a CSV (patient_id, eeg_channel; blanks around names are cut) with that many channels; None without a file, which means no filter."""
    if path is None:
        return None
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    return rows.where(F.trim("eeg_channel").try_cast("int") == channels).select(F.trim("patient_id").alias("subject"))
