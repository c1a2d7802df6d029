"""Queries that write the engine's artifacts to the shared folder and read them back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from sparktide.operators import classifiers, coverage, intervals, metrics, splits
from sparktide.operators.ordering import dense_index
from sparktide.plans.mapping import HOUR, WINDOW, episodes, events, features, predictions, utc, windows, with_
from sparktide.plans.mapping import recordings as users
from sparktide.plans.pipeline import checked_recordings
from sparktide.plans.registry import query
from sparktide.sources import artifacts, recordings


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors reach it; a local one will do in local mode alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        shared = "file://" + tempfile.mkdtemp(prefix="sparktide-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _split(rows):
    return rows.withColumn("split", F.when(F.col("subject") < 3, "test").otherwise("train"))


@query(with_("emb") + " SELECT vec_id, subject, y, round(list_sum(v), 6) + 0.0 AS total FROM emb WHERE subject < 3")
def q84_window_store(spark, sf_dir):
    """Windows written by split, and the test split read back from its folder alone."""
    path = _folder(spark, "windows")
    artifacts.write_windows(_split(windows(spark, sf_dir)), path)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return artifacts.read_windows(spark, path, "test").select("vec_id", "subject", "y", (F.round(total, 6) + 0.0).alias("total"))


@query(with_("emb") + """ SELECT count(*) FILTER (subject >= 3) AS n_train, count(*) FILTER (subject < 3) AS n_test, count(*) FILTER (subject >= 3 AND y = 1) AS train_class_1,
count(*) FILTER (subject < 3 AND y = 0) AS test_class_0, count(DISTINCT subject) FILTER (subject < 3) AS n_subjects_test, count(*) FILTER (subject >= 3) * 64 AS train_values FROM emb""")
def q85_manifest_store(spark, sf_dir):
    """The manifest of these windows, written as JSON and read back."""
    path = _folder(spark, "manifest")
    artifacts.write_json(artifacts.manifest(_split(windows(spark, sf_dir)), 16.0, 4, 1.0, 1.0), path)
    schema = "n_train long, n_test long, train_class_1 long, test_class_0 long, n_subjects_test long, shape_train array<long>"
    size = F.aggregate("shape_train", F.lit(1).cast("long"), lambda a, x: a * x)
    return artifacts.read_manifest(spark, path, schema).withColumn("train_values", size).drop("shape_train")


@query("SELECT c_custkey::VARCHAR AS subject FROM customer WHERE c_custkey % 3 = 0")
def q86_subject_list(spark, sf_dir):
    """Customers in place of subjects: a CSV of their channels, blanks around its names, and those of the wanted number."""
    path = _folder(spark, "subjects")
    rows = utc(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" patient_id "), F.when(F.col("c_custkey") % 3 == 0, 29).otherwise(30).alias(" eeg_channel"))
    rows.write.option("header", True).csv(path)
    return artifacts.valid_subjects(spark, path)


@query(with_("pred") + """, k AS (SELECT subject, count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp FROM pred GROUP BY 1)
SELECT subject, tp, fp, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 9) END AS precision FROM k""")
def q87_evaluation_store(spark, sf_dir):
    """Results by subject as JSON lines, where an undefined number (NaN) comes back as null."""
    path = _folder(spark, "evaluation")
    counts = metrics.confusion(predictions(spark, sf_dir), "y", "pred", ["subject"]).select("subject", "tp", "fp")
    share = F.when(F.col("tp") + F.col("fp") > 0, F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), 9)).otherwise(F.lit(float("nan")))
    artifacts.write_json(counts.withColumn("precision", share), path)
    return spark.read.schema("subject string, tp long, fp long, precision double").json(path)


@query(with_("emb", "feat") + ", m AS (SELECT median(f) FILTER (y = 0) AS m0, median(f) FILTER (y = 1) AS m1 FROM feat) SELECT vec_id, round(abs(f - m0) / (abs(f - m0) + abs(f - m1) + 1e-10::DOUBLE), 6) AS proba FROM feat, m")
def q88_model_store(spark, sf_dir):
    """The threshold model stored as one row, read back and applied."""
    path, rows = _folder(spark, "model"), features(spark, sf_dir)
    classifiers.fit_threshold(rows, "f", "y").write.parquet(path)
    return classifiers.predict_threshold(rows, "f", spark.read.parquet(path)).select("vec_id", F.round("proba", 6).alias("proba"))


@query()
def q89_group_folds(spark, sf_dir):
    """Customers dealt to five folds by their orders, the largest first, each to the lightest fold so far."""
    from sparktide.operators.validation import nested_folds

    orders = utc(spark, sf_dir, "orders").select("o_custkey")
    return nested_folds(orders, "o_custkey", 5, 2).select("o_custkey", "fold")


def _recorded(spark, sf_dir):
    """Embeddings as recordings of up to 100 seconds, one embedding a second: file, pos (the second) and the signal's four channels of 16 samples."""
    rows = windows(spark, sf_dir).withColumn("file", F.floor(F.col("vec_id") / 100).cast("string"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("vec_id")) - 1)


@query(with_("emb") + """ SELECT vec_id, c::INTEGER AS channel, sum(floor((least(greatest(v[c * 16 + t + 1], -1), 1) + 1) / 2 * 65535 + 0.5::DOUBLE) - 32768)::BIGINT AS total
FROM emb, (SELECT unnest(generate_series(0, 3)) AS c), (SELECT unnest(generate_series(0, 15)) AS t) GROUP BY 1, 2""")
def q95_recordings(spark, sf_dir):
    """Recordings written as EDF, discovered, judged by their headers and read in ranges; each second's 16-bit values, summed up by channel."""
    folder, names = _folder(spark, "recordings"), ("FP1", "F 7", "cz", "O2")
    rows = _recorded(spark, sf_dir).persist()
    seconds = F.array_sort(F.collect_list(F.struct("pos", "v")))
    files = rows.groupBy("file").agg(seconds.alias("cut"))
    signal = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.flatten(F.transform("cut", lambda s: F.slice(s["v"], c * 16 + 1, 16))))
    recordings.write(files.select(F.concat(F.lit("PN 01-"), "file").alias("name"), signal.alias("signal")), folder, tuple(f"EEG {n}" for n in names), 16).write.format("noop").mode("overwrite").save()
    good, bad = checked_recordings(recordings.discover(spark, folder), tuple(n.upper() for n in names))
    found = good.select("path", F.explode(F.sequence(F.lit(0), (F.col("n_samples") / 16 - 1).cast("int"))).alias("pos")).select("path", (F.col("pos") * 16).alias("start"), F.lit(0).alias("label"))
    read = recordings.windows(found, tuple(n.upper() for n in names), 16, 16.0).where("error IS NULL")
    digital = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + F.round((x.cast("double") + 1) / 2 * 65535 - 32768).cast("long"))
    totals = read.select(F.regexp_extract("path", r"-(\d+)\.edf$", 1).alias("file"), (F.col("start") / 16).cast("int").alias("pos"), F.posexplode("signal").alias("channel", "x")).select("file", "pos", "channel", digital.alias("total"))
    return totals.join(rows.select("file", "pos", "vec_id"), ["file", "pos"]).select("vec_id", "channel", "total")


@query(with_("ev", "rec", "epi", "gap") + f""", r AS (SELECT user_id, p AS n_positive, n AS n_negative, coalesce(p::DOUBLE / nullif(p + n, 0), 0) AS rate FROM (
  SELECT user_id, sum(p)::BIGINT AS p, sum(n)::BIGINT AS n FROM (SELECT user_id, (e - b) // {HOUR // 6} AS p, 0 AS n FROM epi UNION ALL SELECT user_id, 0, (e - b) // {HOUR // 6} FROM gap) GROUP BY 1)),
o AS (SELECT *, row_number() OVER (ORDER BY rate, user_id) - 1 AS pos, count(*) OVER () AS n FROM r), k AS (SELECT max(n) AS n, greatest(1, floor(max(n) * 0.2::DOUBLE)::INTEGER) AS k FROM o),
picks AS (SELECT DISTINCT floor(i * (n::DOUBLE / k))::BIGINT AS pos FROM (SELECT n, k, unnest(generate_series(0, k - 1)) AS i FROM k))
SELECT user_id, n_positive, n_negative, CASE WHEN pos IN (SELECT pos FROM picks) THEN 'test' ELSE 'train' END AS split FROM o""")
def q96_approximate_split(spark, sf_dir):
    """Users split on rates from the lengths of episodes and of the gaps between them, before any window is made."""
    ev = events(spark, sf_dir)
    own = episodes(ev)
    free = intervals.gaps(own, users(ev), ["user_id"], "n", WINDOW)
    rates = intervals.subject_rates(own, free, ["user_id"], HOUR // 6)
    return splits.stratified_subject_split(rates, "user_id", 0.2).select("user_id", "n_positive", "n_negative", "split")


@query("""
WITH t AS (SELECT DISTINCT user_id, event_type FROM events), c AS (SELECT event_type AS channel, count(*) AS n FROM t GROUP BY 1)
SELECT channel, n, row_number() OVER (ORDER BY n DESC, channel)::INTEGER AS place FROM c""")
def q97_channels_by_count(spark, sf_dir):
    """Event types, in place of channels, from the one most users have to the rarest."""
    held = utc(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("channel")).distinct()
    return coverage.by_count(coverage.channel_coverage(held, ["user_id"], "channel"), "channel").select("channel", "n", "place")


@query(with_("emb") + " SELECT vec_id, subject, row_number() OVER (PARTITION BY subject ORDER BY (vec_id * 7919 % 104729) * 1000003 + vec_id) - 1 AS pos FROM emb")
def q98_versioned_index(spark, sf_dir):
    """The place of each window in its subject's list by a hash-like key, written as a second version of a table whose first holds nothing, and read back."""
    path, rows = _folder(spark, "versions"), windows(spark, sf_dir)
    key = (F.col("vec_id") * 7919 % 104729) * 1000003 + F.col("vec_id")
    index = dense_index(rows.select("vec_id", "subject", key.alias("key")), "key", ["subject"], 1000).select("vec_id", "subject", F.col("idx").alias("pos"))
    artifacts.write_version(index.where("false"), path)
    artifacts.write_version(index, path)
    return artifacts.read_version(spark, path)
