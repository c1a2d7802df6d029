"""How the given tables stand for recordings, intervals, windows and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Microseconds that an error event opens an interval for, and the window and stride of recordings of events.
EPISODE, WINDOW, STRIDE = HOUR // 2, 2 * HOUR, HOUR

# The same in SQL for the oracle.
SQL = {
    "ev": "ev AS (SELECT user_id, event_id, event_type, value, ts, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us FROM events)",
    "rec": "rec AS (SELECT user_id, max(us) AS n FROM ev GROUP BY 1)",
    "epi": f"epi AS (SELECT user_id, us AS b, us + {EPISODE} AS e FROM ev WHERE event_type = 'error')",
    "gap": f"""gap AS (SELECT user_id, g AS b, h AS e FROM (
        SELECT user_id, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, b AS h FROM epi
        UNION ALL SELECT rec.user_id, coalesce(m, 0), n FROM rec LEFT JOIN (SELECT user_id, max(e) AS m FROM epi GROUP BY 1) USING (user_id)) WHERE h - g >= {WINDOW})""",
    "pred": "pred AS (SELECT doc_id, source AS subject, toxic AS y, (n_chars % 11) / 10.0::DOUBLE AS score, CASE WHEN n_chars % 11 >= 5 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id))",
    "emb": "emb AS (SELECT vec_id, vec_id % 10 AS subject, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)",
    "feat": "feat AS (SELECT vec_id, subject, y, round(sqrt(list_sum(list_transform(v, lambda x: x * x))) + v[1], 9) AS f FROM emb)",
}


def utc(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with us, the microseconds since the user's first one."""
    df = utc(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return df.join(df.groupBy("user_id").agg(F.min("at").alias("first")), "user_id").withColumn("us", F.col("at") - F.col("first")).drop("at", "first")


def recordings(ev: DataFrame) -> DataFrame:
    return ev.groupBy("user_id").agg(F.max("us").alias("n"))


def episodes(ev: DataFrame) -> DataFrame:
    return ev.where("event_type = 'error'").select("user_id", F.col("us").alias("begin"), (F.col("us") + EPISODE).alias("end"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = utc(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    ten = F.col("n_chars") % 11
    return utc(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("source").alias("subject"), F.col("toxic").alias("y"), (ten / 10.0).alias("score"), (ten >= 5).cast("int").alias("pred"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as windows: vec_id, subject, y, v (64 doubles)."""
    return utc(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 10).alias("subject"), (F.col("label") >= 5).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("v"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number for each window: its length and first value, rounded so that sums in another order agree."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return windows(spark, sf_dir).select("vec_id", "subject", "y", F.round(norm + F.col("v")[0], 9).alias("f"))


def embedding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions over windows: score from the window's number, ties included."""
    return windows(spark, sf_dir).select("vec_id", "subject", "y", ((F.col("vec_id") * 7 % 11) / 10.0).alias("score"), (F.col("vec_id") * 7 % 11 >= 5).cast("int").alias("pred"))


SQL["ep"] = "ep AS (SELECT vec_id, subject, y, (vec_id * 7 % 11) / 10.0::DOUBLE AS score, CASE WHEN vec_id * 7 % 11 >= 5 THEN 1 ELSE 0 END AS pred FROM emb)"


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
