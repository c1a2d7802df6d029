"""Windows, labels and smoothing over a stream of events; an extension, since the batch engine has no unbounded input."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def event_stream(spark, path: str, schema) -> DataFrame:
    """Event files as a stream; event time must be a timestamp with a zone for watermarks."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hop_rates(events: DataFrame, window: str = "2 hours", stride: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Hopping windows of each user with their events and whether an error falls into them; windows close `late` after the newest event."""
    hops = events.withWatermark("ts", late).groupBy(F.window("ts", window, stride), "user_id")
    return hops.agg(F.count("*").alias("n"), F.max((F.col("event_type") == "error").cast("int")).alias("label")).select("user_id", F.col("window.start").alias("start"), "n", "label")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def smooth_stream(predictions: DataFrame, size: int = 5, threshold: float = 0.5) -> DataFrame:
    """Causal smoothing of predictions(subject, idx, pred): each row with the size - 1 rows before it that its subject has kept as state."""

    def run(key, batches, state):
        kept = list(state.get[0]) if state.exists else []
        for pdf in batches:
            out = []
            for row in pdf.sort_values("idx").itertuples():
                kept = [*kept, int(row.pred)][-size:]
                out.append((key[0], row.idx, row.pred, int(sum(kept) / len(kept) >= threshold)))
            yield pd.DataFrame(out, columns=["subject", "idx", "pred", "smoothed"])
        state.update((kept,))

    return predictions.groupBy("subject").applyInPandasWithState(run, "subject long, idx long, pred int, smoothed int", "kept array<int>", "append", GroupStateTimeout.NoTimeout)
