"""Sessions over event streams: a marker lives until its user has been silent for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, started, ended, n) of a batch or a stream of events (user_id, ts)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
