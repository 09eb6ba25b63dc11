"""Queries that run as streams with state, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.folders import shared_dir
from ..sources.trees import table
from ..streaming.eviction import event_stream, evicted, run_available
from .catalogue import query


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_eviction_stream(spark, sf):
    """Sessions as a stream with timers gives them out; a last moment two days on ends those that are open."""
    last = table(spark, sf, "events").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    end = last.select(F.lit(-1).cast("long").alias("user_id"), "ts")
    end.write.parquet(at := shared_dir(spark, "end"))
    stream = event_stream(spark, f"{sf}/events.parquet").unionByName(event_stream(spark, at))
    sink = shared_dir(spark, "evicted")
    run_available(evicted(stream), sink, shared_dir(spark, "eviction"))
    return spark.read.parquet(sink).filter("user_id <> -1")
