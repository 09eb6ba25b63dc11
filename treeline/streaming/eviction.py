"""Idle eviction as a stream with state: sessions that end when their user has been silent for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id long, started long, n long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Idle(StatefulProcessor):
    """One open session a user, as (started, last, n) in microseconds, with a timer where it ends.

    A row that comes late joins the open session if it lies within the gap on either side; rows
    within a call are taken in order. A session is given out once, when the watermark has passed its
    end or a later session begins.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for pdf in rows for t in pdf["us"].tolist())
        state = self.open.get() if self.open.exists() else None
        if state is not None:
            self.handle.deleteTimer(self._due(state[1]))
        out = []
        for t in times:
            if state is not None and state[0] - self.gap < t < state[1] + self.gap:
                state = (min(state[0], t), max(state[1], t), state[2] + 1)
            else:
                if state is not None:
                    out.append((key[0], state[0], state[2]))
                state = (t, t, 1)
        self.open.update(state)
        self.handle.registerTimer(self._due(state[1]))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, _, n = self.open.get()
        self.open.clear()
        yield self._rows([(key[0], started, n)])

    def close(self) -> None:
        pass

    def _due(self, last: int) -> int:
        return -(-(last + self.gap) // 1000)

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["user_id", "started", "n"]).astype("int64")


def evicted(events: DataFrame, gap_minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """OUT of a stream of events (user_id, ts): a row for each session that has ended, in append mode."""
    rows = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Idle(gap_minutes * 60_000_000), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """What is there now, appended to `sink`; a run after a stop goes on from the checkpoint. State is kept by RocksDB."""
    conf = stream.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    was = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.unset(name) if was is None else conf.set(name, was)


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """(user_id, ts) of the files below a path, `files` of them to a batch."""
    given = spark.read.parquet(path)
    reader = spark.readStream.schema(given.schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    folder, name = path.rsplit("/", 1)
    if given.inputFiles()[0].rsplit("/", 1)[1] == name:  # a file: streams read folders
        reader, path = reader.option("pathGlobFilter", name), folder
    return reader.parquet(path).select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
