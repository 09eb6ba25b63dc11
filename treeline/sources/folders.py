"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: So many rows, on average, are dealt to one task.
ROWS = 1 << 18

_PARTS, _PUT_TOGETHER = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def shuffled(rows: DataFrame) -> DataFrame:
    """The rows, to be joined by shuffle and sort.

    Numbers of nodes and pairs take a hundredth of their size in files, and Spark takes the size of
    files for that of rows: it would gather tables of hundreds of MB on the driver and send them to
    every task. The hint holds for projections, filters and groups of the rows; joins and unions end it.
    """
    return rows.hint("merge")


def tasks_for(spark: SparkSession, n: int) -> int:
    """How many tasks n rows are dealt to; 0 if one task may hold them all, so that Spark deals them as it likes."""
    return 0 if n <= ROWS else max(-(-n // ROWS), spark.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows dealt by keys, as n rows need it, for a join or groups by these keys: other sides of a join follow.

    Of a semi or anti join it is the right side that is to be dealt: Spark puts off what is done to the left one. A join deals anew what has fewer parts than the session's setting, so there are as many at least.
    """
    spark = rows.sparkSession
    tasks = tasks_for(spark, n)
    return rows.repartition(max(tasks, int(spark.conf.get(_PARTS))), *keys) if tasks else rows


@contextmanager
def dealing(spark: SparkSession, n: int | None) -> Iterator[None]:
    """What is run inside is dealt as n rows need it (None: as Spark likes); the session's settings are set back.

    Spark puts the parts of a shuffle together by their size in files, of which rows of numbers take a
    hundredth: a task's rows would grow with the input.
    """
    tasks = tasks_for(spark, n or 0)
    was = {k: spark.conf.get(k) for k in (_PARTS, _PUT_TOGETHER)} if tasks else {}
    try:
        for k, v in zip(was, (tasks, False)):
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def stored(rows: DataFrame, name: str, n: int | None = None) -> DataFrame:
    """The rows, written to a fresh shared folder and read again, for joins by shuffle: lineage ends here. With n they are worked in tasks as n rows need it."""
    path = shared_dir(rows.sparkSession, name)
    with dealing(rows.sparkSession, n):
        rows.write.parquet(path)
    return shuffled(rows.sparkSession.read.schema(rows.schema).parquet(path))
