"""Markers on rows as a table of their own: set, found, taken off, cleared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark(rows: DataFrame, session: str, key: str, label: str | None = None, most: int | None = None) -> DataFrame:
    """(session, key, marker, label): marker is mark-N, N counting from 1 in each session by key; at most `most` of a session."""
    at = F.row_number().over(Window.partitionBy(session).orderBy(key))
    if most is not None:
        rows, at = rows.withColumn("_at", at).filter(F.col("_at") <= most), F.col("_at")
    return rows.select(session, key, F.format_string("mark-%d", at).alias("marker"), F.lit(label).cast("string").alias("label"))


def find(markers: DataFrame, rows: DataFrame, session: str, key: str) -> DataFrame:
    """Rows that still exist, with their markers."""
    return rows.join(markers, [session, key])


def unmark(markers: DataFrame, gone: DataFrame, session: str) -> DataFrame:
    """Markers without those named by (session, marker)."""
    return markers.join(gone.select(session, "marker"), [session, "marker"], "left_anti")


def cleared(markers: DataFrame, session: str) -> DataFrame:
    """How many markers each session loses."""
    return markers.groupBy(session).agg(F.count(F.lit(1)).alias("cleared"))
