"""Tables that are worked out once and kept by the names, sizes and times of the files they come from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import shared_dir, shuffled

#: Of more changed files than this the rows are found by a join, not by a list of their paths.
LISTED = 5000

_KEPT: dict[tuple, str] = {}
_GENERATIONS: dict[tuple, list[tuple[str, str]]] = {}


def state_of(spark: SparkSession, *paths: str) -> int:
    """A number that changes with the names, sizes and times of the files below the paths; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    row = files.agg(F.expr("bit_xor(xxhash64(path, length, modificationTime))").alias("mix"), F.count(F.lit(1)).alias("n")).first()
    return hash((row["mix"], row["n"]))


def readable(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # the folder has been cleared
        return None


def kept(spark: SparkSession, name: str, paths: list[str], build: Callable[[str], None]) -> DataFrame:
    """The table that build(path) writes: written again if a file below `paths` has changed, or if it is gone."""
    key = (spark.sparkContext.applicationId, name, tuple(paths))
    state = state_of(spark, *paths)
    at = _KEPT.get((*key, state))
    rows = readable(spark, at) if at else None
    if rows is None:
        path = shared_dir(spark, name)
        build(path)
        _KEPT[(*key, state)] = path
        rows = spark.read.parquet(path)
    return rows


def by_file(spark: SparkSession, name: str, path: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """derive(rows of `path`), kept file by file: only rows of new and changed files are read and derived.

    derive() must work on each file's rows alone and keep the column `file_key`. Every call adds at
    most one generation of derived rows; those of files that are gone or were changed are left out by
    a join with the keys of the files as they are now.
    """
    rows = spark.read.parquet(path)
    where = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
    tagged = rows.withColumn("file_key", F.xxhash64(*where))
    now = rows.select(where[0].alias("file_path"), F.xxhash64(*where).alias("file_key")).distinct()
    key = (spark.sparkContext.applicationId, name, path)
    known = [(readable(spark, a), readable(spark, b)) for a, b in _GENERATIONS.get(key, [])]
    if not known or any(x is None for pair in known for x in pair):  # the first time, or a part has been cleared
        known, _GENERATIONS[key], fresh, work = [], [], now, tagged
    else:
        fresh = now
        for _, files in known:
            fresh = fresh.join(files.select("file_key"), "file_key", "left_anti")
        changed = fresh.limit(LISTED + 1).collect()
        if not changed:
            work = None
        elif len(changed) > LISTED:
            work = tagged.join(fresh.select("file_key"), "file_key", "left_semi")
        else:
            work = tagged.filter(F.col("_metadata.file_path").isin([r["file_path"] for r in changed]))
    if work is not None:
        at, files = shared_dir(spark, name), shared_dir(spark, f"{name}-files")
        derive(work).write.parquet(at)
        fresh.write.parquet(files)
        _GENERATIONS[key].append((at, files))
        known.append((spark.read.parquet(at), None))
    out = known[0][0]
    for generation, _ in known[1:]:
        out = out.unionByName(generation)
    return shuffled(out.join(now.select("file_key"), "file_key", "left_semi"))
