"""Source files as rows: recursive loads, languages by extension, and the choice of a workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = {"cs": "C#", "vb": "VB.NET", "fs": "F#", "fsx": "F#", "fsi": "F#"}


def files(spark: SparkSession, root: str, pattern: str = "*", without: tuple[str, ...] = ("obj", "bin"), recursive: bool = True) -> DataFrame:
    """(path, bytes) of the files below root whose name fits the glob, by path; folders named in `without` are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root)
    dropped = F.col("path").rlike("/(" + "|".join(without) + ")/") if without else F.lit(False)
    return found.select("path", F.col("length").alias("bytes")).filter(~dropped).orderBy("path")


def texts(spark: SparkSession, root: str, pattern: str = "*", without: tuple[str, ...] = ("obj", "bin")) -> DataFrame:
    """(path, text) of the same files, whole."""
    read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(root, wholetext=True)
    dropped = F.col("path").rlike("/(" + "|".join(without) + ")/") if without else F.lit(False)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(~dropped)


def extension(path: F.Column) -> F.Column:
    """What follows the last dot of the last part of a path, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: F.Column, languages: dict[str, str] | None = None, other: str = "unknown") -> F.Column:
    pairs = [F.lit(x) for pair in (languages or LANGUAGES).items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit(other))


def workspace(rows: DataFrame, id_col: str, path_col: str, wanted: str | None = None) -> DataFrame:
    """Rows of the workspace with that id; else of the first path that equals or begins with it, ignoring case; else all."""
    if wanted is None:
        return rows
    by_id = F.coalesce(F.col(id_col).cast("string") == wanted, F.lit(False))
    by_path = F.coalesce(F.startswith(F.upper(path_col), F.lit(wanted.upper())), F.lit(False))
    # one row: whether an id fits, and the first path that does
    fits = rows.agg(F.max(by_id).alias("id"), F.min(F.when(by_path, F.col(path_col))).alias("path")).first()
    if fits["id"]:
        return rows.filter(by_id)
    return rows if fits["path"] is None else rows.filter(F.col(path_col) == fits["path"])
