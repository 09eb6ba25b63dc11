"""Folders, schemas and small helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, in contracts and operators alike.
BLANKS = r"[\x20\x09-\x0D]+"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's own setting that drops a query's shuffle files as it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write df and read it again: lineage ends at a table in the shared folder, and the shuffle files go."""
    conf = df.sparkSession.conf
    was = conf.get(FREED, "false")
    conf.set(FREED, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.set(FREED, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def normalised(text: F.Column) -> F.Column:
    """Runs of ASCII blanks become one space."""
    return F.regexp_replace(text, BLANKS, " ")


def fold_of(id_col: F.Column) -> F.Column:
    """crc32(id as text) mod 5; the fold of a null id is that of the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it as long as df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(rows: int, each: int) -> int:
    """How many parts of about `each` rows, at least one."""
    return max(1, math.ceil(rows / each))


def batches(frames, max_chars: int, column: str):
    """Re-cut an iterator of pandas frames so that none holds more than about max_chars of text."""
    for pdf in frames:
        if pdf.empty:
            continue
        edges = (pdf[column].str.len().fillna(0).cumsum() // max_chars).to_numpy()
        if edges[-1] == edges[0]:
            yield pdf
        else:
            for _, part in pdf.groupby(edges, sort=False):
                yield part.reset_index(drop=True)
