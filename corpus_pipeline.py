"""Corpus pipeline: quality, exact dedup, near dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns
the columns of docs (extra ones, too, whatever their names), but for the last, which returns pieces
with their places. Rows are told apart by a stored key of their own, so null and repeated ids are
documents like others. A text that loses repeated passages keeps its row, with n_chars counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import exact_dedup, near_dedup, packing, quality, repeats
from treeline.llm.shared import cut, free, normalised, table, text_of, work_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    good = quality.scorer(docs, table(spark, sf_dir, "labels"))
    return docs.filter(good(text_of("text")) >= quality.THRESHOLD)


def with_rows(docs: DataFrame, root: str, row: str, **more: F.Column) -> DataFrame:
    """docs, stored, with a key of each row."""
    return cut(docs.withColumns({row: F.monotonically_increasing_id(), **more}), f"{root}/rows", codec="snappy")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id, and of several such rows one."""
    root = work_dir(spark, "exact-stage")
    row, sha = free(docs, "_row", "_sha")
    rows = with_rows(docs, root, row, **{sha: F.sha2(normalised(text_of("text")), 256)})
    kept = exact_dedup.exact_dedup(rows, root=f"{root}/exact").filter("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("digest")).distinct()
    keys = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("doc"), F.col(sha).alias("sha"))
    same = F.col("doc").eqNullSafe(F.col("keep")) & (F.col("sha") == F.col("digest"))
    one = keys.join(kept, same, "left_semi").groupBy("sha").agg(F.min("row").alias(row))
    return rows.join(one.select(row), row, "left_semi").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; rows are compared whatever their ids."""
    root = work_dir(spark, "near-stage")
    (row,) = free(docs, "_row")
    rows = with_rows(docs, root, row)
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("doc"))
    # stored join by join, as the driver holds the tasks of all the exchanges of one plan at once
    groups = cut(near_dedup.near_copies(rows, id_col=row, root=f"{root}/near").select(F.col(row).alias("row"), F.col("class_id").alias("group")), f"{root}/groups").join(ids, "row")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row"))
    one = cut(groups.groupBy("group").agg(first.alias("first")).select(F.col("first.row").alias(row)), f"{root}/one")
    return rows.join(one, row, "left_semi").select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that are found elsewhere, too."""
    text, spans = free(docs, "_text", "_spans")
    rows = repeats.with_spans(docs, text_as=text, spans_as=spans).withColumn("text", repeats.kept_text(text, spans))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("suffix-array dedup", repeats_stage),
    ("best-fit packing", packing_stage),
]

#: Nearest neighbours, alignment and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each stored as Parquet and read again."""
    root = work_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"{root}/{k}", codec="snappy")
    return docs
