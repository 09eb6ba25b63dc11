"""Exact dedup over a log-structured merge index of digests; DataFrame operations only.

An arrival's rows gather in memtables (its input splits). A memtable flushes as a run sorted by
digest, one entry per digest: smallest id and count. Compaction merges `fanout` runs of a
generation at a time and keeps the smallest identifier and the count: these are the answer. A bit
filter over the compacted run's digests that occur more than once lets the second scan pass only hits,
and hits are compared byte by byte: a digest that turns out to hold several texts is answered by its
whole texts instead. The filter's size is bounded; beyond some 10^8 repeated digests it passes more
texts than hits, at worst all of them, each shuffled once.

Runs carry no filters of their own: an arrival's runs are all merged before the first lookup, which
the one filter over the last run serves.

Defined results: null text counts as empty; empty texts equal each other; a null id sorts after
every id (a group of null ids keeps them all, its keep_id is null); rows that repeat an id and its
text are one document written twice: all carry the same answer. An empty table gives no rows.
Columns other than the two named are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, normalised, table, text_of, work_dir

FILTER_BUCKET = 32768  # bits that one row of bitmap_construct_agg holds
MAX_FILTER_BITS = 1 << 28  # 32 MB when broadcast, whatever the input


def sha256(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def bit_filter(digests: DataFrame, column: str, expected: int) -> tuple[DataFrame, int]:
    """Rows (bucket, bits) of a one-hash filter, and its size. The size is bounded by MAX_FILTER_BITS."""
    bits = FILTER_BUCKET
    while bits < min(16 * expected, MAX_FILTER_BITS):
        bits *= 2
    slot = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    rows = digests.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
    return rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")), bits


def may_contain(df: DataFrame, column: str, found: tuple[DataFrame, int]) -> DataFrame:
    """Rows of df that the filter lets pass: all whose digest is in it, few others."""
    rows, bits = found
    slot = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (at % 8).cast("int")) == 1
    # at most MAX_FILTER_BITS / 8 bytes: the filter is broadcast
    return df.join(F.broadcast(rows), (F.bitmap_bucket_number(slot) == F.col("bucket")) & hit, "left_semi")


class MergeIndex:
    """digest -> (smallest id, count), kept as generations of sorted runs below `root`."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = 64):
        self.spark, self.root, self.fanout = spark, root, fanout
        self.levels: list[DataFrame] = []
        self.files = 0

    def _write(self, runs: DataFrame) -> DataFrame:
        self.files += 1
        return cut(runs.sortWithinPartitions("run", "digest"), f"{self.root}/generation-{self.files:04d}")

    def append(self, entries: DataFrame) -> None:
        """entries: (id, digest) of one arrival. Each input split is a memtable and flushes one run."""
        memtables = entries.select(F.spark_partition_id().alias("run"), "digest", "id")
        runs = memtables.groupBy("run", "digest").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        self.levels.append(self._write(runs))

    def compact(self) -> DataFrame:
        """Merge runs until one is left."""
        if not self.levels:
            raise ValueError("nothing was appended")
        merged = self.levels[0].withColumn("arrival", F.lit(0))
        for i, level in enumerate(self.levels[1:], 1):
            merged = merged.unionByName(level.withColumn("arrival", F.lit(i)))
        if len(self.levels) > 1:  # runs of different arrivals get different numbers
            width = merged.agg(F.max("run")).first()[0] or 0
            merged = merged.withColumn("run", F.col("run") + F.col("arrival") * (width + 1))
        merged = merged.drop("arrival")
        runs = (merged.agg(F.max("run")).first()[0] or 0) + 1
        while runs > 1:
            merged = self._write(
                merged.withColumn("run", F.floor(F.col("run") / self.fanout).cast("int"))
                .groupBy("run", "digest")
                .agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
            )
            runs = -(-runs // self.fanout)
        self.levels = [merged]
        return merged


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    root: str | None = None,
    digest: Callable[[F.Column], F.Column] = sha256,
    fanout: int = 64,
) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    digest is the index's key; texts are equal when their normalised bytes are, whatever it does.
    """
    spark = docs.sparkSession
    root = root or work_dir(spark, "exact")
    whole = docs.select(F.col(id_col).alias("id"), normalised(text_of(text_col)).alias("norm"))
    entries = cut(whole.select("id", digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("sha")), f"{root}/entries")
    index = MergeIndex(spark, f"{root}/index", fanout)
    index.append(entries.select("id", "digest"))
    repeated = index.compact().filter("n > 1").select("digest", "keep", "n")

    # byte verification: the filter drops other texts before anything is shuffled
    found = bit_filter(repeated, "digest", repeated.count())
    hits = may_contain(whole.select("id", "norm", digest(F.col("norm")).alias("digest")), "digest", found)
    texts = hits.groupBy("digest", "norm").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    split = cut(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), f"{root}/split")
    answer = entries.join(repeated, "digest", "left").select("id", "digest", "sha", "keep", "n")
    if not split.isEmpty():
        # one digest, several texts: decide by the text itself
        by_text = hits.join(split, "digest", "left_semi").select("id", sha256(F.col("norm")).alias("sha"), "digest", "norm")
        exact = by_text.join(texts.join(split, "digest", "left_semi"), ["digest", "norm"]).select("id", "digest", "sha", "keep", "n")
        answer = answer.join(split, "digest", "left_anti").unionByName(exact)
    alone = F.col("n").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep"))
    return answer.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
