"""Sharding by size-tiered compaction; DataFrame operations only.

Arrivals (runs of `arrival_rows` ids) are appended as small immutable shards. Compaction puts
shards of a similar size (their tier: how often `fanout` fits into size / smallest size) side by
side in id order and merges neighbours of a tier into files of about `target` bytes; a shard of the
target's size stays as it is. A shard is one file in a folder of its own. Each change writes new
folders, a manifest aside, writes its name to a file aside, and then renames that file to the next
version; renaming fails if another writer was first, so readers see the old version or the new one,
whole, and a writer that is lost on the way blocks nobody. (That holds where renaming without
overwriting is atomic, as on HDFS; on a local disk it is a test and a renaming.) Shards are never
changed; superseded ones are only dropped from the manifest.

Sizes are bytes of text (not of compressed files), and where shards are cut a row counts ROW_COST more,
so the same rows always make the same shards. An arrival above the target is cut at target-sized steps in the order of ids and
texts' digests. Of an arrival of over `MOST_ROWS` rows (ids that repeat or are null) the steps are
worked out by sums of groups and of input splits instead of one sort; the shards are the same.

Defined results: null text counts as zero bytes and stays null; a null id goes to arrival -1;
it comes before others where ids are ordered; repeated rows are all kept; an empty table commits an empty manifest, which read() refuses and
op4_sharding answers with no rows. Other columns are stored as they are, but for the store's own
(_shard, _folder, and others that begin with _row_), which must not clash and are refused. Names of shards are given
anew in each version: a shard is known by its folder and name together.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table, work_dir

ARRIVAL_ROWS = 1000  # ids of one arrival
TARGET = 32 << 20  # bytes of text in a merged shard
FANOUT = 4
SMALLEST = 64 << 10  # shards of up to this size are of tier 0
MOST_ROWS = 16_000  # of an arrival that one task sorts
ROW_COST = 16  # bytes that a row counts besides its text
PLAN_BROADCAST = 1_000_000  # shards; a larger plan is joined by a shuffle

MANIFEST = "shard string, folder string, rows long, bytes long, tier int"


def tier(size: F.Column, smallest: int, fanout: int, target: int) -> F.Column:
    """How many of smallest * fanout^k, below the target, the size reaches."""
    steps, edge = F.lit(0), smallest
    while edge < target:
        steps, edge = steps + F.when(size > edge, 1).otherwise(0), edge * fanout
    return steps


class ShardStore:
    """Shards and manifest versions below `root`, a folder in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, id_col: str, text_col: str, target: int = TARGET, fanout: int = FANOUT, smallest: int = SMALLEST):
        self.spark, self.root, self.id_col, self.text_col = spark, root, id_col, text_col
        self.target, self.fanout, self.smallest = target, fanout, smallest
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifest -------------------------------------------------------------------------------
    def _names(self) -> dict[int, bool]:
        """Numbers that are taken, and whether a version stands there: an empty file is none."""
        top = self._path(f"{self.root}/manifest")
        found = self._fs.listStatus(top) if self._fs.exists(top) else []
        return {int(x.getPath().getName()[2:]): x.getLen() > 0 for x in found if x.getPath().getName().startswith("v-")}

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        return max((v for v, whole in self._names().items() if whole), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Rows (shard, folder, rows, bytes, tier) of a version."""
        v = version or self.version()
        stream = self._fs.open(self._path(f"{self.root}/manifest/v-{v:06d}"))
        try:
            rows = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return self.spark.read.parquet(f"{self.root}/manifest/{rows}").select("shard", "folder", "rows", "bytes", "tier")

    def commit(self, rows: DataFrame, based_on: int) -> int:
        """Write rows aside, then rename a file that names them to the next free version; fails if based_on is not the newest."""
        name = f"rows-{based_on + 1:06d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/manifest/{name}")
        aside = self._path(f"{self.root}/manifest/next-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(name.encode()))
        out.close()
        if self.version() != based_on:
            raise RuntimeError(f"version {self.version()} was committed by another writer")
        version = max(self._names(), default=0) + 1  # empty files of lost writers are passed over
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        never = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        modes = gateway.new_array(never, 1)
        modes[0] = never.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, self._path(f"{self.root}/manifest/v-{version:06d}"), modes)
        except Py4JJavaError as e:
            raise RuntimeError(f"version {version} was committed by another writer") from e
        return version

    # -- data -----------------------------------------------------------------------------------
    def _size(self) -> F.Column:
        return F.coalesce(F.octet_length(F.col(self.text_col).cast("string")), F.lit(0)).cast("long")

    def _weight(self) -> F.Column:
        """What a row counts where arrivals and merged shards are cut."""
        return self._size() + ROW_COST

    def _rows(self, folders: list[str]) -> DataFrame:
        """All rows of some folders, with _shard and _folder, which are parts of the paths."""
        return self.spark.read.option("basePath", f"{self.root}/shards").parquet(*[f"{self.root}/shards/_folder={x}" for x in folders])

    def _store(self, rows: DataFrame, folder: str) -> DataFrame:
        """Write rows, a file for each _shard, and what the manifest says of them."""
        rows.write.partitionBy("_shard").option("compression", "zstd").parquet(f"{self.root}/shards/_folder={folder}")
        if not self._fs.globStatus(self._path(f"{self.root}/shards/_folder={folder}/_shard=*")):
            return self.spark.createDataFrame([], MANIFEST)
        new = self._rows([folder]).groupBy(F.col("_shard").alias("shard")).agg(F.lit(folder).alias("folder"), F.count(F.lit(1)).alias("rows"), F.sum(self._size()).alias("bytes"))
        return new.withColumn("tier", tier(F.col("bytes"), self.smallest, self.fanout, self.target))

    def append(self, docs: DataFrame, arrival: F.Column) -> int:
        """Store docs as one small shard for each arrival and commit."""
        if any(c in ("_shard", "_folder") or c.startswith("_row_") for c in docs.columns):
            raise ValueError("docs has a column of the store's own")
        based_on = self.version()
        folder = f"shards-{based_on + 1:06d}-{uuid.uuid4().hex[:8]}"
        named = docs.withColumns({"_row_arrival": F.coalesce(arrival.cast("long"), F.lit(-1).cast("long")), "_row_sha": F.sha2(F.coalesce(F.col(self.text_col).cast("string"), F.lit("")), 256)})
        hot = named.groupBy("_row_arrival").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_ROWS).select("_row_arrival")
        hot = cut(hot, f"{self.root}/hot/{folder}")
        many = hot.count()
        known = F.broadcast(hot) if many <= PLAN_BROADCAST else hot
        w = Window.partitionBy("_row_arrival").orderBy(F.asc_nulls_first(self.id_col), "_row_sha").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        few = (named.join(known, "_row_arrival", "left_anti") if many else named).withColumn("_row_before", F.sum(self._weight()).over(w) - self._weight())
        rows = few if not many else few.unionByName(self._spread(named.join(known, "_row_arrival", "left_semi"), folder))
        shard = F.format_string("a%012d-%05d", "_row_arrival", F.floor(F.col("_row_before") / self.target))
        rows = rows.withColumn("_shard", shard).drop("_row_arrival", "_row_sha", "_row_before")
        new = self._store(rows.repartition("_shard") if many else rows, folder)
        return self.commit(self.manifest(based_on).unionByName(new) if based_on else new, based_on)

    def _spread(self, rows: DataFrame, folder: str) -> DataFrame:
        """rows with _row_before, the bytes before a row in its arrival: by sums of beginnings of digests, of texts, and of a text's copies by input split."""
        rows = rows.withColumns({"_row_split": F.spark_partition_id(), "_row_id": F.coalesce(F.concat(F.lit("="), F.col(self.id_col).cast("string")), F.lit("")), "_row_size": self._weight()})
        rows = cut(rows, f"{self.root}/hot/{folder}-rows")
        text = ["_row_arrival", "_row_id", "_row_sha"]
        begin = F.substring("_row_sha", 1, 3).alias("_row_begin")
        before = Window.rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("long")
        splits = rows.groupBy(*text, "_row_split").agg(F.count(F.lit(1)).alias("n"), F.max("_row_size").alias("size"), F.max(self.id_col).alias("order"))
        splits = cut(splits, f"{self.root}/hot/{folder}-splits")
        texts = splits.groupBy(*text, begin).agg(F.sum(F.col("n") * F.col("size")).alias("sum"), F.max("order").alias("order"))
        begins = texts.groupBy("_row_arrival", "_row_id", "_row_begin").agg(F.sum("sum").alias("sum"), F.max("order").alias("order"))
        order = before.partitionBy("_row_arrival").orderBy(F.asc_nulls_first("order"), "_row_begin")
        begins = begins.select("_row_arrival", "_row_id", "_row_begin", F.coalesce(F.sum("sum").over(order), zero).alias("base"))
        inside = before.partitionBy("_row_arrival", "_row_id", "_row_begin").orderBy("_row_sha")
        texts = texts.withColumn("within", F.coalesce(F.sum("sum").over(inside), zero)).join(begins, ["_row_arrival", "_row_id", "_row_begin"])
        texts = texts.select(*text, (F.col("base") + F.col("within")).alias("base"))
        copies = before.partitionBy(*text).orderBy("_row_split")
        starts = splits.withColumn("first", F.coalesce(F.sum("n").over(copies), zero)).join(texts, text).select(*text, "_row_split", "first", "base")
        own = F.row_number().over(Window.partitionBy(*text, "_row_split").orderBy("_row_size")) - 1
        placed = rows.withColumn("_row_own", own).join(starts, [*text, "_row_split"])
        placed = placed.withColumn("_row_before", F.col("base") + (F.col("first") + F.col("_row_own")) * F.col("_row_size"))
        return placed.drop("_row_split", "_row_id", "_row_size", "_row_own", "first", "base")

    def plan(self) -> DataFrame:
        """Shards of the current version below the target, each with the name of the shard it goes to.

        Metadata only, a row for each shard. Names that begin alike are summed up on their own, so a
        task holds the shards of one beginning, or a row for each beginning.
        """
        small = self.manifest().filter(F.col("bytes") < self.target).withColumns({"_begin": F.substring("shard", 1, 10), "_weight": F.col("bytes") + ROW_COST * F.col("rows")})
        w = Window.partitionBy("tier", "_begin").orderBy("shard", "folder").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = small.groupBy("tier", "_begin").agg(F.sum("_weight").alias("_sum"))
        over = Window.partitionBy("tier").orderBy("_begin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.select("tier", "_begin", (F.sum("_sum").over(over) - F.col("_sum")).alias("_base"))
        before = F.col("_base") + F.sum("_weight").over(w) - F.col("_weight")
        goal = F.format_string("m%02d-%012d", "tier", F.floor(before / self.target))
        return small.join(sums, ["tier", "_begin"]).withColumn("goal", goal).drop("_begin", "_base", "_weight")

    def compact(self) -> int:
        """Merge similarly sized shards into target-sized files and commit."""
        based_on = self.version()
        plan = cut(self.plan().select(F.col("shard").alias("_shard"), F.col("folder").alias("_folder"), "goal"), f"{self.root}/plans/{based_on:06d}-{uuid.uuid4().hex[:8]}")
        folder = f"shards-{based_on + 1:06d}-{uuid.uuid4().hex[:8]}"
        sources = [r["_folder"] for r in plan.select("_folder").distinct().collect()]  # one for each commit
        if not sources:
            return based_on
        if plan.count() <= PLAN_BROADCAST:
            plan = F.broadcast(plan)
        merged = self._rows(sources).join(plan, ["_folder", "_shard"]).drop("_folder", "_shard").withColumnRenamed("goal", "_shard")
        # a goal holds at most about twice the target: one task writes it, as one file
        new = self._store(merged.repartition("_shard").sortWithinPartitions("_shard", self.id_col), folder)
        stay = self.manifest(based_on).filter(F.col("bytes") >= self.target)
        return self.commit(stay.unionByName(new), based_on)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with their shard as _shard and its folder as _folder; the two together tell shards apart."""
        listed = self.manifest(version)
        folders = [r["folder"] for r in listed.select("folder").distinct().collect()]
        if not folders:
            raise ValueError("the version has no shards")
        names = listed.select(F.col("folder").alias("_folder"), F.col("shard").alias("_shard"))
        names = F.broadcast(names) if names.count() <= PLAN_BROADCAST else names
        return self._rows(folders).join(names, ["_folder", "_shard"], "left_semi")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrival_rows: int = ARRIVAL_ROWS, target: int = TARGET, root: str | None = None) -> ShardStore:
    """Append docs arrival by arrival, compact once, and return the store."""
    store = ShardStore(docs.sparkSession, root or work_dir(docs.sparkSession, "shards"), id_col, text_col, target)
    store.append(docs, F.floor(F.col(id_col) / arrival_rows))
    store.compact()
    return store


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard, n_bytes and text_sha256 of every stored row, read back from the committed version."""
    store = shard(table(spark, sf_dir, "documents"))
    if store.manifest().isEmpty():
        return spark.createDataFrame([], "doc_id long, shard string, n_bytes long, text_sha256 string")
    rows = store.read()
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select("doc_id", F.col("_shard").alias("shard"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS b,
         CAST(coalesce(floor(doc_id / {ARRIVAL_ROWS}.0), -1) AS BIGINT) AS arrival
  FROM documents
), a AS (
  SELECT *, CAST(floor((sum(b + {ROW_COST}) OVER (PARTITION BY arrival ORDER BY doc_id NULLS FIRST, sha256(t) ROWS UNBOUNDED PRECEDING) - b - {ROW_COST}) / {TARGET}.0) AS BIGINT) AS part FROM d
), s AS (
  SELECT printf('a%012d-%05d', arrival, part) AS shard, sum(b) AS bytes, sum(b + {ROW_COST}) AS weight FROM a GROUP BY ALL
), g AS (
  SELECT shard, bytes, weight, {' + '.join(f'(CASE WHEN bytes > {SMALLEST * FANOUT ** k} THEN 1 ELSE 0 END)' for k in range(5) if SMALLEST * FANOUT ** k < TARGET)} AS tier FROM s
), m AS (
  SELECT shard, CASE WHEN bytes >= {TARGET} THEN shard ELSE
    printf('m%02d-%012d', tier, CAST(floor((sum(CASE WHEN bytes < {TARGET} THEN weight ELSE 0 END) OVER (PARTITION BY tier ORDER BY shard ROWS UNBOUNDED PRECEDING) - weight) / {TARGET}.0) AS BIGINT)) END AS goal
  FROM g
)
SELECT a.doc_id, m.goal AS shard, CAST(a.b AS BIGINT) AS n_bytes, sha256(a.t) AS text_sha256
FROM a JOIN m ON m.shard = printf('a%012d-%05d', a.arrival, a.part)
"""
