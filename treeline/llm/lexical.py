"""Ranked lexical search by buckets of vector length, with exact integer scores.

A document is a vector of the integer impacts of its terms, an item a vector of its term counts; the
score is their product. Only terms of items are coordinates. Vectors are laid out by Spark in order
of their length, and a task's batches are the buckets. The product is at most the product of the
lengths (Cauchy-Schwarz), which rules out whole buckets for an item whose k-th best score so far is
higher; inside a bucket, the coordinates that can add most are summed up, and what is left is
bounded by the lengths of the rests and by the bucket's largest coordinates. Survivors are scored in
64-bit integers over all coordinates. Lower bounds of the k-th best come from a bounded sample of
documents first, so that every task starts with them; the results do not depend on the sample.

Items are taken in parts of about ITEM_BYTES of text: a part's terms, weights and bounds are all that
is broadcast, and every part goes over all documents.

Defined results: a null text has no terms; texts without terms are no documents of the statistics;
items without terms, or without a document above 0, have no rows; fewer than k documents above 0 are
all returned; of equal scores the smaller doc_id is first (null ids last); repeated rows are
documents, and items, each; other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .licenses import LOWER, UPPER, WORD
from .shared import cut, slices, table, text_of, work_dir

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # over the bytes of a text whose A-Z are lower-cased
TOP = 20
ITEM_BYTES = 8 << 20  # of item texts that one pass over the documents serves
SAMPLE = 50_000  # documents, about, that give the first lower bounds
FOCUS = 32  # coordinates of an item that are summed up before the others are bounded
SLACK = 1 + 1e-9  # bounds are doubles, scores are not
PER_TASK = 200_000  # vectors


def terms_of(text: str) -> list[bytes]:
    return TERM.findall(text.encode().lower())  # bytes.lower() changes A-Z alone


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (all terms, with repeats), terms and tfs (those of the vocabulary) of each document with a term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(parts):
        ids = known.value
        for batch in parts:
            rows, n, terms, tfs, edges = [], [], [], [], [0]
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = terms_of(text)
                if found:
                    tf = Counter(map(ids.get, found))
                    tf.pop(None, None)
                    rows.append(k)
                    n.append(len(found))
                    terms += tf.keys()
                    tfs += tf.values()
                    edges.append(len(terms))
            lists = pa.array(edges, type=pa.int32())
            columns = [batch.column("doc_id").take(pa.array(rows, type=pa.int64())), pa.array(n, type=pa.int64()), *(pa.ListArray.from_arrays(lists, pa.array(x, type=t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


@dataclass
class Items:
    """Items of a part: ids, norms, and for each its term numbers and counts."""

    ids: list
    terms: list[np.ndarray]
    counts: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[bytes, int] = {}
        out = cls([], [], [], vocabulary)
        for item, text in rows:
            tf = Counter(terms_of(text))
            out.ids.append(item)
            out.terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in tf], dtype=np.int64))
            out.counts.append(np.array(list(tf.values()), dtype=np.int64))
        return out


def impacts(stored: DataFrame, weights: np.ndarray, documents: int, length: int) -> DataFrame:
    """doc_id, norm, terms, impacts of the documents that hold a term of the items."""
    known = stored.sparkSession.sparkContext.broadcast(weights)

    def run(parts):
        for b in parts:
            terms, tf, n, edges = flat(b, "terms"), flat(b, "tfs"), b.column("n").to_numpy(), offsets(b, "terms")
            m = np.repeat(75 + (25 * n * documents) // length, np.diff(edges))
            p = known.value[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            norm = np.sqrt(np.add.reduceat(p.astype(float) ** 2, edges[:-1])) if len(n) else np.zeros(0)  # no vector is empty
            lists = pa.array(edges, type=pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(norm), pa.ListArray.from_arrays(lists, pa.array(terms.astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(p))], ["doc_id", "norm", "terms", "impacts"])

    return stored.filter(F.size("terms") > 0).mapInArrow(run, "doc_id long, norm double, terms array<int>, impacts array<long>")


def flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def offsets(batch: pa.RecordBatch, name: str) -> np.ndarray:
    edges = np.asarray(batch.column(name).offsets, dtype=np.int64)
    return edges - edges[0]


class Bucket:
    """Vectors of a batch, by document and by term."""

    def __init__(self, batch: pa.RecordBatch, terms: int):
        self.ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        self.rows = np.arange(batch.num_rows)
        self.norm = batch.column("norm").to_numpy()
        self.longest = float(self.norm.max())
        self.edges, self.terms, self.p = offsets(batch, "terms"), flat(batch, "terms"), flat(batch, "impacts")
        doc = np.repeat(self.rows, np.diff(self.edges))
        order = np.argsort(self.terms, kind="stable")
        self.doc_by_term, self.p_by_term = doc[order], self.p[order]
        self.starts = np.searchsorted(self.terms[order], np.arange(terms + 1))
        self.largest = np.zeros(terms, dtype=np.int64)
        np.maximum.at(self.largest, self.terms, self.p)
        self.seen = np.zeros(terms, dtype=np.int64)  # an item's counts, while it is scored

    def search(self, terms: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may score `least` or more, and their exact scores above 0."""
        most = counts * self.largest[terms]
        alive = most > 0
        terms, counts, most = terms[alive], counts[alive], most[alive]
        none = np.zeros(0, dtype=np.int64)
        if not len(terms) or math.sqrt(float((counts.astype(float) ** 2).sum())) * self.longest * SLACK < least or most.sum() < least:
            return none, none
        order = np.argsort(-most, kind="stable")
        focus, rest = order[:FOCUS], order[FOCUS:]
        part, squares = np.zeros(len(self.rows)), np.zeros(len(self.rows))
        for t, c in zip(terms[focus], counts[focus]):
            at = slice(self.starts[t], self.starts[t + 1])
            p = self.p_by_term[at].astype(float)
            part[self.doc_by_term[at]] += c * p
            squares[self.doc_by_term[at]] += p * p
        left = math.sqrt(float((counts[rest].astype(float) ** 2).sum())) * np.sqrt(np.maximum(self.norm**2 * SLACK - squares, 0))
        bound = (part + np.minimum(left, float(most[rest].sum()))) * SLACK
        rows = np.flatnonzero(bound >= max(least, 1))
        if not len(rows):
            return none, none
        sizes = self.edges[rows + 1] - self.edges[rows]
        where = np.repeat(self.edges[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        self.seen[terms] = counts
        products = self.seen[self.terms[where]] * self.p[where]
        self.seen[terms] = 0
        scores = np.add.reduceat(products, np.cumsum(sizes) - sizes)
        return rows[scores > 0], scores[scores > 0]


def best(laid: DataFrame, items: Items, least: np.ndarray, top: int) -> DataFrame:
    """item (its number), doc_id, score: each task's best documents of each item, at least `least` in score."""
    known = laid.sparkSession.sparkContext.broadcast((items.terms, items.counts, least, len(items.vocabulary)))

    def run(parts):
        terms, counts, least, size = known.value
        least, pools = least.copy(), {}
        for batch in parts:
            if not batch.num_rows:
                continue
            bucket, ids = Bucket(batch, size), batch.column("doc_id")
            for k in range(len(terms)):
                rows, scores = bucket.search(terms[k], counts[k], int(least[k]))
                if not len(rows):
                    continue
                held = pools.get(k, [])
                if len(rows) > top:  # ties with the last one stay for the order by id
                    last = np.partition(scores, -top)[-top]
                    rows, scores = rows[scores >= last], scores[scores >= last]
                    order = np.lexsort((bucket.ids[rows], -scores))[:top] if len(rows) > 4 * top else slice(None)
                    rows, scores = rows[order], scores[order]
                held += zip((-scores).tolist(), [(i is None, i or 0) for i in ids.take(pa.array(rows)).to_pylist()])
                pools[k] = held = sorted(held)[:top]
                if len(held) == top:
                    least[k] = max(least[k], -held[-1][0])
        rows = [(k, None if none else doc, -score) for k, held in pools.items() for score, (none, doc) in held]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return laid.mapInArrow(run, "item int, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each item, by way of the best of 64 parts of them."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    part = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    few = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def weights_of(stored: DataFrame, documents: int, terms: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term of the vocabulary."""
    df = np.zeros(terms, dtype=np.int64)
    counts = stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toPandas()  # a row a term
    df[counts["term"].to_numpy(dtype=np.int64)] = counts["df"].to_numpy(dtype=np.int64)
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, root: str | None = None, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item."""
    spark = docs.sparkSession
    root = root or work_dir(spark, "lexical")
    asked = queries.select(F.col(item_col).cast("long").alias("item_id"), text_of(item_text).alias("text")).filter(F.col("text").rlike(WORD))
    parts = slices(asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"], item_bytes)
    answers = None
    for part in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).toArrow()  # about item_bytes
        items = Items.of(list(zip(mine.column("item_id").to_pylist(), mine.column("text").to_pylist())))
        stored = cut(vectors(docs, items.vocabulary, id_col, text_col), f"{root}/{part}/counts")
        total = stored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(1)).alias("length")).first()
        weights = weights_of(stored, total["n"], len(items.vocabulary))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slices(total["n"], PER_TASK))
        spread = impacts(stored, weights, total["n"], total["length"]).withColumn("deal", F.xxhash64("doc_id", "terms"))  # equal lengths are dealt out, too
        laid = cut(spread.repartitionByRange(tasks, F.desc("norm"), "deal").sortWithinPartitions(F.desc("norm")).drop("deal"), f"{root}/{part}/vectors")
        least = np.zeros(len(items.ids), dtype=np.int64)
        sample = laid.sample(min(0.1, SAMPLE / max(total["n"], 1)), seed=7)
        for r in ranked(best(sample, items, least, top), top).filter(F.col("rank") == top).toLocalIterator():  # a row an item
            least[r["item"]] = r["score"]
        names = spark.createDataFrame([(k, i) for k, i in enumerate(items.ids)], "item int, item_id long")
        found = ranked(best(laid, items, least, top), top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        answers = found if answers is None else answers.unionByName(found)
    return answers


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS terms FROM documents WHERE text IS NOT NULL),
  d AS (SELECT row, doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
  c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM d),
  i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS terms FROM benchmark WHERE text IS NOT NULL),
  q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
  p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  f AS (SELECT term, floor(1000 * ln((2 * max(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
  s AS (SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l))))::BIGINT AS score FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY ALL)
  SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""
