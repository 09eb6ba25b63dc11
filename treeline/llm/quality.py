"""Quality by nearest-neighbour voting in a latent-semantic space.

Document frequencies of hashed terms cover all documents; terms share FEATURES features by their
crc32, a bound that does not grow with the vocabulary (README: what it costs). A bounded sample of labelled rows
(`sample` of them, the smallest by a hash of the id) gives the latent space, a truncated singular
value decomposition of their tf-idf vectors, and is broadcast as the labelled vectors: at most
sample * dims numbers. Every document's vector is compared with all labelled ones, a block at a
time, by exact cosine products, and the labels of the `k` nearest vote with their similarity.

Terms are lower-case letter runs, digit runs, runs of other signs and line ends, and two more: a
word in capitals and a word equal to the one before. Labels, language, source and ids are no inputs.

Defined results: null and empty texts, and texts whose vector is zero, get the labelled sample's
mean label; without any label that is 0.5. A document with several label rows has their majority,
ties count as 1; null labels are left out. Ids that repeat are scored row by row; the text of the
smallest hash among a repeated id's rows teaches. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold_of, table, text_of

FEATURES = 1 << 14
CAPITALS, REPEAT = FEATURES, FEATURES + 1
WIDTH = FEATURES + 2
SAMPLE = 8192  # labelled rows that are fitted and vote, at most
DIMS = 64
NEIGHBOURS = 25
SPECIAL = 2.0  # weight of a text all in capitals, or of one repeated word, against all its other terms
POWER = 8  # of the similarity, as a vote's weight
THRESHOLD = 0.3
BLOCK = 512  # documents of one product

TERMS = re.compile(r"[^\W\d_]+|[\d_]+|[^\w\s]+|\n")


class Hashed(dict):
    """term -> feature, and a bit above for capitals."""

    def __missing__(self, term: str) -> int:
        if len(self) > 300_000:
            self.clear()
        code = zlib.crc32(term.lower().encode()) % FEATURES | (FEATURES << 1 if len(term) > 1 and term.isupper() else 0)
        self[term] = code
        return code


def counts(text: str, hashed: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often it has each."""
    terms = TERMS.findall(text)
    codes = np.fromiter(map(hashed.__getitem__, terms), dtype=np.int64, count=len(terms))
    ids = codes & (FEATURES - 1)
    feature, n = np.unique(ids, return_counts=True)
    capitals, repeats = int((codes > FEATURES).sum()), int((ids[1:] == ids[:-1]).sum())
    extra = [(f, c) for f, c in ((CAPITALS, capitals), (REPEAT, repeats)) if c]
    if extra:
        feature, n = np.append(feature, [f for f, _ in extra]), np.append(n, [c for _, c in extra])
    return feature, n


def weighted(feature: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tf-idf vector of length 1, sparse, from a text's counts."""
    w = (1 + np.log(n)) * idf[feature]
    special = feature >= FEATURES
    if special.any():  # shares of the terms, on the scale of all else
        w[special] = SPECIAL * n[special] / n[~special].sum() * np.sqrt((w[~special] ** 2).sum())
    size = np.sqrt((w * w).sum())
    return feature, (w / size if size else w).astype(np.float32)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and the number of documents."""

    def run(frames):
        hashed, df, seen = Hashed(), np.zeros(WIDTH + 1, dtype=np.int64), 0
        for pdf in frames:
            for text in pdf["text"]:
                df[counts(text, hashed)[0]] += 1
            seen += len(pdf)
        df[WIDTH] = seen
        at = np.flatnonzero(df)
        yield pd.DataFrame({"feature": at.astype(np.int32), "n": df[at]})

    rows = docs.select(text_of(text_col).alias("text")).mapInPandas(run, "feature int, n long")
    total = np.zeros(WIDTH + 1, dtype=np.int64)
    for r in rows.groupBy("feature").agg(F.sum("n").alias("n")).collect():  # at most WIDTH + 1 rows
        total[r["feature"]] = r["n"]
    return total[:WIDTH], int(total[WIDTH])


def latent(rows: list[tuple[np.ndarray, np.ndarray]], dims: int, rounds: int = 4) -> np.ndarray:
    """WIDTH x dims: right singular vectors of the sparse rows, by subspace iteration."""
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((WIDTH, dims)))[0].astype(np.float32)
    for _ in range(rounds):
        z = np.zeros((WIDTH, dims), dtype=np.float32)
        for feature, w in rows:
            z[feature] += np.outer(w, w @ q[feature])
        q = np.linalg.qr(z)[0].astype(np.float32)
    return q


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, prior: float, k: int) -> np.ndarray:
    """Scores of unit vectors (or zero ones) by their k nearest labelled vectors."""
    out = np.full(len(vectors), prior)
    if not len(known):
        return out
    k = min(k, len(known))
    for at in range(0, len(vectors), BLOCK):
        sims = vectors[at : at + BLOCK] @ known.T
        near = np.argpartition(sims, len(known) - k, axis=1)[:, len(known) - k :]
        w = np.clip(np.take_along_axis(sims, near, axis=1), 0, None).astype(np.float64) ** POWER
        total = w.sum(axis=1)
        some = total > 0
        out[at : at + BLOCK][some] = np.clip((w * labels[near]).sum(axis=1)[some] / total[some], 0, 1)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: F.Column, sample: int) -> pa.Table:
    """(hash, feature, n, label) of the training rows with the smallest hashes, at most `sample`; no text leaves its task."""
    truth = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    # a broadcast of at most `sample` ids; the texts stay where they are
    chosen = truth.filter(train & F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample)

    def run(frames):
        hashed = Hashed()
        for pdf in frames:
            found = [counts(t, hashed) for t in pdf["_text"]]
            yield pd.DataFrame({"_id": pdf["_id"], "hash": pdf["_hash"], "feature": [f for f, _ in found], "n": [n for _, n in found], "label": pdf["_label"]})

    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), F.xxhash64(text_of(text_col)).alias("_hash")).join(F.broadcast(chosen.withColumnRenamed(id_col, "_id")), "_id")
    kind = docs.schema[id_col].dataType.simpleString()
    made = texts.mapInPandas(run, f"_id {kind}, hash long, feature array<int>, n array<int>, label int")
    one = made.groupBy("_id").agg(F.min(F.struct("hash", "feature", "n", "label")).alias("x"))
    return one.orderBy("_id").select("x.*").toArrow()


def ragged(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a column of lists, all views of one array: no object for each number."""
    whole = lists.combine_chunks()
    flat, ends = whole.flatten().to_numpy(), np.cumsum(whole.value_lengths().to_numpy())
    return [flat[a:b] for a, b in zip(np.append(0, ends[:-1]), ends)]


def scorer(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train: F.Column | None = None,
    sample: int = SAMPLE,
    dims: int = DIMS,
    k: int = NEIGHBOURS,
):
    """Fit on docs and labels; a function of a text column that gives the score. train: which ids may be learnt from."""
    train = fold_of(F.col(id_col)) != 0 if train is None else train
    df, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    taken = labelled_sample(docs, labels, id_col, text_col, label_col, train, sample)
    rows = [weighted(f.astype(np.int64), c.astype(np.int64), idf) for f, c in zip(ragged(taken["feature"]), ragged(taken["n"]))]
    truth = taken["label"].to_numpy().astype(np.float64)
    prior = float(truth.mean()) if len(truth) else 0.5
    space = latent(rows, dims) if rows else np.zeros((WIDTH, dims), dtype=np.float32)
    known = unit(np.array([w @ space[f] for f, w in rows], dtype=np.float32).reshape(-1, dims))
    shared = docs.sparkSession.sparkContext.broadcast((idf, space, known, truth, prior))
    hashed = Hashed()

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        idf, space, known, truth, prior = shared.value
        x = np.zeros((len(text), dims), dtype=np.float32)
        for i, t in enumerate(text):
            feature, w = weighted(*counts(t, hashed), idf)
            x[i] = w @ space[feature]
        return pd.Series(vote(unit(x), known, truth, prior, k))

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, train: F.Column | None = None, **fit) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted."""
    train = fold_of(F.col(id_col)) != 0 if train is None else train
    good = scorer(docs, labels, id_col, text_col, train=train, **fit)
    rows = docs.select(F.col(id_col), (~train).alias("held_out"), good(text_of(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
