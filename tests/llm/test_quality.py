import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from treeline.llm import quality


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = quality.op6_quality(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    truth = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = got[got["held_out"]].merge(truth, on="doc_id")
    good, bad = held[held["quality"] == 1]["score"], held[held["quality"] == 0]["score"]
    assert len(good) > 20 and len(bad) > 3
    assert np.mean([(good > b).mean() for b in bad]) > 0.9  # area under the curve
    import zlib

    assert (got["held_out"] == got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()


def test_vote_is_brute_force():
    rng = np.random.default_rng(0)
    known, x = quality.unit(rng.standard_normal((300, 8))), quality.unit(rng.standard_normal((40, 8)))
    labels = rng.integers(0, 2, 300).astype(float)
    got = quality.vote(x, known, labels, 0.5, 10)
    for v, s in zip(x, got):
        near = sorted(range(300), key=lambda i: -(known[i] @ v))[:10]
        w = np.array([max(0, known[i] @ v) ** quality.POWER for i in near])
        assert abs(s - (w @ labels[near]) / w.sum()) < 1e-9


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (3, "good words here", "d"), (3, "good words here", "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (3, None), (4, 0), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, labels).toPandas()
    assert len(got) == 5 and got["score"].between(0, 1).all()
    none = quality.score(docs, labels.limit(0)).toPandas()
    assert (none["score"] == 0.5).all() and (none["predicted"] == 1).all()
    assert quality.score(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F
    from treeline.llm.shared import fold_of

    flipped = labels.withColumn("quality", F.when(fold_of(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(docs, x).toPandas().sort_values("doc_id")["score"].to_numpy() for x in (labels, flipped))
    pd.testing.assert_series_equal(pd.Series(a), pd.Series(b))


def plain(docs, labels, train, dims, k):
    """The whole classifier in one process: every text, dense vectors, all products."""
    import numpy.linalg as la

    hashed = quality.Hashed()
    found = {d: quality.counts(t or "", hashed) for d, t in docs}
    df = np.zeros(quality.WIDTH)
    for feature, _ in found.values():
        df[feature] += 1
    idf = np.log((1 + len(found)) / (1 + df)) + 1
    x = np.zeros((len(found), quality.WIDTH))
    for row, (feature, n) in zip(x, found.values()):
        feature, w = quality.weighted(feature, n, idf)
        row[feature] = w
    at = {d: i for i, d in enumerate(found)}
    taught = [d for d in sorted(labels) if d in at and train(d)]
    space = la.svd(x[[at[d] for d in taught]], full_matrices=False)[2][:dims].T
    y = quality.unit(x @ space)
    known, truth = y[[at[d] for d in taught]], np.array([labels[d] for d in taught], dtype=float)
    out = {}
    for d in found:
        sims = known @ y[at[d]]
        near = np.argsort(-sims)[:k]
        w = np.clip(sims[near], 0, None) ** quality.POWER
        out[d] = float(w @ truth[near] / w.sum()) if w.sum() else float(truth.mean())
    return out


def test_scores_are_those_of_a_plain_pass_over_whole_texts(spark, sf):
    import zlib

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = plain(docs, labels, lambda d: zlib.crc32(str(d).encode()) % 5 != 0, quality.DIMS, quality.NEIGHBOURS)
    got = {r["doc_id"]: r["score"] for r in quality.op6_quality(spark, sf).collect()}
    off = np.array([abs(got[d] - want[d]) for d in want])
    # subspace iteration stops short of the singular vectors of like weight, so single votes may differ
    assert got.keys() == want.keys() and np.mean(off) < 0.02 and np.mean(off > 0.1) < 0.03


def test_a_repeated_id_teaches_alike_in_any_order(spark):
    rows = [(3, "good words here", 0), (3, "OTHER THINGS", 1), (4, "good words there", 2), (6, "other THINGS 1", 3), (None, "good", 4)]
    labels = spark.createDataFrame([(3, 1), (6, 0), (4, 1)], "doc_id long, quality int")
    found = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, _hash int").repartition(1)
        found.append(sorted(quality.score(df, labels, train=F.lit(True)).select("doc_id", "score").collect(), key=str))
    assert found[0] == found[1]


def test_the_sample_reaches_the_driver_as_arrays(spark, sf):
    """No Python object for each of its numbers: the rows are views of one array."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    taken = quality.labelled_sample(docs, labels, "doc_id", "text", "quality", F.lit(True), 8192)
    rows, n = quality.ragged(taken["feature"]), quality.ragged(taken["n"])
    assert len(rows) == taken.num_rows == labels.count() and all(len(a) == len(b) > 0 for a, b in zip(rows, n))
    assert all(x.base is not None and x.base is rows[0].base for x in rows)
    assert [x.tolist() for x in rows] == taken["feature"].to_pylist()
    assert [x.tolist() for x in quality.ragged(taken["feature"].slice(3, 2))] == taken["feature"].to_pylist()[3:5]
    assert quality.ragged(taken["feature"].slice(0, 0)) == []
