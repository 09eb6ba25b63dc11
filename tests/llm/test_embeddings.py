import numpy as np
import pytest
from treeline.llm import embeddings
from treeline.llm.components import components


def brute(ids, vectors, cosine=0.9):
    n = len(ids)
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v) for v in vectors]
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = (np.array(v, float) / np.abs(v).max() for v in (vectors[i], vectors[j]))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i].append(j)
    comp = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                if comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return {ids[i]: (len(links[i]), comp[i], comp[i] == ids[i]) for i in range(n)}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("cell,block", [(8192, 4096), (30, 16)])
def test_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    vectors = [(base[rng.integers(40)] + rng.standard_normal(8) * rng.choice([0.05, 0.3, 0.6])).tolist() for _ in range(300)]
    vectors += [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8, [1.0] * 7, [1e-200] * 8, [1e200] * 8]
    vectors += [base[0].tolist()] * 20
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors, ["x"] * len(ids))), "vec_id long, embedding array<double>, n_links string")
    assert result(embeddings.near_vectors(df)) == brute(ids, vectors)


def test_query_is_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert result(embeddings.op1_embedding_near_dedup(spark, sf)) == brute([r[0] for r in rows], [r[1] for r in rows])


def test_nulls_repeats_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    triples = lambda rows: sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, schema)).collect())
    a, b = [1.0, 0.0], [0.0, 1.0]
    assert triples([(None, a), (5, a), (5, a), (7, b)]) == [(0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True)]
    # rows that repeat an id are told apart, in any order
    rows = [(1, a), (1, b), (2, a), (3, [1.0, 0.1]), (4, [1.0, 0.2]), (5, None), (5, [0.1, 1.0]), (None, None), (None, [-1.0, 0.0])]
    want = sorted([(1, 3, 1, True), (1, 1, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 0, 5, True), (5, 1, 1, False), (0, 0, 0, True), (0, 0, 0, True)])
    assert triples(rows) == want == triples(rows[::-1])
    assert embeddings.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_planes_between_pivots_keep_vectors_out(spark, monkeypatch):
    """Clusters far apart: each vector stays in few cells, and nothing is lost."""
    monkeypatch.setattr(embeddings, "CELL", 40)
    rng = np.random.default_rng(7)
    base = embeddings.unit_rows(rng.standard_normal((10, 4)).tolist())[0]
    vectors = [(base[i % 10] + 0.04 * rng.standard_normal(4)).tolist() for i in range(400)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    assert result(embeddings.near_vectors(df, cosine=0.97)) == brute(range(400), vectors, 0.97)


def test_components(spark):
    import tempfile

    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 80), (200, 200), (300, 301), (301, 302), (300, 302)]
    got = components(spark.createDataFrame(edges, "a long, b long"), "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    want = {i: 1 for i in range(1, 61)} | {100: 80, 90: 80, 80: 80, 300: 300, 301: 300, 302: 300}
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_equal_vectors_count_as_many(spark, monkeypatch):
    """A third of the rows repeat one vector: each copy has all its links."""
    monkeypatch.setattr(embeddings, "CELL", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(11)
    hot, other = [1.0, 0.0, 0.0, 0.0], rng.standard_normal((20, 4)).tolist()
    vectors = [hot] * 100 + other * 5 + [[0.95, 0.1, 0.0, 0.0]] * 3 + [[2.0, 0.0, 0.0, 0.0]] * 2 + [None] * 5
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")
    assert result(embeddings.near_vectors(df)) == brute(ids, vectors)


def test_no_vector_goes_to_disk_for_each_cell_or_block(spark, monkeypatch):
    """Blocks meet without a shuffle; equal vectors of several batches of rows are one."""
    monkeypatch.setattr(embeddings, "CELL", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    plans, cut = {}, embeddings.cut
    monkeypatch.setattr(embeddings, "cut", lambda df, path, *a: [plans.update({path.rsplit("/")[-1]: df._jdf.queryExecution().executedPlan().toString()}), cut(df, path, *a)][1])
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((90, 6)).astype(np.float32).tolist() + [[0.5, 0.25, 0.0, 0.0, 0.0, 1.0]] * 60 + [[1.0, 0.5, 0.0, 0.0, 0.0, 2.0]] * 3
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert result(embeddings.near_vectors(df)) == brute(ids, vectors)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert "Exchange" not in plans["found"] and "CartesianProduct" in plans["found"]
