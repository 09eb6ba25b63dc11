import math
import re
from collections import Counter

import duckdb
import numpy as np
from treeline.llm import lexical


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, top):
    found = [(i, Counter(split(t)), len(split(t))) for i, t in docs if split(t)]
    n, length = len(found), sum(x[2] for x in found)
    df = Counter(t for _, tf, _ in found for t in tf)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        rows = []
        for doc, tf, size in found:
            m = 75 + (25 * size * n) // length
            score = sum(c * w[t] * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, c in Counter(split(text)).items() if t in tf)
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, k, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def read(spark, sf, table, key):
    return [(r[key], r["text"]) for r in spark.read.parquet(f"{sf}/{table}.parquet").collect()]


def test_query_is_brute_force(spark, sf):
    assert rows(lexical.op12_lexical_search(spark, sf)) == brute(read(spark, sf, "documents", "doc_id"), read(spark, sf, "benchmark", "item_id"), 20)


def test_items_in_parts(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    assert rows(lexical.search(docs, items, item_bytes=2000, top=3)) == brute(read(spark, sf, "documents", "doc_id"), read(spark, sf, "benchmark", "item_id"), 3)


def test_ties_nulls_repeats_and_names(spark):
    docs = [(k, "tie alpha") for k in range(200, 0, -1)] + [(None, "tie alpha"), (5, "tie alpha"), (6, None), (7, ""), (8, "...!"), (9, "Alpha ALPHA é beta"), (10, "Éa " + "long " * 50_000), (2**62, "tie alpha"), (2**62 + 1, "tie alpha")]
    items = [(1, "alpha"), (1, "alpha"), (2, None), (3, "!!"), (4, "nowhere"), (None, "beta beta É"), (5, "long alpha tie")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, norm int")
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    for top in (1, 20, 500):
        assert rows(lexical.search(d, q, top=top)) == brute(docs, items, top)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == []
    assert lexical.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).collect() == []


def test_bounds_never_lose_a_document():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = [{t: int(p) for t, p in zip(rng.choice(30, size=rng.integers(1, 12), replace=False), rng.lognormal(12, 2, size=12))} for _ in range(400)]
    edges = np.cumsum([0, *map(len, rows)])
    p = np.array([x for r in rows for x in r.values()])
    lists = pa.array(edges, type=pa.int32())
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(400)), pa.array([math.sqrt(sum(float(x) ** 2 for x in r.values())) for r in rows]), pa.ListArray.from_arrays(lists, pa.array([int(t) for r in rows for t in r], type=pa.int32())), pa.ListArray.from_arrays(lists, pa.array(p))],
        ["doc_id", "norm", "terms", "impacts"],
    )
    bucket = lexical.Bucket(batch, 30)
    pruned = 0
    for _ in range(50):
        terms = rng.choice(30, size=rng.integers(1, 10), replace=False)
        counts = rng.integers(1, 4, size=len(terms))
        full = [sum(int(c) * r.get(int(t), 0) for t, c in zip(terms, counts)) for r in rows]
        least = sorted(full)[-5]
        found, scores = bucket.search(terms, counts, least)
        assert all(full[k] == s for k, s in zip(found, scores))
        assert {k for k, s in enumerate(full) if s >= max(least, 1)} <= set(found.tolist())
        pruned += 400 - len(found)
    assert pruned > 50 * 300


def test_sql_on_hard_rows(spark, tmp_path):
    docs = [(1, "A b\x00c é É"), (2, None), (3, ""), (4, "b É"), (5, "7 B b")]
    items = [(1, "É b"), (2, "C 7"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(c.sql(lexical.SQL).fetchall()) == sorted(rows(lexical.op12_lexical_search(spark, str(tmp_path)))) == sorted(brute(docs, items, 20))
