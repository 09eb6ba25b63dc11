"""Exact dedup under collisions, the shard store, archives and packing."""

import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from treeline.llm import exact_dedup, packing, sharding, warc
from treeline.llm.sharding import ShardStore


def fresh():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_dedup_survives_digest_collisions(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (4, "c"), (9, None), (8, ""), (7, "d" * 5000), (None, "c"), (6, "a b ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, keep_id string")
    want = {(5, 3, 2, False), (3, 3, 2, True), (4, 4, 2, True), (None, 4, 2, False), (9, 8, 2, False), (8, 8, 2, True), (7, 7, 1, True), (6, 6, 1, True)}
    for digest in (exact_dedup.sha256, lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0)):
        got = exact_dedup.exact_dedup(df, digest=digest).collect()
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == want
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == []


def test_shards_commit_once_and_old_versions_stay(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text"))
    store = ShardStore(spark, fresh(), "doc_id", "text", target=4000, smallest=500)
    store.append(df.filter("doc_id < 200"), F.floor(F.col("doc_id") / 10))
    store.append(df.filter("doc_id >= 200"), F.floor(F.col("doc_id") / 10))
    before = store.manifest(2).count()
    assert store.compact() == 3 and store.manifest(3).count() < before == 30
    for v, n in ((1, 200), (2, 300), (3, 300)):
        assert sorted(r["doc_id"] for r in store.read(v).collect()) == list(range(n))
    with pytest.raises(RuntimeError):  # another writer was first
        store.commit(store.manifest(2), 2)
    assert store.version() == 3 and store.read().count() == 300


def test_shards_stay_whole_over_many_commits(spark):
    schema = "doc_id long, text string, lang string"
    rows = lambda ids, k: [(i, "x" * 50, f"commit {k}") for i in ids]
    store = ShardStore(spark, fresh(), "doc_id", "text", target=4000, smallest=500)
    have = []
    # arrivals overlap, ids repeat or are null, and compactions follow each other
    steps = [range(0, 105), range(55, 130), None, [None] * 30, [None] * 60, None, range(100, 190), range(190, 400), None, range(20), None]
    for k, ids in enumerate(steps):
        if ids is None:
            store.compact()
        else:
            store.append(spark.createDataFrame(rows(ids, k), schema), F.floor(F.col("doc_id") / 10))
            have += rows(ids, k)
        assert sorted(map(tuple, store.read().select("doc_id", "text", "lang").collect()), key=str) == sorted(have, key=str)
        total = store.manifest().agg(F.sum("rows"), F.sum("bytes")).first()
        assert tuple(total) == (len(have), 50 * len(have))
    small = store.manifest().filter("bytes < 4000").groupBy("tier").count().collect()
    assert sum(r["count"] for r in small) < 10


def files_of(store, listed):
    import glob

    root = store.root.removeprefix("file://")
    return {(r["folder"], r["shard"]): glob.glob(f"{root}/shards/_folder={r['folder']}/_shard={r['shard']}/*.parquet") for r in listed}


def test_each_shard_is_one_file_of_about_the_target(spark):
    df = spark.range(2000, numPartitions=8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text"))
    store = ShardStore(spark, fresh(), "doc_id", "text", target=10_000, smallest=500)
    for k in range(3):
        store.append(df.filter(F.col("doc_id") % 3 == k), F.floor(F.col("doc_id") / 10))
        store.compact()
    listed = store.manifest().collect()
    assert all(len(x) == 1 for x in files_of(store, listed).values())
    sizes = [r["bytes"] for r in listed]
    assert sum(sizes) == 2000 * 50 and max(sizes) < 2 * 10_000 and sum(s >= 5_000 for s in sizes) >= len(sizes) - 2


def test_null_ids_repeated_ids_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_ROWS", 50)
    schema = "doc_id long, text string, shard string, bytes long, tier int"
    rows = [(None, "same", "s", 1, 2)] * 400 + [(7, "same", "s", 1, 2)] * 300 + [(8, None, "s", None, None), (9, "long " * 400_000, "s", 1, 2)]
    store = ShardStore(spark, fresh(), "doc_id", "text", target=1000, smallest=100)
    store.append(spark.createDataFrame(rows, schema), F.floor(F.col("doc_id") / 10))
    assert store.manifest().agg(F.max("rows")).first()[0] < 200  # the hot arrivals are dealt out
    store.compact()
    assert sorted(map(tuple, store.read().select(*[c.split()[0] for c in schema.split(", ")]).collect()), key=str) == sorted(rows, key=str)
    assert all(len(x) == 1 for x in files_of(store, store.manifest().collect()).values())
    empty = ShardStore(spark, fresh(), "doc_id", "text")
    assert empty.append(spark.createDataFrame([], schema), F.col("doc_id")) == 1 and empty.manifest().count() == 0
    assert empty.compact() == 1
    home = fresh()
    spark.createDataFrame([], schema).write.parquet(f"{home}/documents.parquet")
    assert sharding.op4_sharding(spark, home).collect() == []
    for name in ("_shard", "_folder", "_row_sha"):
        with pytest.raises(ValueError):
            empty.append(spark.createDataFrame([(1, "x", 1)], f"doc_id long, text string, {name} int"), F.col("doc_id"))


def test_hot_arrivals_follow_the_sql(spark):
    """20,000 null ids, copies of one text among them, and an id that repeats: the same shards as one sort gives."""
    import duckdb

    rows = [(None, f"text {k % 9000} " + "x" * (5000 if k % 3 else 100)) for k in range(20_000)] + [(None, None)] * 200 + [(7, "copy" * 500)] * 17_000 + [(k, f"row {k}") for k in range(3000)]
    home = fresh()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{home}/documents.parquet")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["shard"], r["n_bytes"], r["text_sha256"]) for r in sharding.op4_sharding(spark, home).collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{home.removeprefix('file://')}/documents.parquet/*.parquet'")
    want = c.sql(f"SELECT doc_id, shard, n_bytes, text_sha256 FROM ({sharding.SQL})").fetchall()
    assert got == sorted((d is not None, d or 0, s, n, h) for d, s, n, h in want)
    assert len({x[2] for x in got if not x[0]}) > 1


def test_a_lost_writer_blocks_nobody(spark):
    import os

    root = fresh()
    store = ShardStore(spark, root, "doc_id", "text")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert store.append(rows, F.lit(1)) == 1
    open(f"{root.removeprefix('file://')}/manifest/v-000002", "w").close()
    assert store.version() == 1 and store.append(rows, F.lit(2)) == 3 == store.version()
    assert store.read().count() == 4 and os.path.exists(f"{root.removeprefix('file://')}/manifest/v-000003")
    stale = store.manifest()
    store.append(rows, F.lit(3))
    with pytest.raises(RuntimeError):
        store.commit(stale, 3)
    assert store.read().count() == 6


def test_archives_of_empty_tables_equal_largest_ids_and_long_pages(spark):
    schema = "page_id long, url string, html string, digest string"
    long = "é" * 3_000_000
    rows = [(5, "u", long, "x"), (5, "v", long, "x"), (4, "w", long, "x"), (None, None, long, None)]
    root = fresh()
    index = warc.write_archives(spark.createDataFrame(rows, schema), root)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_selected(index, root).collect())
    n = 6_000_000
    assert got == [(0, "revisit", 5, n), (4, "revisit", 5, n), (5, "response", None, n), (5, "response", None, n)]
    root = fresh()
    index = warc.write_archives(spark.createDataFrame([], schema), root)
    assert index.count() == 0 and warc.read_selected(index, root).collect() == []


def test_archives_are_read_by_as_many_tasks_as_their_bytes_ask_for(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK", 20_000)
    monkeypatch.setattr(warc, "CHUNK", 4_000)
    df = spark.range(3000, numPartitions=3).selectExpr("id as page_id", "'u' as url", "sha2(string(id), 512) as html")
    root = fresh()
    index = warc.write_archives(df, root)
    read = warc.read_selected(index, root)
    total = index.agg(F.sum("length")).first()[0]
    assert read.rdd.getNumPartitions() == -(-total // 20_000) and read.count() == 3000


def test_archives_round_trip_and_show_damage(spark):
    html = "<p>é</p>" * 200
    rows = [(1, "http://a/ b%20\n", html), (2, None, html), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (None, "n", html)]
    root = fresh()
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), root)
    got = {r["page_id"]: r for r in warc.read_selected(index, root).collect()}
    assert bytes(got[2]["payload"]).decode() == html and got[1]["refers_to"] == 2 == got[None]["refers_to"]
    assert got[1]["url"] == rows[0][1] and got[2]["url"] is None and got[3]["payload_bytes"] == 0
    assert got[4]["record_type"] == got[5]["record_type"] == "response"
    some = warc.read_selected(index.filter("page_id = 4"), root).collect()
    assert [bytes(r["payload"]) for r in some] == [b"short"]
    good = warc.record(1, "u", b"abc", "a9993e364706816aba3e25717850c26c9cd0d89d", None, False)
    assert warc.read_record(good)[2] == b"abc"
    with pytest.raises(ValueError):
        warc.read_record(warc.record(1, "u", b"abd", "a9993e364706816aba3e25717850c26c9cd0d89d", None, False))


def test_packing_is_whole_and_tight(spark, sf):
    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(9001, None), (9002, "a<|endoftext|>b")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in rows:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        mine = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in mine] == packing.cuts(len(ids), 1024)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 1024) + 2


def test_long_runs_of_blanks_are_packed(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = 2_000_000
    rows = [(1, " " * n), (2, " " * n + "x"), (3, "a" + "\n" * n + "x"), (4, "b" + " \u3000" * (n // 2) + "é"), (5, "short")]
    got = defaultdict(list)
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append(r)
    for doc, text in rows:
        ids = np.array(whole.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        mine = sorted(got[doc], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in mine] == packing.cuts(len(ids), 1024)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)


def histograms():
    rng = np.random.default_rng(0)
    yield from (rng.integers(1, 1025, n) for n in (1, 50, 3000, 20_000))
    yield from (np.clip(rng.lognormal(5, 1, n).astype(int), 1, 1024) for n in (50, 5000))
    yield rng.integers(300, 420, 4000)
    yield np.repeat([600, 424, 512, 1024, 1], [50, 50, 31, 7, 3])


def test_plans_hold_every_length_and_need_no_more_than_best_fit():
    for lengths in histograms():
        h = np.bincount(lengths, minlength=1025)
        runs, n = packing.plan(h)
        back = np.zeros(1025, dtype=np.int64)
        places = defaultdict(list)
        for length, first, times, sequence, offset in runs:
            assert first == back[length]
            back[length] += times
            for k in range(times):
                places[sequence + k].append((offset, length))
        assert (back == h).all() and len(places) == n
        for parts in places.values():
            ends = [0, *(o + m for o, m in sorted(parts))]
            assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
        assert -(-lengths.sum() // 1024) <= n <= sum(t for _, t in packing.best_fit(h, 1024))


def test_packing_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, length int, sequence_id string"
    assert packing.pack(spark.createDataFrame([], schema)).collect() == []
    got = packing.pack(spark.createDataFrame([(None, None, 1, "x"), (1, "a", 2, "y"), (1, "a", 2, "y")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 1), (1, 2), (1, 2)] and len({r["sequence_id"] for r in got}) == 1
