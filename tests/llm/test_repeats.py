import hashlib
from collections import Counter

import numpy as np
import pytest
from treeline.llm import repeats


def brute(rows, length=200):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[i : i + length] for _, x in raw for i in range(len(x) - length + 1))
    out = []
    for d, x in raw:
        gone = np.zeros(len(x) + 1, dtype=bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(x), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(df):
    rows = repeats.with_spans(df).select("doc_id", repeats.digests("_text", "_spans").alias("r")).select("doc_id", "r.*").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_planted_and_random(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdé ñ"), n))
    shared = [word(n) for n in (120, 190, 199, 200, 201, 260, 500, 900)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.integers(1, 5)):
            s = shared[rng.integers(len(shared))]
            a = int(rng.integers(0, 40))
            parts += [word(int(rng.integers(0, 80))), s[a:], s[: len(s) - a]]
        rows.append((i, "".join(parts)))
    base = word(3000)
    for i in range(12):  # near copies
        x = list(base)
        for at in rng.integers(0, len(x), 6):
            x[at] = "Z"
        rows.append((100 + i, "".join(x)))
    rows += [(200, "a" * 1000), (201, "ab" * 300), (202, "a" * 199), (203, ""), (204, None), (205, word(250)), (206, word(199))]
    rows += [(300, word(400))] * 2 + [(None, word(300))]
    rows += [(400, rows[0][1]), (401, rows[0][1])]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_query_is_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in repeats.op8_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, spans string, full string"
    assert run(spark.createDataFrame([], schema)) == []
    assert run(spark.createDataFrame([(1, None, "x", "y")], schema)) == brute([(1, None)])


def test_equal_rows_share_one_set_of_spans(spark):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefgh"), 2000))
    size = {}
    for n in (2, 2000):
        df = spark.range(n, numPartitions=4).selectExpr("cast(null as long) as doc_id", f"'{text}' as text")
        size[n] = {len(r["_spans"]) for r in repeats.with_spans(df).collect()}
    assert size[2] == size[2000] and len(size[2]) == 1


def test_ranks_are_those_of_sorted_strings(spark):
    from treeline.llm.shared import work_dir

    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("aab"), n)) for n in (300, 90, 19, 20)] + ["ab" * 40, "a" * 100, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    for length in (20, 8, 5):
        place = {(d, i): t[i : i + length] for d, t in enumerate(texts) if t for i in range(len(t) - length + 1)}
        count = Counter(place.values())
        want = sorted((k for k, s in place.items() if count[s] > 1), key=lambda k: (place[k], k))
        got = {(r["doc"], r["pos"]): r["rank"] for r in repeats.ranks(df, work_dir(spark, "ranks"), length).collect()}
        assert sorted(got, key=lambda k: (got[k], k)) == want
        assert all((got[x] == got[y]) == (place[x] == place[y]) for x, y in zip(want, want[1:]))


def test_ranks_give_the_operator_s_spans(spark, sf):
    """The dealt method in its plain form against the registered query, on some whole texts."""
    from treeline.llm.shared import work_dir

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows if len(t) < 3000]
    gone = {d: np.zeros(len(t.encode()), dtype=bool) for d, t in rows}
    for r in repeats.ranks(spark.createDataFrame(rows, "doc long, text string"), work_dir(spark, "ranks")).collect():
        gone[r["doc"]][r["pos"] : r["pos"] + 200] = True
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: r[2] for r in got} == {d: int(g.sum()) for d, g in gone.items()} and any(g.any() for g in gone.values())


def test_slabs(monkeypatch):
    rng = np.random.default_rng(0)
    for letters in (4, 1):
        data = rng.integers(97, 97 + letters, 5000).astype(np.uint8)
        whole = repeats.anchors(data)
        monkeypatch.setattr(repeats, "SLAB", 700)
        again = repeats.anchors(data)
        monkeypatch.undo()
        assert [x.tolist() for x in whole] == [x.tolist() for x in again]
        # every window names one anchor that it holds
        at, _, lo, hi = whole
        starts = sorted(int(a - d) for a, x, y in zip(at, lo, hi) for d in range(x, y + 1))
        assert starts == list(range(len(data) - repeats.LENGTH + 1))
        assert lo.min() >= 0 and hi.max() < repeats.STARTS


def test_anchors_of_a_long_run_come_in_bounded_parts(spark):
    import resource

    data = np.full(20 << 20, 32, dtype=np.uint8)
    was, n = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    for slab in repeats.anchor_slabs(data):
        n += len(slab[0])
    assert n == (20 << 20) - repeats.LENGTH + 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - was < 700 << 10  # KB
    text = " " * 300_000
    rows = [(1, text), (2, text[:5000]), (3, "a" + text[:150] + "b"), (4, None)]
    got = {r["doc_id"]: r["_spans"] for r in repeats.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] is None and got[4] is None
    assert {k: [(x["s"], x["e"]) for x in got[k]] for k in (1, 2)} == {1: [(0, 300_000)], 2: [(0, 5000)]}  # touching spans are one


def test_jobs_do_not_grow_with_shuffle_partitions(spark):
    """The bit filters reach the driver in few jobs, also if nothing puts small partitions together."""
    docs = spark.createDataFrame([(1, "ab" * 300), (2, "x" * 150 + "ab" * 200), (3, None)], "doc_id long, text string")
    several = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in several}
    try:
        for k, v in several.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("filters", "jobs of one call")
        got = {r["doc_id"]: r["_spans"] for r in repeats.with_spans(docs).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got[1] is not None and got[2] is not None and got[3] is None
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("filters")) < 120  # 61 a filter before, and those of all else
