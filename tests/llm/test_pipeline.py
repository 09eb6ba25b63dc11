"""Every stage of the pipeline on its own input, held against brute force."""

import re
import zlib
from collections import defaultdict

import corpus_pipeline as pipeline
import numpy as np
import pytest
from test_near_dedup import brute as near_brute
from treeline.llm import near_dedup, packing, quality
from treeline.llm.shared import cut, work_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"


def planted():
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 8)))) for _ in range(600)]
    word = lambda n: list(rng.choice(vocabulary, n))
    passage, texts = " ".join(word(70)), []
    for _ in range(25):
        base = word(int(rng.integers(60, 300)))
        for _ in range(int(rng.integers(1, 5))):
            x = list(base)
            for _ in range(int(rng.integers(0, 3))):
                x[int(rng.integers(0, len(x)))] = "changed"
            texts.append(" ".join(x))
    texts += [f"{' '.join(word(80))} {passage} {' '.join(word(90))}" for _ in range(6)]
    texts += [texts[0].replace(" ", "\t"), texts[3], "", None, " ", "one", "one", " ".join(word(30_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, texts[5])]
    return [(d, t, "en", "s", None if t is None else len(t), "x") for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return cut(spark.createDataFrame(planted(), SCHEMA), work_dir(spark, "planted"))


def rows_of(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep_id"]
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def removed(rows, length=200):
    """Texts without the bytes that a repeated string of 200 bytes covers."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    starts = defaultdict(list)
    for k, (_, x) in enumerate(raw):
        for i in range(len(x) - length + 1):
            starts[x[i : i + length]].append((k, i))
    gone = [np.zeros(len(x), dtype=bool) for _, x in raw]
    for places in starts.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = True
    return sorted(((d, bytes(np.frombuffer(x, np.uint8)[~g]).decode("utf-8", "replace")) for (d, x), g in zip(raw, gone)), key=str)


def test_quality_keeps_what_the_operator_accepts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"] for r in pipeline.quality_stage(spark, docs, sf).collect()}
    want = {r["doc_id"] for r in quality.op6_quality(spark, sf).collect() if r["predicted"]}
    assert got == want and 0 < len(got) < docs.count()


def test_exact_stage(spark, docs):
    groups = defaultdict(list)
    for d, t, *_ in planted():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = {min((d for d in ids if d is not None), default=None) for ids in groups.values()}
    got = rows_of(pipeline.exact_stage(spark, docs, ""))
    assert {d for d, _ in got} == want


def test_near_stage(spark, docs):
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    comp = near_brute([(r["doc_id"], r["text"]) for r in once.collect()])
    got = rows_of(pipeline.near_stage(spark, once, ""))
    assert {d for d, _ in got} == {d for d, c in comp.items() if d == c} and len(got) < once.count()


def test_repeats_stage(spark, docs):
    want = removed([(d, t) for d, t, *_ in planted()])
    out = pipeline.repeats_stage(spark, docs, "")
    assert rows_of(out) == want
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_packing_stage(spark, docs):
    got = pipeline.packing_stage(spark, docs, "").collect()
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    assert sum(r["piece"] == 0 for r in got) == len(planted())


def test_run_is_the_stages_in_turn_and_takes_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf), work_dir(spark, "turn"))
    want = pipeline.STAGES[-1][1](spark, docs, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, pipeline.run(spark, sf).select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    empty = docs.limit(0)
    assert all(stage(spark, empty, sf).count() == 0 for _, stage in pipeline.STAGES)


def test_run_keeps_one_of_repeated_rows_and_null_ids(spark, monkeypatch):
    rng = np.random.default_rng(9)
    a, b, c, d, e = (" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(120)) for _ in range(5))
    near = d.split()
    near[50] = "changed"
    rows = [(1, a), (1, a), (None, b), (None, b), (None, b.replace(" ", "\t", 1)), (3, c), (None, c), (7, c), (None, d), (None, " ".join(near)), (1, e)]
    home = work_dir(spark, "repeated")
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{home}/documents.parquet")
    monkeypatch.setattr(pipeline, "STAGES", pipeline.STAGES[1:])  # the classifier would drop such texts
    got = pipeline.run(spark, home).select("doc_id", "piece", "length", "ids_crc32").collect()
    encode = packing.encoder()

    def of(doc, text):
        ids = np.array([*encode(text), packing.END], dtype="<u4")
        return [(doc, k, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids), 1024))]

    # of equal or near rows without ids any may stay
    wants = [
        sorted([*of(1, a), *of(None, x), *of(3, c), *of(None, y), *of(1, e)], key=str)
        for x in (b, b.replace(" ", "\t", 1))
        for y in (d, " ".join(near))
    ]
    assert sorted(map(tuple, got), key=str) in wants


def test_stages_keep_columns_of_any_name(spark, sf, monkeypatch):
    names = ["_id", "_sha", "_text", "_doc", "_hash", "_spans", "_row", "component", "rep", "keep", "digest", "group", "doc", "row", "Text_"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    for _, stage in pipeline.STAGES[:-1]:
        wide = cut(stage(spark, wide, sf), work_dir(spark, "wide"))
        assert wide.columns == docs.columns + names
        rows = wide.select("doc_id", *names).collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    home = work_dir(spark, "wide")
    docs.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names]).write.parquet(f"{home}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{home}/labels.parquet")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = (sorted(map(tuple, pipeline.run(spark, x).select(key).collect())) for x in (home, sf))
    assert a == b


def exchanges(df):
    """Shuffles and broadcasts of the plan that is still to run."""
    return len(re.findall(r"\bExchange |BroadcastExchange ", df._jdf.queryExecution().executedPlan().toString()))


def test_near_stage_stores_its_joins_one_by_one(spark, docs):
    """The driver holds the tasks of all exchanges of one plan at once: what is left to run joins once."""
    assert exchanges(pipeline.near_stage(spark, docs, "")) <= 2
    assert exchanges(near_dedup.near_copies(docs)) <= 2
