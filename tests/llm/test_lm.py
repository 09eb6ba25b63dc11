import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from treeline.llm import lm


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def check(rows, got):
    count = Counter(t for d, x in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(count.values()), len(count)
    want = sorted(
        (d or 0, zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1, len(tokens(x)), sum(count[t] > 0 for t in tokens(x)), n,
         sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x)))
        for d, x in rows
    )
    have = sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    for a, b in zip(want, have, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


@pytest.mark.parametrize("hot", [200_000, 300])
def test_base_is_brute_force_and_model_beats_it(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = lm.op5_lm_scoring(spark, sf).collect()
    check(rows, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, score string"
    rows = [(1, None, "x"), (2, "A b\tÉ  b", "x"), (2, "A b\tÉ  b", "x"), (None, "b c", "x"), (4, "zz " * 3000, None), (7, "new words", None)]
    check([r[:2] for r in rows], lm.lm_scores(spark.createDataFrame(rows, schema)).collect())
    assert lm.lm_scores(spark.createDataFrame([], schema)).collect() == []


def test_probabilities_add_up():
    """Emissions of a class and one unknown word, and transitions from a class, each sum to one."""
    rng = np.random.default_rng(0)
    g = rng.integers(0, 9, (lm.CLASSES, lm.CLASSES)).astype(float)
    share = (g.sum(axis=0) + 0.5) / (g.sum() + 0.5 * lm.CLASSES)
    step = (g + lm.PRIOR * share[None, :]) / (g.sum(axis=1, keepdims=True) + lm.PRIOR)
    assert np.allclose(step.sum(axis=1), 1)


def test_exchange_raises_likelihood(spark):
    # two groups of units that alternate, at uneven rates
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b), int(rng.integers(1, 50))) for x in range(1, 21) for y in range(21, 41) for a, b in ((x, y), (y, x))]
    counts = np.zeros(lm.TOTAL)
    for a, _, n in pairs:
        counts[a] += n
    bigrams = spark.createDataFrame(pairs, "a int, b int, n long")
    values = [lm.likelihood(lm.exchange(bigrams, counts, rounds=r, classes=6)[1]) for r in (0, lm.ROUNDS)]
    to, _ = lm.exchange(bigrams, counts, classes=6)
    assert values[1] > values[0]
    assert not set(to[1:21]) & set(to[21:41])


@pytest.mark.parametrize("hot,gather", [(200_000, 4_000_000), (40, 500)])
def test_score_is_the_class_model_of_all_words(spark, sf, monkeypatch, hot, gather):
    """Counts beside words, the lexicon's classes and every score, against one plain pass."""
    from treeline.llm.shared import work_dir

    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "GATHER", gather)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(None, None), (7, "new"), (7, "New new")]
    root = work_dir(spark, "lm")
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), root=root).collect()
    known = {bytes(r["word"]): (r["n"], r["class"]) for r in spark.read.parquet(f"{root}/lexicon").collect()}
    split = [(d, lm.words(t or ""), zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1) for d, t in rows]
    count = Counter(w for _, x, out in split if not out for w in x)
    assert {w: n for w, (n, _) in known.items()} == count
    assert all((c == lm.ONCE) == (n == 1) or w in dict(count.most_common(lm.UNITS)) for w, (n, c) in known.items())
    assert len({c for _, c in known.values()}) > 10
    of = lambda x: [0, *(known[w][1] if w in known else lm.ONCE for w in x), 0]
    g = np.zeros((lm.CLASSES, lm.CLASSES))
    for _, x, out in split:
        if not out:
            c = of(x)
            np.add.at(g, (c[:-1], c[1:]), 1)
    kinds = Counter(c for _, c in known.values()) + Counter([0])
    ends = sum(not out for *_, out in split)
    share = (g.sum(axis=0) + 0.5) / (g.sum() + 0.5 * lm.CLASSES)

    def score(x):
        c, total = of(x), 0.0
        for a, b, w in zip(c, c[1:], [*x, None]):
            n = ends if w is None else known.get(w, (0,))[0]
            total += math.log10((g[a, b] + lm.PRIOR * share[b]) / (g[a].sum() + lm.PRIOR))
            total += math.log10((n + 0.5) / (g[:, b].sum() + 0.5 * (kinds[b] + 1)))
        return total

    want = sorted((str(d), len(x) + 1, score(x)) for d, x, _ in split)
    have = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in got)
    for a, b in zip(want, have, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)


def test_words_go_to_the_class_of_their_like(spark, monkeypatch):
    """Words too rare to be units fall to the units that stand in the same places."""
    monkeypatch.setattr(lm, "UNITS", 8)
    monkeypatch.setattr(lm, "OTHER", 9)
    monkeypatch.setattr(lm, "TOTAL", 10)
    monkeypatch.setattr(lm, "WIDE", 20)
    monkeypatch.setattr(lm, "UNIT_NAMES", [u.to_bytes(2, "little") for u in range(10)])
    monkeypatch.setattr(lm, "CLASSES", 8)
    from treeline.llm.shared import work_dir

    rng = np.random.default_rng(4)
    nouns, verbs = [f"noun{i}" for i in range(4)], [f"verb{i}" for i in range(4)]
    say = lambda a, b: " ".join(str(w) for _ in range(40) for w in (rng.choice(a), rng.choice(b)))
    texts = [say(nouns, verbs) for _ in range(30)] + [f"noun0 rareverb noun1 verb1 rarenoun verb2 {say(nouns, verbs)}"] * 3
    root = work_dir(spark, "lm")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lm.lm_scores(df, train=lm.F.lit(True), root=root)
    c = {r["word"].decode(): r["class"] for r in spark.read.parquet(f"{root}/lexicon").collect()}
    of_nouns, of_verbs = {c[w] for w in nouns}, {c[w] for w in verbs}
    assert not of_nouns & of_verbs and c["rarenoun"] in of_nouns and c["rareverb"] in of_verbs
