import numpy as np
import pytest
from treeline.llm import near_dedup as near


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], max(row[j], row[j - 1], left + 1 if x == y else 0)
    return row[-1]


def grams(text):
    w = (text or "").split()
    w = [x.lower() for x in w]
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(rows):
    sh = {d: grams(t) for d, t in rows}
    ids, comp = sorted(sh), {d: d for d in sh}
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sh[a], sh[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(set(x) & set(y)) >= 0.5 * len(set(x)):
                n = lcs(x, y)
                if n >= 0.8 * (len(x) + len(y) - n) - 1e-9:
                    links.append((a, b))
    for _ in ids:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def planted(seed=2):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)]
    word = lambda n: list(rng.choice(vocabulary, n))
    rows, passage = [], word(60)
    for g in range(12):
        base = word(int(rng.integers(3, 150)))
        for _ in range(int(rng.integers(1, 9))):
            x = list(base)
            for _ in range(int(rng.integers(0, 4))):
                k = int(rng.integers(0, len(x)))
                x[k : k + 1] = word(int(rng.integers(0, 3)))
            rows.append(" ".join(x).upper() if rng.random() < 0.2 else "  ".join(x))
    rows += [" ".join(passage + word(70)) for _ in range(15)]  # share a passage, no more
    return [(i, t) for i, t in enumerate(rows)] + [(900, ""), (901, ""), (902, None), (903, "one two"), (904, "one two"), (905, "one three")]


@pytest.mark.parametrize("block", [512, 3])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = planted()
    got = near.near_copies(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rep string")).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_band_is_the_full_alignment():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = (rng.integers(0, 6, rng.integers(1, 40)).tolist() for _ in range(2))
        assert near.common(a, b, 50) == lcs(a, b)
        ops = len(a) + len(b) - 2 * lcs(a, b)
        assert near.common(a, b, ops) == lcs(a, b)


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string"
    got = near.near_copies(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "a b c")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in got) == [(0, 2, False), (2, 2, True), (3, 2, False), (3, 2, False)]
    assert near.near_copies(spark.createDataFrame([], schema)).collect() == []


def test_rows_that_repeat_an_id_keep_their_own_classes(spark):
    rng = np.random.default_rng(3)
    a, b = (" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80)) for _ in range(2))
    near_b = b.split()
    near_b[40] = "changed"
    rows = [(1, a), (1, b), (2, " ".join(near_b)), (None, a.upper()), (None, "on its own"), (7, " \t")]
    want = sorted([(1, 1, True), (1, 1, True), (2, 1, False), (0, 1, False), (0, 0, True), (7, 7, True)])
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = near.near_copies(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in got) == want


def test_long_alignments_go_by_matches():
    import time

    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(1, 40)).tolist() for _ in range(2))
        where = {x: [j for j, y in enumerate(b) if x == y] for x in b}
        band = int(rng.integers(1, 40))
        assert near.by_matches(a, where, band) == near.common(a, b, band)
    a = rng.integers(0, 1 << 62, 2_000_000)
    b = np.delete(a, rng.integers(0, len(a), 150_000))
    b[rng.integers(0, len(b), 20_000)] = 7
    began = time.time()
    la, lb = (np.sort(near.labelled(x.view(np.uint64))) for x in (a, b))
    assert near.similar(a.view(np.uint64), b.view(np.uint64), la, lb)
    assert time.time() - began < 60
