import numpy as np
import pytest
import sentencepiece
from treeline.llm import pieces

TEXTS = [
    "", " ", "   ", "a", " a  b\n c", "hello world, this is a test", "▁x <s> <0x0A>", "tab\tand\r\nlines\n\n\nend ", "日本語 한국어 \U0001f600\U0001f680",
    "x" * 3000, "ab " * 500, "!!!???***&&&%%% $$$", "a" + " " * 40 + "b" + " " * 17, "İß é́ ﬁﬂ", "\x00\x01", "des États-Unis d'Amérique",
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_ids_are_the_librarys(model):
    coder = pieces.Coder()
    for got, want in zip(coder.encode(TEXTS), model.encode(TEXTS)):
        assert got.tolist() == want
    # and again from the cache
    assert [x.tolist() for x in coder.encode(TEXTS)] == model.encode(TEXTS)


def test_random_strings(model):
    rng = np.random.default_rng(1)
    alphabet = list("abcdeilnorstu  \n.,-_'éß▁X9")
    texts = ["".join(rng.choice(alphabet, size=rng.integers(1, 60))) for _ in range(1500)]
    assert [x.tolist() for x in pieces.Coder().encode(texts)] == model.encode(texts)


def test_unigram_viterbi_is_the_best_sum():
    coder = pieces.Coder()
    coder.v.bpe = False

    def best(word):  # every segmentation
        top = [(0.0, [])] + [None] * len(word)
        for n in range(1, len(word) + 1):
            for m in range(n):
                s = coder.v.score.get(word[m:n], coder.v.lowest if n - m == 1 else None)
                if s is not None and (top[n] is None or top[m][0] + s > top[n][0]):
                    top[n] = (top[m][0] + s, top[m][1] + [word[m:n]])
        return top[-1][0]

    words = sorted({"▁hello", "▁help", "▁helping", "▁international", "▁inter", "zzz"})
    for word, ids in coder.t.walk(words):
        assert sum(coder.v.score[coder.v.text[i]] for i in ids) == pytest.approx(best(word))


def test_prefixes_are_worked_once():
    coder = pieces.Coder()
    list(coder.t.walk(["▁abc", "▁abcd", "▁abcde"]))
    assert coder.t.steps == 6


def test_round_trip_and_query(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    coded = pieces.encode(docs)
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert got == {k: model.encode(t) for k, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in pieces.decode(coded).collect()} == texts
    import hashlib

    for r in pieces.op2_sentencepiece(spark, sf).collect():
        assert r["n_pieces"] == len(got[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, ids string"
    rows = [(1, None, "x"), (None, "a b", "y"), (2, "", None), (2, "", None)]
    out = pieces.encode(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in out) == [(0, 2), (1, 0), (2, 0), (2, 0)]
    assert pieces.digests(spark.createDataFrame([], schema)).collect() == []
