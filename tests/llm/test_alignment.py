import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from treeline.llm import alignment

TEXTS = [
    "a", " ", "\n", "\nX\nY", " \nX", "hello world, this is a test", "a  b\n c \n\n d ", "▁x", "x ▁ y", "<|endoftext|> <s> <unk> <0x0A>", "日本語 한국어 \U0001f680\n\n!", "x" * 12000, " " * 12000 + "b",
    "tab\tand\r\nlines\n\n\nend ", "\x00\x1c\x85\xa0 z", "İß é́ ﬁﬂ don't we'll",
]


@pytest.fixture(scope="module")
def plain():
    """Ids and byte lengths by the libraries themselves, or None."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    raw = alignment.Aligner()

    def ids(text):
        if not text:
            return None
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [raw.a_raw[i] for i in x], [raw.b_raw[i] for i in y]
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            return None
        return x, y, *([len(t) for t in p] for p in parts)

    return ids


def brute(plain, docs):
    """The contract, pair by pair: (doc_id, text) -> a set of rows."""
    facts, held = [], Counter()
    for doc, text in docs:
        got = plain(text)
        if got is None:
            facts.append((doc, None))
            continue
        a, b, la, lb = got
        ea, eb = np.cumsum(la), np.cumsum(lb)
        links, groups, first = Counter(), [], (0, 0)
        j0 = 0
        for i in range(len(a)):
            while eb[j0] <= ea[i] - la[i]:
                j0 += 1
            j = j0
            while j < len(b) and eb[j] - lb[j] < ea[i]:
                links[a[i], b[j]] += 1
                j += 1
        for place in sorted(set(ea.tolist()) & set(eb.tolist())):
            upto = int(np.searchsorted(ea, place)) + 1, int(np.searchsorted(eb, place)) + 1
            groups.append(",".join(map(str, a[first[0] : upto[0]])) + "|" + ",".join(map(str, b[first[1] : upto[1]])))
            first = upto
        held.update(links.keys())
        facts.append((doc, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for doc, fact in facts:
        if fact is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, sha = fact
            best = sum(k for p, k in links.items() if held[p] == most[p[0]])
            out.append((doc, n_a, n_b, n_groups, sum(links.values()), best, sum(k * held[p] for p, k in links.items()), sha))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=repr)


def test_query_is_brute_force(spark, sf, plain):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(alignment.op11_alignment(spark, sf)) == brute(plain, docs)


def test_hard_texts_nulls_repeats_names_and_few_hot_pairs(spark, plain):
    docs = [(k % 7 or None, t) for k, t in enumerate(TEXTS * 2)] + [(1, None), (None, None), (2, "")]
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], "doc_id long, text string, sha string, n_a int, pair int")
    want = brute(plain, docs)
    assert rows(alignment.measures(df)) == want
    for hot in (0, 8, 64):  # the counts of the others come by a shuffle
        assert rows(alignment.measures(df, hot=hot)) == want


def test_random_strings(plain):
    rng = np.random.default_rng(3)
    alphabet = list("abcdeilnorstu  \n\n.,-_'éß▁X9\t")
    texts = ["".join(rng.choice(alphabet, size=rng.integers(1, 50))) for _ in range(1500)]
    got = alignment.Aligner().work(texts)
    for text, row in zip(texts, got):
        want = plain(text)
        assert row[:2] == ((len(want[0]), len(want[1])) if want else (0, 0)), repr(text)


def test_a_long_text_and_a_small_cache(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 100)
    aligner = alignment.Aligner()
    text = "some words, and more\n" * 100_000  # 2 MB
    one = aligner.work([text])[0]
    assert one[3] == sum(one[6]) and one[0] > 400_000
    assert [x[:5] for x in aligner.work([text, "b c"])][0] == one[:5]


def test_empty_table(spark):
    assert alignment.measures(spark.createDataFrame([], "doc_id long, text string")).collect() == []
