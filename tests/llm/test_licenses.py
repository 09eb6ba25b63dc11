import re

import duckdb
import pytest
from treeline.llm import license_rules, licenses

PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
DOCS = [
    (1, "Released under the MIT License."), (2, "GNU Lesser General Public License, version 2.1 -- see GPL"), (3, None), (4, ""), (5, "mit\nlicense; MIT-License mit lİcense mit licenſe"),
    (6, "Licensed under the Apache License, Version 2.0 (the license)"), (None, "general public license general public license"), (1, "Released under the MIT License."), (7, "É permit licenses submit license"),
    (8, "the mit-style\x00license 2 0 Apache License apache"), (9, "This file is free and unencumbered software released into the public domain. All rights reserved"), (10, "nothing here"), (11, "licensed under CC BY-NC 4.0"),
]


def brute(docs):
    """The base by words, and rules with suppression by pairs of detections."""
    rules, out = license_rules.rules(), []
    for doc, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        base = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        line = " " + " ".join(f"{i}:{w} " for i, w in enumerate(words))
        found = []
        for rank, label, priority, keyword, rx, _ in rules:
            for m in re.finditer(rx, line):
                numbers = [int(x) for x in re.findall(r" ([0-9]+):", m.group())]
                assert keyword in m.group()
                found.append((numbers[0], numbers[-1], priority, rank, label))
        stay = [d for d in found if not any(o is not d and o[2] >= d[2] and o[0] <= d[0] and o[1] >= d[1] and ((o[0], o[1]) != (d[0], d[1]) or o[2] > d[2] or o[3] < d[3]) for o in found)]
        top = max((d[2] for d in stay), default=0)
        score = max(license_rules.CONFIDENCE.get(top, 0.0), license_rules.CONFIDENCE[2] if base else 0.0)
        at = [k for k, _ in base]
        labels = {x for _, x in base}
        out.append((doc, len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {d[4] for d in stay})), score, len(stay)))
    return sorted(out, key=repr)


def rows(df):
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_kept")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def test_query_is_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(licenses.op13_license_scan(spark, sf)) == brute(docs)


def test_hard_rows_and_sql(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "w", 2) for i, t in DOCS], "doc_id long, text string, words string, low int")
    assert rows(licenses.scan(df)) == brute(DOCS)
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = c.sql(licenses.SQL)
    assert sorted(got.fetchall(), key=repr) == brute(DOCS)


def test_suppression(spark):
    got = {r["doc_id"]: (r["labels"], r["n_kept"]) for r in licenses.scan(spark.createDataFrame(DOCS, "doc_id long, text string")).collect()}
    assert got[2] == ("gpl,lgpl-2.1", 2)  # the lesser licence's name holds the general one's; base labels stay, and so does the mention at the end
    assert got[1] == ("mit", 1)
    assert got[11] == ("cc-by-nc", 1)


def test_no_python_worker_and_no_shuffle(spark, sf):
    plan = licenses.op13_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_long_text_with_many_places(spark):
    n = 60_000
    text = "some words of the mit license and more of them " * n  # 2.8 MB
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["labels"], r["n_kept"]) == (n, 4, 10 * (n - 1) + 4, "mit", n)


def test_signatures():
    of = license_rules.rules()
    assert len(of) >= 300 and {p for _, _, p, *_ in of} == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        license_rules.rules("mit mit\n3 some ?mit licen[cs]e")


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
