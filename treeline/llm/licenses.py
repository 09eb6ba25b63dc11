"""Licence scans by ordered signature rules; DataFrame operations only.

A text becomes numbered words, ` 0:this  1:licence `, so that a match of a rule says which words it
covers. Rules run on the texts that hold one of a few root strings, and of them only those all of whose
plain words the text holds. Of the detections of a text, one that lies within another of the same or a
higher priority goes (of equal spans, the higher priority or the earlier rule stays). The labels of
those that stay, and those of the base phrases, are the answer; nothing is shuffled, and what a row
holds is bounded by its text.

Defined results: null texts count as empty; empty texts have no words, no labels and score 0;
repeated rows and repeated or null ids are answered row by row; columns other than the two named are
never read; an empty table gives no rows. `score` is how sure the surest detection is, at least
that of a name if a base phrase is found, and 0 without either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_rules
from .shared import table, text_of

#: Words of a text whose A-Z are lower-cased; here A-Z count as letters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the base: phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
FIRST, LAST = r"^ ([0-9]+):", r"([0-9]+):[^ ]+ $"
LEVELS = (1, 2, 3, 4)


def numbered(words: Column) -> Column:
    """The words with their numbers from 0, each between blanks of its own."""
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w, i: F.concat(i.cast("string"), F.lit(":"), w, F.lit(" "))), " "))


def edge(match: Column, expression: str) -> Column:
    return F.regexp_extract(match, expression, 1).cast("long")


def kept(found: Column) -> Column:
    """Detections (first, upto = -last, rank_down = -priority, rule, label) -> labels of those in no other of their priority or above, and the top priority."""

    def merge(acc: Column, d: Column) -> Column:
        last, priority = -d["upto"], -d["rank_down"]
        covered = F.element_at(acc["ends"], priority) >= last
        ends = F.array(*[F.when(priority >= k, F.greatest(acc["ends"][k - 1], last)).otherwise(acc["ends"][k - 1]) for k in LEVELS])
        labels = F.when(covered, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"])))
        return F.struct(ends.alias("ends"), labels.alias("labels"), F.when(covered, acc["top"]).otherwise(F.greatest(acc["top"], priority)).alias("top"), (acc["n"] + F.when(covered, 0).otherwise(1)).alias("n"))

    start = F.struct(F.array(*[F.lit(-1).cast("long") for _ in LEVELS]).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("top"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(found), start, merge)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", signatures: list[tuple] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_kept: one row for each row of docs."""
    of = signatures if signatures is not None else license_rules.rules()
    # explode() of one value keeps what many expressions use from being worked anew in each
    once = lambda c: F.explode(F.array(c))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", "text", once(F.lower("text")).alias("lowered"))  # of A-Z it makes what the words are matched in, of others at most more
    gate = F.lit(False)
    for root in sorted({"license", *license_rules.roots(of)}):
        gate = gate | F.contains("lowered", F.lit(root))
    rows = rows.select("doc_id", "text", once(F.when(gate, F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)))).alias("list"))
    n_words = F.when(F.col("list").isNull(), F.regexp_count("text", F.lit(WORD))).otherwise(F.size("list")).cast("long")

    plain = sorted({w for r in of for w in r[5]} - {license_rules.STEM} | {"license"})
    stem = F.when(F.exists("list", lambda w: F.startswith(w, F.lit(license_rules.STEM))), F.array(F.lit(license_rules.STEM))).otherwise(F.array().cast("array<string>"))
    present = F.concat(F.array_intersect(F.array(*[F.lit(w) for w in plain]), "list"), stem)
    rows = rows.select("doc_id", "list", n_words.alias("n_words"), once(present).alias("present"))
    literal = F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("label"), F.lit(r[2]).alias("priority"), F.lit(r[4]).alias("rx"), F.array(*[F.lit(w) for w in r[5]]).alias("needs")) for r in of])
    active = F.filter(literal, lambda r: F.forall(r["needs"], lambda w: F.array_contains(F.col("present"), w)))
    rows = rows.select("doc_id", "n_words", "list", "present", once(active).alias("active"))
    words = F.when((F.size("active") > 0) | F.array_contains("present", "license"), numbered(F.col("list")))
    rows = rows.select("doc_id", "n_words", "active", once(words).alias("words"))

    base = [F.coalesce(F.regexp_extract_all("words", F.lit(license_rules.compiled(p)), 0), F.array().cast("array<string>")) for p in BASE]
    places = F.array(*[F.struct(m.alias("found"), F.lit(label).alias("label")) for m, label in zip(base, BASE.values())])

    def of_rule(r: Column) -> Column:
        def detection(m: Column) -> Column:
            return F.struct(edge(m, FIRST).alias("first"), (-edge(m, LAST)).alias("upto"), (-r["priority"]).alias("rank_down"), r["rule"].alias("rule"), r["label"].alias("label"))

        return F.transform(F.regexp_extract_all(F.col("words"), r["rx"], F.lit(0)), detection)

    found = F.when(F.size("active") > 0, F.flatten(F.transform("active", of_rule)))
    rows = rows.select("doc_id", "n_words", once(F.filter(places, lambda p: F.size(p["found"]) > 0)).alias("places"), "words", "active").select("doc_id", "n_words", "places", once(kept(found)).alias("kept"))

    firsts = F.transform("places", lambda p: edge(p["found"][0], FIRST))
    lasts = F.transform("places", lambda p: edge(F.element_at(p["found"], -1), FIRST))
    of_base = F.coalesce(F.transform("places", lambda p: p["label"]), F.array().cast("array<string>"))
    own = F.coalesce(F.col("kept.labels"), F.array().cast("array<string>"))
    sure = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in license_rules.CONFIDENCE.items() for x in (k, v)]), F.col("kept.top")), F.lit(0.0))
    none = F.lit(0).cast("long")
    return rows.select(
        "doc_id", "n_words", F.coalesce(F.aggregate("places", none, lambda a, p: a + F.size(p["found"])), none).alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(lasts).alias("last_word"),
        F.array_join(F.array_sort(of_base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(of_base, own)), ",").alias("labels"),
        F.greatest(sure, F.when(F.size(of_base) > 0, license_rules.CONFIDENCE[2]).otherwise(0.0)).alias("score"), F.coalesce(F.col("kept.n").cast("long"), none).alias("n_kept"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    of = license_rules.rules()
    values = ", ".join(f"({n}, '{label}', {p}, '{k}', '{rx}')" for n, label, p, k, rx, _ in of)
    base = ", ".join(f"('{label}', '{license_rules.compiled(p)}')" for p, label in BASE.items())
    sure = " ".join(f"WHEN {k} THEN {v}" for k, v in license_rules.CONFIDENCE.items())
    ends = " ".join(f"WHEN {k} THEN max(CASE WHEN priority >= {k} THEN last END) OVER w" for k in LEVELS)
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
  n AS (SELECT row, doc_id, low, regexp_extract_all(low, '{WORD}') AS words FROM d),
  t AS (SELECT row, doc_id, low, len(words) AS n_words, CASE WHEN contains(low, 'licen') OR {" OR ".join(f"contains(low, '{k}')" for k in license_rules.roots(of))}
    THEN ' ' || array_to_string(list_transform(range(len(words)), lambda i: i || ':' || words[i + 1] || ' '), ' ') END AS line FROM n),
  b(label, rx) AS (VALUES {base}),
  p AS (SELECT row, label, unnest(regexp_extract_all(line, rx)) AS m FROM t, b WHERE line IS NOT NULL),
  q AS (SELECT row, count(*) AS n_base, min(regexp_extract(m, '{FIRST}', 1)::BIGINT) AS first_word, max(regexp_extract(m, '{FIRST}', 1)::BIGINT) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY row),
  r(rule, label, priority, keyword, rx) AS (VALUES {values}),
  f AS (SELECT row, rule, label, priority, unnest(regexp_extract_all(line, rx)) AS m FROM t, r WHERE line IS NOT NULL AND contains(low, keyword)),
  s AS (SELECT row, rule, label, priority, regexp_extract(m, '{FIRST}', 1)::BIGINT AS first, regexp_extract(m, '{LAST}', 1)::BIGINT AS last FROM f),
  c AS (SELECT *, coalesce(CASE priority {ends} END >= last, false) AS covered FROM s
    WINDOW w AS (PARTITION BY row ORDER BY first, last DESC, priority DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  k AS (SELECT row, count(*) AS n_kept, max(priority) AS top FROM c WHERE NOT covered GROUP BY row),
  l AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM c WHERE NOT covered UNION ALL SELECT row, label FROM p) GROUP BY row)
  SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    greatest(CASE WHEN n_base > 0 THEN {license_rules.CONFIDENCE[2]} ELSE 0 END, CASE top {sure} ELSE 0 END)::DOUBLE AS score, coalesce(n_kept, 0) AS n_kept
  FROM t LEFT JOIN q USING (row) LEFT JOIN k USING (row) LEFT JOIN l USING (row)"""


SQL = _sql()
