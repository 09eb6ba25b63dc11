"""Language-model scores from a Brown class-based bigram model.

P(text) = product of P(class | class before) * P(word | class). All that is counted covers every
training text, and every word that they hold more than once is assigned to its class by exchange:

* counts: the `UNITS` most frequent words, the end token and one stand-in for all other words are
  units. One pass gathers the bigrams of units, and of each other word what units stand before and
  after it; a word costs a row for each task, however frequent it is.
* exchange over units: in each round tasks sum each unit's bigrams by the class of the other unit,
  and a half of the units in turn moves to the class that adds most to the log-likelihood, until
  that no longer rises (ROUNDS half rounds at most); the best round is kept.
* exchange over all other words: tasks move each word to the class that adds most, given the classes
  of the units around it (its gain to first order, as no such word weighs much against the table).
  Words found once stay in a class of their own, which unknown words join. This lexicon grows with
  the vocabulary; its `HOT` most frequent words are broadcast, the others are joined.
* transitions: class bigrams of the whole training texts, by the classes of all their words.

Transitions are smoothed towards the class's share, emissions by one half for each known word of the
class and for one unknown word.

Defined results: null text is empty: one end token; a null id belongs to the fold of the empty
string; rows that repeat an id are learnt from and scored one by one; without training texts N = 0
and V = 0, base_score is log10 of 1 for each token and score follows the smoothed empty model; an
empty table gives no rows; columns other than the two named are not read. A text of any length is
scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batches, cut, fold_of, table, text_of, work_dir

HELD_OUT = 1  # fold that is not learnt from
HOT = 200_000  # broadcast words; all others are joined
UNITS = 3072  # words whose classes tell where all other words belong
CLASSES = 64
ROUNDS = 10  # half rounds of the units' exchange, at most
RISE = 1e-4  # of the log-likelihood, below which a half round counts as none
PRIOR = 4.0  # weight of a class's share in transitions
BATCH = 8 << 20
FLUSH = 400_000  # distinct words that a task holds before it passes their counts on
GATHER = 4_000_000  # tokens likewise

END, OTHER, TOTAL = 0, UNITS + 1, UNITS + 2  # units: the end token, 1 to UNITS, all other words
ONCE = 1  # class of words found once or never; class 0 is the end's alone
PENDING = 255  # in a sequence of classes: a word that is joined


def words(text: str) -> list[bytes]:
    """Tokens of a text without its end: A-Z lower-cased, cut at ASCII blanks."""
    return text.encode("utf-8", "replace").lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n) over texts, without end tokens."""

    def run(frames):
        seen = Counter()
        for pdf in frames:
            for text in pdf["text"]:
                seen.update(words(text))
            if len(seen) > FLUSH:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen = Counter()
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return texts.mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


# What stands beside a word: codes (unsigned 16 bits) and how often (signed 64). A unit (its number as
# the word) has the units after it; another word has unit * 2 of each unit before, unit * 2 + 1 after.
BESIDE = "is_unit boolean, word binary, codes binary, counts binary"
WIDE = 2 * TOTAL


def packed(is_unit: bool, names: list[bytes], owner: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """BESIDE rows of sorted (owner, code); names by owner."""
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    edges = np.append(start, len(owner)).tolist()
    codes, counts = codes.astype("<u2").tobytes(), counts.astype("<i8").tobytes()
    spans = list(zip(edges, edges[1:]))
    return pd.DataFrame(
        {"is_unit": is_unit, "word": [names[i] for i in owner[start].tolist()], "codes": [codes[2 * a : 2 * b] for a, b in spans], "counts": [counts[8 * a : 8 * b] for a, b in spans]}
    )


def unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of BESIDE rows."""
    sizes = pdf["codes"].map(len).to_numpy() // 2
    return np.repeat(np.arange(len(pdf)), sizes), np.frombuffer(b"".join(pdf["codes"]), dtype="<u2").astype(np.int64), np.frombuffer(b"".join(pdf["counts"]), dtype="<i8")


UNIT_NAMES = [u.to_bytes(2, "little") for u in range(TOTAL)]


def gather(texts: DataFrame, units) -> DataFrame:
    """BESIDE of texts, a row for each word and task flush. Texts begin and end at END."""

    def run(frames):
        get = units.value.get
        names: dict[bytes, int] = {}
        pairs: list[np.ndarray] = []
        beside: list[np.ndarray] = []
        size = 0

        def flush():
            code, n = np.unique(np.concatenate(pairs), return_counts=True)
            yield packed(True, UNIT_NAMES, code // TOTAL, code % TOTAL, n)
            if beside:
                code, n = np.unique(np.concatenate(beside), return_counts=True)
                yield packed(False, list(names), code // WIDE, code % WIDE, n)

        for pdf in frames:
            for text in pdf["text"]:
                tokens = words(text)
                u = np.zeros(len(tokens) + 2, dtype=np.int64)
                u[1:-1] = np.fromiter(map(get, tokens, repeat(OTHER)), dtype=np.int64, count=len(tokens))
                pairs.append(u[:-1] * TOTAL + u[1:])
                at = np.flatnonzero(u == OTHER)
                if len(at):
                    who = np.array([names.setdefault(tokens[i], len(names)) for i in (at - 1).tolist()], dtype=np.int64) * WIDE
                    beside += [who + 2 * u[at - 1], who + 2 * u[at + 1] + 1]
                size += len(u)
                if size > GATHER:
                    yield from flush()
                    names, pairs, beside, size = {}, [], [], 0
        if pairs:
            yield from flush()

    return texts.mapInPandas(run, BESIDE)


def merged(rows: DataFrame) -> DataFrame:
    """BESIDE rows with one row for each word: a task streams through its words in order."""

    def run(frames):
        last = None
        for pdf in frames:
            if last is not None:
                pdf = pd.concat([last, pdf], ignore_index=True)
            name, unit = pdf["word"].to_numpy(), pdf["is_unit"].to_numpy()
            fresh = np.concatenate([[True], (name[1:] != name[:-1]) | (unit[1:] != unit[:-1])])
            row, code, n = unpacked(pdf)
            key, at = np.unique((np.cumsum(fresh) - 1)[row] * WIDE + code, return_inverse=True)
            sums = np.zeros(len(key), dtype=np.int64)
            np.add.at(sums, at, n)
            first = np.flatnonzero(fresh)
            out = packed(False, name[first].tolist(), key // WIDE, key % WIDE, sums)
            out["is_unit"] = unit[first]
            yield out.iloc[:-1]
            last = out.iloc[-1:]
        if last is not None:
            yield last

    return rows.repartition("is_unit", "word").sortWithinPartitions("is_unit", "word").mapInPandas(run, BESIDE)


def unit_bigrams(beside: DataFrame) -> DataFrame:
    """(a, b, n): how often unit b follows unit a; at most TOTAL^2 rows."""

    def run(frames):
        for pdf in frames:
            row, code, n = unpacked(pdf)
            a = np.array([int.from_bytes(w, "little") for w in pdf["word"]], dtype=np.int32)
            yield pd.DataFrame({"a": a[row], "b": code.astype(np.int32), "n": n})

    return beside.filter("is_unit").mapInPandas(run, "a int, b int, n long")


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(g: np.ndarray) -> float:
    """What of the corpus's log-likelihood depends on the classes."""
    return float(xlogx(g).sum() - xlogx(g.sum(axis=1)).sum() - xlogx(g.sum(axis=0)).sum())


def best_class(g: np.ndarray, mine: int, after: np.ndarray, before: np.ndarray) -> int:
    """Where a unit with these counts of classes after and before it adds most. Classes 0 and ONCE take no units."""
    g = g.copy()
    g[mine] -= after
    g[:, mine] -= before
    np.maximum(g, 0, out=g)
    rows, cols = g.sum(axis=1), g.sum(axis=0)
    gain = (xlogx(g + after[None, :]) - xlogx(g)).sum(axis=1) + (xlogx(g.T + before[None, :]) - xlogx(g.T)).sum(axis=1)
    gain -= xlogx(rows + after.sum()) - xlogx(rows) + xlogx(cols + before.sum()) - xlogx(cols)
    gain[: ONCE + 1] = -np.inf
    return int(gain.argmax())


def exchange(bigrams: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """unit -> class, and the class-bigram counts of that. counts: of each unit.

    bigrams is a stored table bounded by TOTAL^2 rows; a task holds some of it, the driver the
    classes of TOTAL units, their sums by class and a table of classes^2.
    """
    spark = bigrams.sparkSession
    to = np.zeros(TOTAL, dtype=np.int32)
    to[OTHER] = ONCE
    order = [u for u in np.argsort(-counts, kind="stable") if u not in (END, OTHER)]
    to[order] = ONCE + 1 + np.arange(len(order)) % (classes - ONCE - 1)
    best, top, table_ = to, -math.inf, np.zeros((classes, classes))
    still = 0
    for step in range(rounds + 1):
        shared = spark.sparkContext.broadcast(to)

        def by_class(frames, shared=shared):
            # a unit's bigrams by the class of the other unit, from both sides
            c = shared.value.astype(np.int64)
            for pdf in frames:
                a, b, n = pdf["a"].to_numpy(dtype=np.int64), pdf["b"].to_numpy(dtype=np.int64), pdf["n"].to_numpy()
                key = np.concatenate([(a * classes + c[b]) * 2 + 1, (b * classes + c[a]) * 2])
                code, at = np.unique(key, return_inverse=True)
                yield pd.DataFrame({"code": code, "n": np.bincount(at, weights=np.concatenate([n, n])).astype(np.int64)})

        summed = bigrams.mapInPandas(by_class, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        rows = summed.toPandas()  # at most TOTAL * classes * 2 rows
        if not len(rows):
            break
        vectors = np.zeros((TOTAL, classes, 2))
        code = rows["code"].to_numpy()
        vectors[code // (2 * classes), code // 2 % classes, code % 2] = rows["n"].to_numpy()
        g = np.zeros((classes, classes))
        np.add.at(g, to, vectors[:, :, 1])
        value = likelihood(g)
        still = 0 if value > top + RISE * abs(value) else still + 1
        if value > top:
            best, top, table_ = to, value, g
        if step == rounds or still == 2:  # neither half rises any more
            break
        turn = [u for u in range(1, TOTAL) if (u + step) % 2 == 0 and u != OTHER and vectors[u].any()]
        moved = to.copy()
        g = g.copy()
        for u in turn:
            after, before, old = vectors[u, :, 1], vectors[u, :, 0], int(to[u])
            moved[u] = new = best_class(g, old, after, before)
            if new != old:
                g[old], g[new] = g[old] - after, g[new] + after
                g[:, old], g[:, new] = g[:, old] - before, g[:, new] + before
                np.maximum(g, 0, out=g)
        to = moved
    return best, table_


def lexicon(beside: DataFrame, to: np.ndarray, g: np.ndarray) -> DataFrame:
    """(word, n, class) of all words but units: each moves to the class that adds most beside its units."""
    classes = len(g)
    shared = beside.sparkSession.sparkContext.broadcast((to.astype(np.int64), np.log((g + 0.1) / (g.sum(axis=1, keepdims=True) + 0.1 * classes)), np.log((g.T + 0.1) / (g.T.sum(axis=1, keepdims=True) + 0.1 * classes))))

    def run(frames):
        c, after, before = shared.value  # log-shares of the class after and before, of each class
        for pdf in frames:
            row, code, n = unpacked(pdf)
            sums = np.bincount((row * classes + c[code >> 1]) * 2 + (code & 1), weights=n, minlength=2 * classes * len(pdf)).reshape(len(pdf), classes, 2)
            gain = sums[:, :, 1] @ after.T + sums[:, :, 0] @ before.T
            gain[:, : ONCE + 1] = -np.inf
            times = np.rint(sums[:, :, 0].sum(axis=1)).astype(np.int64)  # one unit stands before each
            yield pd.DataFrame({"word": pdf["word"], "n": times, "class": np.where(times == 1, ONCE, gain.argmax(axis=1)).astype(np.int32)})

    return beside.filter("not is_unit").mapInPandas(run, "word binary, n long, class int")


def class_bigrams(sequences: DataFrame) -> np.ndarray:
    """CLASSES x CLASSES counts over sequences (classes binary)."""

    def run(frames):
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for pdf in frames:
            for raw in pdf["classes"]:
                c = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
                total += np.bincount(c[:-1] * CLASSES + c[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    g = np.zeros(CLASSES * CLASSES)
    for r in sequences.mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most CLASSES^2 rows
        g[r["code"]] = r["n"]
    return g.reshape(CLASSES, CLASSES)


@F.pandas_udf(T.BinaryType())
def filled(classes: pd.Series, at: pd.Series, found: pd.Series) -> pd.Series:
    """Sequences with the classes of joined words; found: word's place in its text * CLASSES + class."""
    out = []
    for raw, places, codes in zip(classes, at, found):
        if codes is not None and len(codes):
            c, codes = np.frombuffer(raw, dtype=np.uint8).copy(), np.asarray(codes, dtype=np.int64)
            of = np.empty(len(codes), dtype=np.uint8)
            of[codes // CLASSES] = codes % CLASSES
            c[c == PENDING] = of[np.frombuffer(places, dtype="<i4")]
            raw = c.tobytes()
        out.append(raw)
    return pd.Series(out, dtype=object)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: F.Column | None = None, root: str | None = None) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Stored below root, too: lexicon (word, n, class), and sequences, the classes of each text.
    """
    spark = docs.sparkSession
    root = root or work_dir(spark, "lm")
    train = fold_of(F.col(id_col)) != HELD_OUT if train is None else train
    # ids pass Python as strings, which hold nulls and large numbers alike
    whole = docs.select(F.col(id_col).cast("string").alias("id"), (~train).alias("held_out"), text_of(text_col).alias("text"))
    learn = whole.filter(~F.col("held_out")).select("text")

    top = [bytes(r["word"]) for r in count_words(learn).orderBy(F.desc("n"), "word").limit(UNITS).collect()]
    units = {w: 1 + i for i, w in enumerate(top)}
    beside = cut(merged(gather(learn, spark.sparkContext.broadcast(units))), f"{root}/beside")
    bigrams = cut(unit_bigrams(beside), f"{root}/bigrams")
    size = np.zeros(TOTAL)
    for r in bigrams.groupBy("a").agg(F.sum("n").alias("n")).collect():  # at most TOTAL rows
        size[r["a"]] = r["n"]
    to, g = exchange(bigrams, size, ROUNDS, CLASSES)
    frequent = spark.createDataFrame([(w, int(size[u]), int(to[u])) for w, u in units.items()], "word binary, n long, class int")
    known = cut(lexicon(beside, to, g).unionByName(frequent), f"{root}/lexicon")
    kinds = np.zeros(CLASSES)
    kinds[0] = size[END] > 0
    for r in known.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect():
        kinds[r["class"]] = r["n"]
    n, v = int(size.sum()), int(kinds.sum())  # OTHER's bigrams hold all other words
    hot = known.orderBy(F.desc("n"), "word").limit(HOT).toArrow()  # stays packed on the driver
    model = spark.sparkContext.broadcast((hot, int(size[END])))

    def run(frames):
        hot, ends = model.value
        get = {w: i for i, w in enumerate(hot["word"].to_pylist())}.get
        log_of = np.append(np.log10(hot["n"].to_numpy() + 0.5), 0.0)  # the last one stands for joined words
        class_of = np.append(hot["class"].to_numpy().astype(np.uint8), np.uint8(PENDING))
        end_log = math.log10(ends + 0.5)
        del hot
        for pdf in frames:
            for part in batches([pdf], BATCH, "text"):
                rows = []
                for text in part["text"]:
                    tokens = words(text)
                    i = np.fromiter(map(get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
                    c = np.zeros(len(tokens) + 2, dtype=np.uint8)
                    c[1:-1] = class_of[i]
                    late: dict[bytes, int] = {}
                    at = np.array([late.setdefault(tokens[k], len(late)) for k in np.flatnonzero(i < 0).tolist()], dtype="<i4")
                    times = np.bincount(at, minlength=len(late))
                    rows.append((len(tokens) + 1, len(tokens) - len(at) + (ends > 0), math.fsum(log_of[i]) + end_log, c.tobytes(), at.tobytes(), list(late), times))
                out = pd.DataFrame(rows, columns=["n_tokens", "hot_known", "hot_log", "classes", "at", "rare", "times"])
                yield pd.concat([part[["id", "held_out"]], out], axis=1)

    scored = whole.mapInPandas(run, "id string, held_out boolean, n_tokens long, hot_known long, hot_log double, classes binary, at binary, rare array<binary>, times array<long>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), f"{root}/scored")
    rest = scored.select("row", F.posexplode(F.arrays_zip("rare", "times")).alias("k", "x")).select("row", "k", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    tail = rest.join(known, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("tail_log"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.collect_list(F.col("k").cast("long") * CLASSES + F.coalesce("class", F.lit(ONCE))).alias("found"),  # distinct words of one text
    )
    all_ = scored.drop("rare", "times").join(tail, "row", "left")
    sequences = all_.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("hot_log") + F.coalesce("tail_log", F.lit(0.0))).alias("log"),
        filled("classes", "at", "found").alias("classes"),
    )
    sequences = cut(sequences, f"{root}/sequences")

    g = class_bigrams(sequences.filter(~F.col("held_out")).select("classes"))
    share = (g.sum(axis=0) + 0.5) / (g.sum() + 0.5 * CLASSES)
    step = np.log10((g + PRIOR * share[None, :]) / (g.sum(axis=1, keepdims=True) + PRIOR))
    below = np.log10(g.sum(axis=0) + 0.5 * (kinds + 1))  # of each class's emissions
    weights = spark.sparkContext.broadcast((step - below[None, :]).ravel())

    @F.pandas_udf("double")
    def moves(classes: pd.Series) -> pd.Series:
        found = []
        for raw in classes:
            c = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
            found.append(float(weights.value[c[:-1] * CLASSES + c[1:]].sum()))
        return pd.Series(found, dtype=float)

    base_below = math.log10(n + 0.5 * (v + 1))
    return sequences.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log") - F.col("n_tokens") * F.lit(base_below)).alias("base_score"),
        (F.col("log") + moves("classes")).alias("score"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
