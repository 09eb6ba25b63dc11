"""Best-fit packing of tokenised documents into sequences.

Documents become pieces of at most `size` tokens; only documents that are longer are cut, and then
into full pieces with the shorter one first. The histogram of piece lengths (at most `size` bins,
whatever the input) is all that the driver sees. Patterns of up to three lengths that fill a
sequence exactly are fitted to it by non-negative least squares, the repeat counts are rounded to
what the histogram holds, in one plan the residual is fitted again, and what then is left is packed
best-fit decreasing. Of several such plans, from patterns of few repeats on or of many, the one of the fewest
sequences stays; none has more than best fit decreasing alone. The plan is a
list of runs (length, first rank, count, first sequence, offset), again bounded by the bins and
patterns; each piece finds its run by its rank among the pieces of its length.

Defined results: null text counts as empty and is one piece that holds the end id alone; repeated
rows and repeated or null ids are packed as separate documents; an empty table gives no rows; a text
of any length is cut as above.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, slices, table, text_of, work_dir

SIZE = 1024
END = 2  # id that closes each document
SPECIAL = "<|endoftext|>"  # in a text, the JSON tokenizer alone treats it as one id
LONG_RUN = 100_000  # blanks in a row; from about a million on the rank twin's regex engine panics
BLANK_RUN = re.compile(r"(?<!\s)\s{%d}" % LONG_RUN)  # begins at runs only, so that the search is linear
LEAST = (0.5, 1, 4, 16, 64, math.inf)  # fewest repeats of the patterns that a plan takes
REFIT = 1  # the one of these whose residual is fitted again
ROUND = 0.5  # repeat counts are rounded to the nearest, as far as the histogram holds
PER_SALT = 50_000_000  # pieces for each part in which a length is ranked, and the most parts
MAX_SALTS = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(json_path: str | None = None, ranks_path: str | None = None):
    """text -> ids as tokenizers gives them for the JSON file; its twin of ranks is the fast way."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))

    def encode(text: str) -> list[int]:
        if SPECIAL in text or (len(text) >= LONG_RUN and BLANK_RUN.search(text)):
            return whole.encode(text, add_special_tokens=False).ids
        return quick.encode_ordinary(text)

    return encode


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, the shorter one first."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece with the crc32 of its ids."""

    def run(frames):
        encode = encoder()
        for pdf in frames:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = encode(text)
                ids.append(end)
                raw = memoryview(array("I", ids).tobytes())
                doc = None if pd.isna(doc) else int(doc)
                for k, (start, length) in enumerate(cuts(len(ids), size)):
                    out.append((doc, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, PIECES)


def patterns(size: int) -> np.ndarray:
    """Length triples a >= b >= c >= 0 with a + b + c = size and b > 0; 0 stands for none."""
    a, b = np.meshgrid(np.arange(1, size), np.arange(1, size), indexing="ij")
    c = size - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def fit(histogram: np.ndarray, pats: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeat counts x so that the patterns' lengths add up to the histogram."""
    target = histogram.astype(float)
    target[0] = 0
    x = np.zeros(len(pats))
    use = np.flatnonzero(np.all((target[pats] > 0) | (pats == 0), axis=1))
    if not len(use):
        return x
    p, y = pats[use], np.zeros(len(use))
    # accelerated projected gradient; the largest eigenvalue is bounded by the largest row sum
    columns = np.zeros(len(target))
    for j in range(3):
        np.add.at(columns, p[:, j], 1)
    columns[0] = 0
    step = 1 / (3 * columns.max())
    z, t = y.copy(), 1.0
    for _ in range(rounds):
        filled = sum(np.bincount(p[:, j], weights=z, minlength=len(target)) for j in range(3))
        rest = target - filled
        rest[0] = 0
        new = np.maximum(0, z + step * rest[p].sum(axis=1))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, y = new + (last - 1) / t * (new - y), new
    x[use] = y
    return x


def from_patterns(histogram: np.ndarray, pats: np.ndarray, x: np.ndarray, least: float) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Recipes (lengths of a sequence, how often) of the patterns with repeat counts of at least `least`,
    rounded to what the histogram holds, and the residual histogram."""
    left, recipes = histogram.copy(), []
    for i in np.argsort(-x, kind="stable"):
        if x[i] < least:
            break
        need = Counter(int(v) for v in pats[i] if v)
        times = min(int(x[i] + ROUND), *(int(left[v]) // k for v, k in need.items()))
        if times:
            recipes.append((tuple(int(v) for v in pats[i] if v), times))
            for v, k in need.items():
                left[v] -= k * times
    return recipes, left


def best_fit(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Recipes of best fit decreasing, over groups of equal sequences."""
    rooms: list[int] = []  # free tokens that some open group has, sorted
    open_groups: dict[int, list[tuple]] = defaultdict(list)  # free tokens -> (lengths, how often)

    def put(lengths: tuple[int, ...], times: int) -> None:
        free = size - sum(lengths)
        if not open_groups[free]:
            insort(rooms, free)
        open_groups[free].append((lengths, times))

    for length in range(size, 0, -1):
        n = int(histogram[length])
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                per = size // length
                if n >= per:
                    put((length,) * per, n // per)
                    n %= per
                else:
                    put((length,) * n, 1)
                    n = 0
                continue
            free = rooms[k]
            lengths, times = open_groups[free].pop()
            if not open_groups[free]:
                rooms.pop(k)
            used = min(n, times)
            if times > used:
                put(lengths, times - used)
            put((*lengths, length), used)
            n -= used
    return [(g, t) for free in sorted(open_groups) for g, t in open_groups[free]]


def plan(histogram: np.ndarray, size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) and the number of sequences.

    histogram[l]: pieces of l tokens. It is bounded by size, and so are all loops here by bins and
    patterns. Patterns are taken from several repeat counts on, the residual is packed best-fit, and
    the plan of the fewest sequences stays; from no pattern at all on, it is best fit alone.
    """
    left = histogram.astype(np.int64).copy()
    full = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    recipes: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        pats = patterns(size)
        x = fit(left, pats)
        tried = []
        for least in LEAST:
            taken, rest = from_patterns(left, pats, x, least)
            again, rest = from_patterns(rest, pats, fit(rest, pats), least) if least == REFIT and taken and rest.sum() else ([], rest)
            tried.append(taken + again + best_fit(rest, size))
        recipes = min(tried, key=lambda r: sum(t for _, t in r))
    runs, count, sequence = [], Counter(), 0
    for lengths, times in full + recipes:
        offset = 0
        for length in lengths:
            runs.append((length, count[length], times, sequence, offset))
            count[length] += times
            offset += length
        sequence += times
    return runs, sequence


def assign(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """sequence_id and offset for pieces with a length column; cut_pieces must be a stored table."""
    spark = cut_pieces.sparkSession
    # full pieces fill a sequence each: they need no rank and no shuffle
    rest = cut_pieces.filter(F.col("length") < size)
    # pieces of one length may be a third of all: each length is ranked in parts
    salts = min(MAX_SALTS, max(16, slices(cut_pieces.count(), PER_SALT)))
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    tally = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect()  # at most size * MAX_SALTS rows
    histogram = np.zeros(size + 1, dtype=np.int64)
    base: dict[tuple[int, int], int] = {}
    for length, salt, n in sorted((r["length"], r["salt"], r["n"]) for r in tally):
        base[length, salt] = int(histogram[length])
        histogram[length] += n
    runs, planned = plan(histogram, size)
    by_length = defaultdict(list)
    for length, *run in runs:
        by_length[length].append(run)
    known = spark.sparkContext.broadcast((base, {k: np.array(sorted(v), dtype=np.int64) for k, v in by_length.items()}))

    def place(frames):
        base, runs = known.value
        for pdf in frames:
            if pdf.empty:
                continue
            seq = np.empty(len(pdf), dtype=np.int64)
            off = np.empty(len(pdf), dtype=np.int64)
            for (length, salt), at in pdf.groupby(["length", "salt"]).indices.items():
                rank = pdf["rank"].to_numpy()[at] + base[length, salt]
                mine = runs[length]
                k = np.searchsorted(mine[:, 0], rank, side="right") - 1
                seq[at] = mine[k, 2] + rank - mine[k, 0]
                off[at] = mine[k, 3]
            out = pdf.drop(columns=["salt", "rank"])
            out["sequence_id"], out["offset"] = seq, off
            yield out.astype({"doc_id": "Int64"})

    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
    full = cut_pieces.filter(F.col("length") == size).withColumns(
        {"sequence_id": F.lit(planned) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    return ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long").unionByName(full)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, root: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    stored = cut(pieces(docs, id_col, text_col, size, end), f"{root or work_dir(docs.sparkSession, 'pack')}/pieces")
    return assign(stored, size)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
