"""Repeated byte strings: anchored window hashing with splitting of runs, in place of prefix doubling.

A byte goes if a string of `length` bytes that covers it starts anywhere else, too. This is not the
prefix doubling of suffix arrays: no rank is made of two ranks. `ranks` below is, in its plain form;
it sorts every byte position in every round, which the README's figures rule out for whole corpora.
Here strings of `GRAM` bytes are counted first, then longer and longer ones around the same positions;
a position leaves as soon as its string is unique (nothing longer can repeat) or as all strings of the
full length around it repeat, so each round counts a small part of the one before.

Which positions: sorting every byte position is a row for each byte of the corpus and round. Every
window of `length` bytes instead names one anchor, the leftmost smallest hash among its GRAM-byte
strings. Equal windows name equal anchors at equal offsets, so comparing windows anchor by anchor
loses nothing, and about one position in 77 is an anchor. An anchor stands for the windows that
name it, which start lo to hi bytes before it; in each round a run of starts is

* repeated, if the string that holds all its windows is found again at another anchor,
* unique, if the string that all its windows share is not,
* split into shorter runs otherwise: SPANS starts in the rounds, 153 to 1. What they share grows from
  GRAM bytes to the full length.

Equality is all that is needed: a string is known by its hash, and its multiplicity is a map-side
sum, so a passage in every document costs a row for each task. A fixed-size bit filter lets scans pass only anchors whose
GRAM-byte string is found twice. What decides a removal is a 128-bit hash; shorter hashes only prune.

Defined results: null text is empty; texts under `length` bytes lose nothing; rows that repeat an id
or the whole row are separate documents, and so repeat each other; a null id is an id; an empty table
gives no rows. A text of any length is worked in slabs. Other columns come along untouched, whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batches, cut, free, table, text_of, work_dir

LENGTH = 200
GRAM = 48
STARTS = LENGTH - GRAM + 1  # windows that can name an anchor
SPANS = (STARTS, 20, 5, 1)  # starts of a run in each round; each but the first divides the one before
SLAB = 1 << 20  # bytes worked at once
EMIT = 50_000  # anchors that a task holds as rows
MAX_FILTER_BITS = 1 << 28  # 32 MB, whatever the input
BATCH = 4 << 20

MULTIPLIER = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2^64
CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


class Powers:
    """Powers of the multiplier and of its inverse, as far as needed."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            n = max(n, 1 << 16)
            a, b = np.full(n + 1, MULTIPLIER, dtype=np.uint64), np.full(n + 1, pow(MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
            a[0] = b[0] = 1
            cls.up, cls.down = np.multiply.accumulate(a), np.multiply.accumulate(b)
        return cls.up, cls.down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    n = len(data)
    up, down = Powers.get(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(CODES[data] * up[:n], out=sums[1:])
    return mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])


def leftmost_smallest(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of each run of `width` values, by doubling.

    Values are compared by their upper bits; the lower ones hold the position (under 2^23).
    """
    low = np.uint64((1 << 23) - 1)
    x, span = (g & ~low) | np.arange(len(g), dtype=np.uint64), 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if width > span:
        x = np.minimum(x[: span - width], x[width - span :])
    return (x & low).astype(np.int64)


def anchor_slabs(data: np.ndarray):
    """Positions that some window names, the hashes of their strings, and the fewest and most bytes
    before each position at which a window that names it starts; a slab of the text at a time."""
    n, held = len(data), None
    for s in range(0, n - LENGTH + 1, SLAB):
        g = gram_hashes(data[s : s + SLAB + LENGTH - 1])
        named = leftmost_smallest(g, STARTS)
        # later windows never name earlier positions
        start = np.flatnonzero(np.diff(named, prepend=-1))
        end = np.append(start[1:], len(named)) - 1
        at = named[start]
        slab = [at + s, g[at], at - end, at - start]
        if held is not None:
            if held[0][0] == slab[0][0]:  # a position named on both sides of a slab's edge
                held[2][0] = slab[2][0]
                slab = [x[1:] for x in slab]
            slab = [np.concatenate(x) for x in zip(held, slab)]
        held = [x[-1:].copy() for x in slab]
        yield tuple(x[:-1] for x in slab)
    if held is not None:
        yield tuple(held)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of all slabs together."""
    found = list(anchor_slabs(data))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    at, g, lo, hi = (np.concatenate(x) for x in zip(*found))
    return at, g, lo, hi


def bit_filter(hashes: DataFrame, expected: int, path: str):
    """A numpy bit array of the hashes (column g); its size is bounded by MAX_FILTER_BITS.

    Its parts are stored at `path` and read in few splits, one at a time: a job for each of them.
    """
    bits = 32768
    while bits < min(16 * expected, MAX_FILTER_BITS):
        bits *= 2
    slot = (F.col("g").bitwiseAND(F.lit(bits - 1)) + 1).alias("slot")
    rows = hashes.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("part"))
    whole = np.zeros(bits // 8, dtype=np.uint8)
    for r in cut(rows, path).toLocalIterator():
        part = np.frombuffer(bytes(r["part"]), dtype=np.uint8)
        whole[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = part
    return hashes.sparkSession.sparkContext.broadcast(whole)


def passes(g: np.ndarray, whole: np.ndarray) -> np.ndarray:
    slot = g & np.uint64(8 * len(whole) - 1)
    return (whole[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def counted(hashes: list[np.ndarray]) -> pd.DataFrame:
    code, n = np.unique(np.concatenate(hashes), return_counts=True)
    return pd.DataFrame({"g": code.view(np.int64), "n": n})


def count_grams(texts: DataFrame) -> DataFrame:
    def run(frames):
        for pdf in frames:
            for part in batches([pdf], BATCH, "_text"):
                few, size = [], 0
                for text in part["_text"]:  # whole texts, one by one, each by slabs
                    for slab in anchor_slabs(np.frombuffer(text.encode(), dtype=np.uint8)):
                        few.append(slab[1])
                        size += len(slab[1])
                        if size > EMIT:
                            yield counted(few)
                            few, size = [], 0
                if size:
                    yield counted(few)

    return texts.select("_text").mapInPandas(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


ANCHOR = "g long, f1 long, f2 long, doc long, hash long, pos long, lo int, hi int"


def two_longs(data: bytes) -> tuple[int, int]:
    """A 128-bit hash."""
    import xxhash

    x = xxhash.xxh3_128_digest(data)
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def scan(texts: DataFrame, known, with_text: bool) -> DataFrame:
    """Anchors whose string the filter lets pass: ANCHOR; or, each string twice a task at most, with the bytes of all their windows."""

    names = ["g", "f1", "f2", "doc", "hash", "pos", "lo", "hi", *["held"] * with_text]

    def run(frames):
        seen: dict[tuple[int, int], int] = {}
        for pdf in frames:
            for part in batches([pdf], BATCH, "_text"):
                rows = []
                for doc, key, text in zip(part["_doc"].tolist(), part["_hash"].tolist(), part["_text"]):
                    raw = text.encode()
                    for slab in anchor_slabs(np.frombuffer(raw, dtype=np.uint8)):
                        ok = np.flatnonzero(passes(slab[1], known.value))
                        for k in range(0, len(ok), EMIT):
                            at, g, lo, hi = (x[ok[k : k + EMIT]] for x in slab)
                            for x, p, a, b in zip(g.view(np.int64).tolist(), at.tolist(), lo.tolist(), hi.tolist()):
                                held = raw[p - b : p - a + LENGTH]
                                f1, f2 = two_longs(b"%d %d " % (a, b) + held)
                                if not with_text:
                                    rows.append((x, f1, f2, doc, key, p, a, b))
                                    continue
                                # whether there is one or more is all that counts
                                times = seen.get((f1, f2), 0)
                                if times < 2:
                                    seen[f1, f2] = times + 1
                                    rows.append((x, f1, f2, doc, key, p, a, b, held))
                            if len(rows) > EMIT:  # a run of one character makes every position an anchor
                                yield pd.DataFrame(rows, columns=names)
                                rows = []
                if len(seen) > 1_000_000:
                    seen = {}
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return texts.select("_doc", "_hash", "_text").mapInPandas(run, ANCHOR + ", held binary" * with_text)


NODE = "core long, f1 long, f2 long, run long, own boolean"  # run: anchor * 256 + k


def split(live: DataFrame, level: int) -> DataFrame:
    """The shorter runs of each anchor's open runs (todo: array of (k, own)), as NODE rows."""
    wide, short = SPANS[level - 1], SPANS[level]

    def run(frames):
        import xxhash

        for pdf in frames:
            rows = []
            for aid, lo, hi, held, todo in pdf.itertuples(index=False):
                held = bytes(held)
                for item in todo:
                    first = item["k"] * wide
                    for k in range(first // short, (min(first + wide, STARTS) - 1) // short + 1):
                        least, most = k * short, min((k + 1) * short, STARTS) - 1
                        a, b = max(lo, least), min(hi, most)
                        if a > b:
                            continue
                        # what all windows of the unclipped run share, so that runs that differ at their ends meet
                        core = xxhash.xxh3_64_intdigest(b"%d " % k + held[hi - least : hi - most + LENGTH]) - (1 << 63)
                        rows.append((core, *two_longs(b"%d %d " % (a, b) + held[hi - b : hi - a + LENGTH]), aid * 256 + k, item["own"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])

    return live.select("aid", "lo", "hi", "held", "todo").mapInPandas(run, NODE)


def spans_of(rows: DataFrame) -> DataFrame:
    """Bytes that the windows of runs cover."""
    return rows.select("doc", "hash", (F.col("pos") - F.col("hi")).alias("s"), (F.col("pos") - F.col("lo") + LENGTH).alias("e"))


def repeated_spans(texts: DataFrame, root: str) -> DataFrame:
    """(doc, hash, spans): for each keyed row with repeats, arrays (s, e) whose union goes."""
    full, many = ["f1", "f2"], F.count(F.lit(1)).alias("n")

    def stored(df: DataFrame, name: str) -> DataFrame:
        return cut(df, f"{root}/{name}")

    twice = stored(count_grams(texts).filter("n > 1").select("g"), "twice")
    known = bit_filter(twice, twice.count(), f"{root}/filter-0")
    first = stored(scan(texts, known, False), "anchors")
    fulls = stored(first.groupBy(*full).agg(many, F.min("g").alias("g")), "fulls")
    parts = [stored(spans_of(first.join(fulls.filter("n > 1").select(*full), full, "left_semi")), "spans-0")]
    open_g = stored(fulls.groupBy("g").agg(F.sum("n").alias("n"), F.min("n").alias("least")).filter("n > 1 and least = 1").select("g"), "open")
    # one anchor for each string that is still open, with its bytes
    known = bit_filter(open_g, open_g.count(), f"{root}/filter-1")
    row = F.struct("doc", "hash", "pos", "lo", "hi", "held")
    held = scan(texts, known, True).groupBy(*full).agg(F.first(row).alias("r"), many, F.first("g").alias("g"))
    held = held.join(open_g, "g", "left_semi").select(F.monotonically_increasing_id().alias("aid"), "r.*", (F.col("n") == 1).alias("own"))
    held = stored(held, "held")
    live = held.select("aid", "lo", "hi", "held", F.array(F.struct(F.lit(0).alias("k"), F.col("own").alias("own"))).alias("todo"))
    for level in range(1, len(SPANS)):
        short = SPANS[level]
        nodes = stored(split(live, level), f"nodes-{level}")
        ranked = stored(nodes.groupBy(*full).agg(many, F.min("core").alias("core"), F.min("run").alias("run"), F.max("own").alias("own")), f"ranked-{level}")
        mine = nodes.filter("own").join(ranked.filter("n > 1").select(*full), full, "left_semi")
        mine = mine.select(F.shiftright("run", 8).alias("aid"), (F.col("run") % 256).cast("int").alias("k"))
        mine = mine.join(held.select("aid", "doc", "hash", "pos", F.col("lo").alias("l"), F.col("hi").alias("h")), "aid")
        mine = mine.withColumns({"lo": F.greatest("l", F.col("k") * short), "hi": F.least("h", (F.col("k") + 1) * short - 1)})
        parts.append(stored(spans_of(mine), f"spans-{level}"))
        if level == len(SPANS) - 1:
            break
        still = ranked.groupBy("core").agg(F.sum("n").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("core")
        rest = ranked.join(still, "core", "left_semi")
        item = F.struct((F.col("run") % 256).cast("int").alias("k"), ((F.col("n") == 1) & F.col("own")).alias("own"))
        todo = rest.groupBy(F.shiftright("run", 8).alias("aid")).agg(F.collect_list(item).alias("todo"))  # at most STARTS runs of one anchor
        live = held.select("aid", "lo", "hi", "held").join(stored(todo, f"todo-{level}"), "aid")
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    # equal rows share a key: what they have in common comes once; spans that touch are one
    w = Window.partitionBy("doc", "hash").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.distinct().withColumn("fresh", F.coalesce(F.col("s") > before, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc", "hash", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return stored(runs.groupBy("doc", "hash").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")


def reranked(rows: DataFrame, root: str) -> DataFrame:
    """(doc, pos, key) -> (doc, pos, rank): keys in order get growing ranks; positions of a key found once leave."""
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    order = cut(several.repartitionByRange("key").sortWithinPartitions("key").select("key", F.monotonically_increasing_id().alias("rank")), f"{root}-order")
    return cut(rows.join(order, "key").select("doc", "pos", "rank"), root)


def ranks(texts: DataFrame, root: str, length: int = LENGTH) -> DataFrame:
    """Prefix doubling over (doc, text): (doc, pos, rank) of the positions whose string of `length` bytes
    is found at another position, too; equal strings share a rank, and ranks grow as strings do.

    The strings of 8 bytes are ranked first. Each round pairs the ranks at p and p + offset, the offset
    growing with the length that is ranked, sorts the pairs and ranks them. A position that leaves takes
    those with it whose pair needs it: a string that holds a unique one is unique. doc must tell rows
    apart. This is a row for each byte and round.
    """
    raw, h = text_of("text").cast("binary"), min(8, length)
    rows = texts.select("doc", raw.alias("raw")).filter(F.length("raw") >= length)
    rows = rows.select("doc", "raw", F.explode(F.sequence(F.lit(0), F.length("raw") - h)).alias("pos"))
    now = reranked(rows.select("doc", "pos", F.expr(f"substring(raw, pos + 1, {h})").alias("key")), f"{root}/ranks-{h}")
    while h < length:
        offset = min(h, length - h)
        after = now.select("doc", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("second"))
        pairs = now.join(after, ["doc", "pos"]).select("doc", "pos", F.struct("rank", "second").alias("key"))
        h += offset
        now = reranked(pairs, f"{root}/ranks-{h}")
    return now


def union_of(spans) -> list[tuple[int, int]]:
    """Maximal runs of a union of spans."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in (spans if spans is not None else ())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut_out(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in runs:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]])


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", root: str | None = None, text_as: str = "_text", spans_as: str = "_spans") -> DataFrame:
    """docs with its text (null: empty) as text_as and spans as spans_as (null: nothing goes)."""
    doc, key = free(docs, "_doc", "_hash")
    text = text_of(text_col)
    # doc and key tell rows apart but for equal ones, which lose the same
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.withColumns({doc: number, key: F.xxhash64(text, F.col(id_col).isNull()), text_as: text})
    spans = repeated_spans(rows.select(F.col(doc).alias("_doc"), F.col(key).alias("_hash"), F.col(text_as).alias("_text")), root or work_dir(docs.sparkSession, "repeats"))
    spans = spans.select(F.col("doc").alias(doc), F.col("hash").alias(key), F.col("spans").alias(spans_as))
    return rows.join(spans, [doc, key], "left").drop(doc, key)


DIGESTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])


@F.pandas_udf(DIGESTS)
def digests(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for t, x in zip(text, spans):
        raw, runs = t.encode(), union_of(x)
        rows.append((len(raw), sum(e - s for s, e in runs), len(runs), hashlib.sha256(cut_out(raw, runs)).hexdigest()))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


@F.pandas_udf(T.StringType())
def kept_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    """What is left, without halves of characters at the cuts."""
    return pd.Series([t if x is None else cut_out(t.encode(), union_of(x)).decode(errors="ignore") for t, x in zip(text, spans)], dtype=object)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_spans(docs).select("doc_id", digests("_text", "_spans").alias("r")).select("doc_id", "r.*")
