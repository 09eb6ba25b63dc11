"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles (all words, if it has fewer), words lower-cased in A-Z
and cut at ASCII blanks. Two texts are near copies if the longest common subsequence L of their
shingles gives L / (a + b - L) >= 0.8: the Jaccard similarity of the sequences in their order.

* Sketch: each of SKETCHES hashes picks the PICKS smallest occurrence-labelled shingles, kept in text
  order; texts that share a pick in the same order share a bucket. At similarity 0.8 a sketch agrees
  with probability about 0.5, so a pair escapes all with probability under 1e-6.
* Texts of the same words are one class and compared as one, whatever ids they have.
* In each bucket every class is compared with the bucket's smallest; this is a row for each member,
  not for each pair. Links make components. Buckets whose other members still lie in several
  components are compared within tasks, a block against a block, blocks bounded by texts and by
  characters: posting lists of shingles count what a text shares with each other text of the two
  blocks, and only pairs of different components that share enough are aligned. No bucket is
  capped, and no pair of a bucket is left undecided between components.
* Alignment: pairs that differ by more than (a + b) / 9 insertions and deletions cannot be near
  copies, so the alignment is confined to that band, bit-parallel. In long texts whose shingles are found
  a few times each it goes by the matches, which takes n log n steps; long texts of few distinct
  shingles keep the band, whose work grows with the square of their length.

Defined results: null text is empty; texts without words are near copies of nothing; each row is a
document of its own, so rows that repeat an id with other texts lie in classes of their own, in any
order of rows; a null id is larger than any other: its class_id is the smallest id of its class, null
if that has none (kept is then true); an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .exact_dedup import bit_filter, may_contain
from .shared import batches, cut, normalised, table, text_of, work_dir

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 20
PICKS = 3
BLOCK = 2048  # classes of a block in the comparison within buckets
BLOCK_CHARS = 8 << 20  # and its characters, but for single longer texts
BATCH = 4 << 20
WIDE_BAND = 4096  # shingles; from there on an alignment goes by its matches
FEW_MATCHES = 16  # for each shingle at most, or else by bits after all
WIDE = 1 << 16  # shingles from which on sketches are made one by one
SEEDS = np.random.default_rng(11).integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """Hash of each run of `size` words; of all words, if there are fewer."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(w))
    out = w[: len(w) - size + 1].copy()
    for j in range(1, size):
        out = out * MULTIPLIER + w[j : len(w) - size + 1 + j]
    return mixed(out)


def labelled(sh: np.ndarray) -> np.ndarray:
    """Each shingle with the number of its occurrence."""
    order = np.argsort(sh, kind="stable")
    s = sh[order]
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, dtype=bool)
    number = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0)) if len(s) else np.zeros(0, dtype=np.int64)
    out = np.empty_like(sh)
    out[order] = mixed(s + number.astype(np.uint64) * MULTIPLIER)
    return out


def sketch(sh: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of the smallest labelled shingles in text order."""
    label, picks = labelled(sh), min(PICKS, len(sh))
    if len(sh) <= WIDE:
        h = mixed(label[None, :] ^ SEEDS[:, None])
        at = np.argpartition(h, picks - 1, axis=1)[:, :picks] if picks < len(sh) else np.tile(np.arange(len(sh)), (SKETCHES, 1))
    else:
        at = np.stack([np.argpartition(mixed(label ^ s), picks - 1)[:picks] for s in SEEDS])
    at.sort(axis=1)
    acc = SEEDS.copy()
    for j in range(picks):
        acc = mixed(acc * MULTIPLIER + sh[at[:, j]])
    return acc


def common(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence over matches at most `band` apart, a bit for each column of the band.

    With a wide band, sequences whose elements are found a few times each go by their matches instead.
    """
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    if band > WIDE_BAND and sum(len(where.get(x, ())) for x in a) <= FEW_MATCHES * (len(a) + len(b)):
        return by_matches(a, where, band)
    width = 2 * band + 1
    mask = (1 << width) - 1
    v, found = mask, 0  # bit t of row i is column i - band + t; zeros are matches
    for i, x in enumerate(a):
        low, m = i - band, 0
        for j in where.get(x, ()):
            if 0 <= j - low < width:
                m |= 1 << (j - low)
        if m:
            u = v & m
            v = ((v + u) | (v & ~m)) & mask
        found += not v & 1
        v = v >> 1 | 1 << (width - 1)
    return found + width - v.bit_count()


def by_matches(a: list[int], where: dict[int, list[int]], band: int) -> int:
    """The same as the longest rising run of places in b, taken in the order of a: a search for each match."""
    ends: list[int] = []  # the least last place of a common subsequence of each length
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            if -band <= j - i <= band:
                k = bisect_left(ends, j)
                if k == len(ends):
                    ends.append(j)
                else:
                    ends[k] = j
    return len(ends)


def similar(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, bound: float = SIMILARITY) -> bool:
    """Whether two shingle sequences are near copies. la, lb: their sorted labelled shingles."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < bound * max(n, m) - 1e-9:
        return False
    need = bound * (n + m) / (1 + bound) - 1e-9
    if len(np.intersect1d(la, lb, assume_unique=True)) < need:
        return False
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    if head + tail >= need:
        return True
    x, y = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    return head + tail + common(x, y, int(n + m - 2 * need) + 1) >= need


def prepared(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    sh = shingles(tokens(text), hashes)
    return sh, np.sort(labelled(sh))


def compared(ready: list, reps: np.ndarray, block: np.ndarray | None, part: np.ndarray) -> list[tuple[int, int]]:
    """Links (of reps) that join all near copies among the texts `ready`, given what `part` joins already.

    Texts of the same block are not compared (block None: all are). The texts go by length; each asks
    the posting lists of its labelled shingles for how many it shares with every longer one.
    """
    length = np.array([len(sh) for sh, _ in ready])
    order = np.argsort(length, kind="stable")
    length, part, at = length[order], part[order].copy(), order.tolist()
    owner = np.repeat(np.arange(len(at)), length)
    flat = np.concatenate([ready[k][1] for k in at])
    by_label = np.argsort(flat, kind="stable")  # owners ascend within a label
    label = flat[by_label]
    begins = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    ends = np.append(begins[1:], len(label))
    posting = owner[by_label]
    place = np.empty(len(flat), dtype=np.int64)  # each shingle's own place in its list
    place[by_label] = np.arange(len(flat))
    end = np.repeat(ends, ends - begins)
    edges, out = np.concatenate([[0], np.cumsum(length)]), []
    for u, k in enumerate(at):
        mine = place[edges[u] : edges[u + 1]]
        after = [posting[p + 1 : e] for p, e in zip(mine.tolist(), end[mine].tolist()) if e > p + 1]
        if not after:
            continue
        shared = np.bincount(np.concatenate(after), minlength=len(at))
        enough = shared >= SIMILARITY * (length[u] + length) / (1 + SIMILARITY) - 1e-9
        if block is not None:
            enough &= block[order] != block[k]
        for v in np.flatnonzero(enough & (part != part[u])).tolist():
            if part[v] != part[u] and similar(*(ready[x][y] for y in (0, 1) for x in (k, at[v]))):
                part[part == part[v]] = part[u]
                out.append((int(reps[k]), int(reps[at[v]])))
    return out


SKETCH = "row long, doc_id long, no_id boolean, key binary, keys array<long>, size long"


def sketches(docs: DataFrame) -> DataFrame:
    """SKETCH of (row, doc_id, no_id, key, text); texts without words have no key and no keys."""

    def run(frames):
        hashes = WordHashes()
        for pdf in frames:
            for part in batches([pdf], BATCH, "text"):
                key, keys = part["key"].tolist(), []
                for i, text in enumerate(part["text"]):
                    words = tokens(text)
                    keys.append(sketch(shingles(words, hashes)).view(np.int64) if words else [])
                    if not words:
                        key[i] = None
                yield part[["row", "doc_id", "no_id"]].assign(key=key, keys=keys, size=part["text"].str.len())

    return docs.mapInPandas(run, SKETCH)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", root: str | None = None) -> DataFrame:
    """One row per row of docs: id_col, class_id (smallest id of its near copies), kept."""
    spark = docs.sparkSession
    root = root or work_dir(spark, "near")
    text, doc = text_of(text_col), F.col(id_col).cast("long")
    whole = docs.select(F.coalesce(doc, F.lit(0).cast("long")).alias("doc_id"), doc.isNull().alias("no_id"), F.unhex(F.md5(F.trim(normalised(text)))).alias("key"), text.alias("text"))
    made = cut(sketches(whole.withColumn("row", F.monotonically_increasing_id())), f"{root}/sketches")
    classes = made.filter("key is not null").groupBy("key").agg(
        F.min("row").alias("rep"), F.min(F.when(~F.col("no_id"), F.col("doc_id"))).alias("first"), F.min(F.struct("doc_id", "no_id")).alias("one"), F.first("keys").alias("keys"), F.max("size").alias("size")
    )
    classes = cut(classes, f"{root}/classes")

    members = classes.select("rep", "size", F.posexplode("keys").alias("j", "key")).select("rep", "size", F.xxhash64("j", "key").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader")).filter("n > 1")
    inside = cut(members.join(buckets, "bucket"), f"{root}/members")
    pairs = cut(inside.filter("rep <> leader").groupBy("leader", "rep").agg(F.count(F.lit(1)).alias("shared")).drop("shared"), f"{root}/pairs")

    # texts of the classes that meet others; the filter drops the rest, and all but one id's rows of a class, before a shuffle
    row_of = lambda key, one: F.xxhash64(key, F.when(~one["no_id"], one["doc_id"]))
    wanted = cut(classes.join(inside.select("rep").distinct(), "rep").select("rep", "key", row_of(F.col("key"), F.col("one")).alias("which")), f"{root}/wanted")
    found = bit_filter(wanted, "which", wanted.count())
    few = may_contain(whole.select("key", row_of(F.col("key"), F.struct("doc_id", "no_id")).alias("which"), "text"), "which", found)
    texts = few.groupBy("key").agg(F.first("text").alias("text"))  # of the same words: any of them
    texts = cut(texts.join(wanted.select("rep", "key"), "key").select("rep", "text"), f"{root}/texts")
    both = pairs.join(texts, "rep").join(texts.select(F.col("rep").alias("leader"), F.col("text").alias("other")), "leader")

    def verify(frames):
        hashes, last, mine = WordHashes(), None, None
        for pdf in frames:
            out = []
            for a, b, text, other in pdf.itertuples(index=False):
                if last != a:
                    last, mine = a, prepared(other, hashes)
                theirs = prepared(text, hashes)
                if similar(mine[0], theirs[0], mine[1], theirs[1]):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    links = cut(both.select("leader", "rep", "text", "other").mapInPandas(verify, "a long, b long"), f"{root}/links")
    parts = components(links, f"{root}/first")

    # buckets whose members, besides the leader, lie in several components
    placed = inside.filter("rep <> leader and n > 2").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = cut(placed.select("bucket", "rep", "size", F.coalesce("component", "rep").alias("part")), f"{root}/placed")
    several = placed.groupBy("bucket").agg(
        F.min("part").alias("x"), F.max("part").alias("y"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("set")
    )
    several = several.filter("x < y").groupBy("set", "n", "size").agg(F.min("bucket").alias("bucket"))  # one of the buckets with the same members
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_CHARS))
    mine = placed.join(several.select("bucket", blocks.cast("long").alias("blocks")), "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    mine = mine.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "part")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        ready = [prepared(t, hashes) for t in pdf["text"]]
        apart = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        out = compared(ready, pdf["rep"].to_numpy(), pdf["block"].to_numpy() if apart else None, pdf["part"].to_numpy())
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    more = mine.join(texts, "rep").groupBy("bucket", "i", "j").applyInPandas(within, "a long, b long")
    linked = components(links.unionByName(more).distinct(), f"{root}/components").withColumnRenamed("node", "rep")
    # the smallest id of each component, for its classes and then for their rows; stored join by join,
    # as the driver holds the tasks of all the exchanges of one plan at once
    linked = cut(classes.select("rep", "first").join(linked, "rep").select("rep", "first", "component"), f"{root}/linked")
    firsts = linked.groupBy("component").agg(F.min("first").alias("least"))
    linked = cut(linked.join(firsts, "component").select("rep", "least"), f"{root}/least")
    of_key = cut(classes.select("rep", "key", "first").join(linked, "rep", "left").select("key", F.coalesce("least", "first").alias("class_id")), f"{root}/of-key")
    rows = made.select("key", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")).join(of_key, "key", "left")
    class_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return rows.select(F.col("doc_id").alias(id_col), class_id.alias("class_id"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
