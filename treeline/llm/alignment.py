"""Alignment of two tokenizers over the exact texts of a corpus.

Texts are shuffled whole and met as groups of equal ones; each distinct text is tokenised and
aligned once, its pairs count as often as it has copies, and its measures go back to the ids. Two
tokens are linked where their byte ranges overlap, and the offsets where a token of each ends cut a
text into groups. How many documents hold a pair linked is counted corpus-wide by Spark; the counts
return to the texts by a join, for the most frequent pairs (at most HOT) by broadcast.

Within a text, a blank or line feed between two other characters begins a unit: no token of either
crosses the place before it. A task tokenises and aligns a unit once, as long as its cache, which is
bounded by characters, holds it.

Defined results: texts that are null, empty, or not given back byte for byte by both tokenizers have
no tokens: zeros, and the digest column is ''. Repeated rows count as documents each; null ids are
kept; other columns are never read; an empty table gives no rows. A text of any length is worked, in
memory in proportion to it.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate, chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batches, cut, table, text_of, work_dir

MARK = "▁"
UNIT = re.compile(r"\s+\S*(?:(?![ \n]\S)\s+\S*)*")
REGULAR = re.compile(r"(?s)[ \n]\S(?:.*\S)?")
LEAD = " ."  # stands before a unit that does not begin a text
TOGETHER = 1 << 14  # characters of units that are tokenised end to end
LONG = 4096  # longer units are tokenised on their own
LONG_RUN = re.compile(r"(?<!\s)\s{10000}|\S{10000}")  # and with such a run by the JSON tokenizer itself, not its rank twin
CACHE = 8 << 20  # characters of units that a task remembers
BATCH = 4 << 20  # characters worked at a time
HOT = 1 << 20  # pairs whose counts are broadcast at most
COPIES = 1000  # a text with more than a 1000th of all rows, of which there are fewer than that, finds its rows by broadcast

ALIGNED = "sha binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


class Numbers(dict):
    """Numbers its keys as they are first asked for; `fresh` lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class Aligner:
    """Measures of texts under tokenizers A (byte-level BPE) and B (SentencePiece)."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None, model: str | None = None):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.json = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
        self.json.encode_special_tokens = True
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
        self.a_raw = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_raw[i] = raw
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.b_raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.a_len, self.b_len = (np.array([len(x) for x in raw], dtype=np.int64) for raw in (self.a_raw, self.b_raw))
        #: no piece holds a line feed, or a mark behind another character
        self.parts = not any(MARK in p.lstrip(MARK) or "\n" in p for p in names)
        # decimal digits of an id and, behind them, the place of a separator
        n = max(len(self.a_raw), len(self.b_raw))
        self.digits = np.array([len(str(i)) for i in range(n)])
        self.decimal = np.frombuffer("".join(str(i).ljust(8) for i in range(n)).encode(), dtype=np.uint8).reshape(n, 8)
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.chars = 0
        self.groups: list[bytes] = []
        #: n_a, n_b, n_groups, n_links, whether the bytes differ, where the links begin
        self.stats = np.zeros((0, 6), dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A and B of a text that begins with a blank, if both give its bytes back."""
        a = self.json.encode(text, add_special_tokens=False).ids if len(text) > LONG and LONG_RUN.search(text) else self.quick.encode_ordinary(text)
        b, raw = self.sp.encode(text[1:], num_threads=1), text.encode()
        if b"".join(map(self.a_raw.__getitem__, a)) != raw or b"".join(map(self.b_raw.__getitem__, b)) != raw:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def behind(self, lead: int, ids: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of what stands behind the first `lead` bytes."""
        return tuple(x[np.searchsorted(np.cumsum(n[x]), lead) + 1 :] for x, n in zip(ids, (self.a_len, self.b_len)))

    def learn(self) -> None:
        """Align the units numbered last; short ones that neither begin nor end amid blanks are tokenised end to end."""
        units, self.known.fresh = self.known.fresh, []
        first = len(self.groups)
        self.chars += sum(map(len, units))
        self.groups += [b""] * len(units)
        wrong = np.zeros((len(units), 6), dtype=np.int64)
        wrong[:, 4] = 1
        self.stats = np.concatenate([self.stats, wrong])  # until they are aligned
        plain, single = [], []
        for k, u in enumerate(units, first):
            (plain if len(u) <= LONG and REGULAR.fullmatch(u) else single).append((k, u))
        good, a, b = [], [], []
        for _, run in groupby(zip(plain, accumulate(len(u) for _, u in plain)), lambda x: x[1] // TOGETHER):
            chunk = [x for x, _ in run]
            both = self.tokens("".join([LEAD, *(u for _, u in chunk)]))
            if both:
                good += chunk
                for ids, more in zip((a, b), self.behind(len(LEAD), both)):
                    ids.append(more)
            else:
                single += chunk
        if good:
            self.remember(good, np.concatenate(a), np.concatenate(b))
        for k, unit in single:
            lead = "" if unit[0] == " " else LEAD  # a line feed in front needs something before it
            one = self.tokens(lead + unit)
            if one:
                self.remember([(k, unit)], *(self.behind(len(lead), one) if lead else one))

    def remember(self, units: list[tuple[int, str]], a: np.ndarray, b: np.ndarray) -> None:
        """Numbered units end to end, with the ids of both tokenizers."""
        stop = np.cumsum([len(u.encode()) for _, u in units])
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        ends, where = np.unique(np.concatenate([a_end, b_end]), return_counts=True)
        # one link ends at each place where a token of either does
        pairs = a[np.searchsorted(a_end, ends)] << 32 | b[np.searchsorted(b_end, ends)]
        common = ends[where == 2]
        upto = np.stack([np.searchsorted(x, stop, side="right") for x in (a_end, b_end, common, ends)], axis=1)
        own = np.array([k for k, _ in units])
        self.stats[own, :4] = np.diff(upto, axis=0, prepend=0)
        self.stats[own, 4] = 0
        self.stats[own, 5] = len(self.pairs) + upto[:, 3] - self.stats[own, 3]
        self.pairs = np.concatenate([self.pairs, pairs])
        # the text of the groups: A's ids by commas, a bar, B's ids by commas, a semicolon behind each group
        run = np.concatenate([np.searchsorted(common, a_end) * 2, np.searchsorted(common, b_end) * 2 + 1])
        order = np.argsort(run, kind="stable")
        ids, run = np.concatenate([a, b])[order], run[order]
        last = np.append(run[1:] != run[:-1], True)
        sizes, cells = self.digits[ids], self.decimal[ids]
        cells[np.arange(len(ids)), sizes] = np.where(last, np.where(run % 2, ord(";"), ord("|")), ord(","))
        flat = cells[np.arange(8) <= sizes[:, None]].tobytes()
        edges = [0, *np.cumsum(sizes + 1)[upto[:, 0] + upto[:, 1] - 1].tolist()]
        for (k, _), x, y in zip(units, edges, edges[1:]):
            self.groups[k] = flat[x:y]

    def work(self, texts: list[str]) -> list[tuple]:
        """For each text n_a, n_b, n_groups, n_links, groups_sha256, its distinct pairs and how many links each has."""
        split = [(UNIT.findall(" " + t) if self.parts else [" " + t]) if t else [] for t in texts]
        if self.chars > CACHE:
            self.forget()
        edges = np.cumsum([0, *map(len, split)])
        mine = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(edges[-1]))
        self.learn()
        rows = self.stats[mine]
        sums = np.diff(np.concatenate([np.zeros((1, 6), dtype=np.int64), np.cumsum(rows, axis=0)])[edges], axis=0)
        sizes = rows[:, 3]
        links = self.pairs[np.repeat(rows[:, 5] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        upto = np.concatenate([[0], np.cumsum(sums[:, 3])])
        out, none = [], (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
        for k, s in enumerate(sums.tolist()):
            if not s[0] or s[4]:
                out.append(none)
                continue
            own, times = np.unique(links[upto[k] : upto[k + 1]], return_counts=True)
            sha = hashlib.sha256(b"".join(map(self.groups.__getitem__, mine[edges[k] : edges[k + 1]].tolist()))[:-1]).hexdigest()
            out.append((*s[:4], sha, own, times))
        return out


def distinct_aligned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """ALIGNED for every distinct text that is neither null nor empty. Copies are counted before the shuffle."""

    def run(frames):
        aligner = Aligner()
        for pdf in frames:
            for part in batches([pdf], BATCH, "text"):
                rows = aligner.work(part["text"].tolist())
                shas = [hashlib.sha256(t.encode()).digest() for t in part["text"]]
                yield pd.DataFrame([(s, c, *r) for s, c, r in zip(shas, part["copies"], rows)], columns=[c.split()[0] for c in ALIGNED.split(", ")])

    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.mapInPandas(run, ALIGNED)


def pair_counts(texts: DataFrame) -> DataFrame:
    """texts: rows of ALIGNED -> pair, n (documents that hold it linked), best (whether no pair of its A id has more)."""
    counts = texts.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def split_counts(counts: DataFrame, most: int = HOT) -> tuple[DataFrame, DataFrame | None]:
    """The pairs with the most documents, at most `most` of them, and the others (None: there are none)."""
    octave = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = sorted(((r["octave"], r["count"]) for r in counts.groupBy(octave.alias("octave")).count().collect()), reverse=True)  # at most 64 rows
    total, least = 0, None
    for k, size in sizes:
        if total + size > most:
            break
        total, least = total + size, k
    if least is None:
        return counts.limit(0), counts
    return counts.filter(octave >= least), None if least == sizes[-1][0] else counts.filter(octave < least)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", root: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of docs."""
    root = root or work_dir(docs.sparkSession, "alignment")
    texts = cut(distinct_aligned(docs, text_col), f"{root}/texts")
    counts = cut(pair_counts(texts), f"{root}/counts")
    often, seldom = split_counts(counts, hot)
    links = texts.select("sha", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("sha", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    sums = [F.sum(F.col("links") * F.col("best")).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")]
    found = links.join(F.broadcast(often), "pair").groupBy("sha").agg(*sums)  # at most `hot` rows are broadcast
    if seldom is not None:
        found = found.unionByName(links.join(F.broadcast(often), "pair", "left_anti").join(seldom, "pair").groupBy("sha").agg(*sums))
        found = found.groupBy("sha").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    answer = cut(texts.drop("pairs", "links").join(found, "sha", "left").select("sha", "copies", *numbers, "groups_sha256"), f"{root}/answer")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("sha"), (text_of(text_col) != "").alias("filled"))
    rows = answer.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    common = F.col("copies") * COPIES > rows  # true of fewer than COPIES texts
    held = answer.filter(common).withColumnsRenamed({c: f"_{c}" for c in [*numbers, "groups_sha256"]}).drop("copies")
    met = ids.join(F.broadcast(held), "sha", "left")
    # rows of common or empty texts have their answer; a key of their own deals them out evenly
    open_key = F.when(F.col("_n_a").isNull() & F.col("filled"), F.col("sha"))
    met = met.withColumn("key", F.coalesce(open_key, F.monotonically_increasing_id().cast("string").cast("binary")))
    met = met.join(answer.filter(~common).withColumnRenamed("sha", "key").drop("copies"), "key", "left")
    return met.select("doc_id", *[F.coalesce(f"_{c}", c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("_groups_sha256", "groups_sha256", F.lit("")).alias("groups_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures(table(spark, sf_dir, "documents"))
