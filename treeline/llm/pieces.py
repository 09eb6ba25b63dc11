"""SentencePiece encoding and decoding with forward states shared along a trie of words.

A marked text (blanks as U+2581) falls into words that no piece crosses. The distinct words of a
batch are sorted, which lays them out as the depth-first walk of their trie: neighbours share a
prefix, and the forward states of that prefix are kept, so each trie edge is worked once. A state
per prefix is all that is carried:

* unigram models: the best score of a segmentation of the prefix and its last piece (Viterbi);
* BPE models: the last piece of the prefix's encoding. Score sums do not give BPE's merges, so a
  last piece is right if it and the last piece before it stay apart when merged on their own;
  exactly one piece of a prefix does.

Texts are worked where they are read: nothing is shuffled, and a word that all rows hold costs the
same as any other. Memory is bounded by a batch and by a cache of words.

Defined results: null and empty texts have no pieces; characters outside the vocabulary become byte
pieces; a literal U+2581 decodes as a blank, as the format has it; ids outside the vocabulary raise.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batches, table, text_of

MARK = "▁"
CACHE = 400_000  # words whose ids a task remembers
LONG = 64  # longer words are encoded but not remembered
BATCH = 8 << 20  # characters whose distinct words are sorted together


class Vocabulary:
    """Pieces of a model file, and what the two traversals need of them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(self.size)]
        self.ids = {p: i for i, p in enumerate(self.text) if plain[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        #: every ending of a piece, and whether it is a piece itself
        self.endings = {p[i:]: False for p in self.ids for i in range(len(p))} | dict.fromkeys(self.ids, True)
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.lowest = min(self.score.values(), default=0.0) - 10.0
        # control pieces hold no text
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.encode() for i, p in enumerate(self.text)]
        self.prefix = sp.normalize("a").startswith(MARK)
        probe = "a  b \tc\néﬁ"
        self.identity = sp.normalize(probe) == (MARK if self.prefix else "") + probe.replace(" ", MARK)
        self.normalize = sp.normalize
        self.bpe = model_type(path) == 2
        crossed = [p for p in self.ids if MARK in p.lstrip(MARK)]
        lone = "".join(c for c in "\n\t\r\v\f" if not any(c in p and len(p) > 1 for p in self.ids))
        self.words = re.compile(f"[{lone}]|{MARK}*[^{MARK}{lone}]+|{MARK}+" if lone else f"{MARK}*[^{MARK}]+|{MARK}+") if not crossed else re.compile(r"(?s).+")

    def marked(self, text: str) -> str:
        if not text:
            return ""
        if self.identity:
            return (MARK if self.prefix else "") + text.replace(" ", MARK)
        return self.normalize(text)

    def emit(self, pieces: list[str]) -> np.ndarray:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return np.array(out, dtype="<u4")


def model_type(path: str) -> int:
    """trainer_spec.model_type of a model file (1 unigram, 2 BPE): field 3 of field 2, by the wire format."""

    def fields(buf: bytes):
        i = 0
        while i < len(buf):
            key, i = varint(buf, i)
            kind = key & 7
            if kind == 0:
                value, i = varint(buf, i)
            elif kind == 2:
                n, i = varint(buf, i)
                value, i = buf[i : i + n], i + n
            else:
                n = 8 if kind == 1 else 4
                value, i = buf[i : i + n], i + n
            yield key >> 3, value

    def varint(buf: bytes, i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = buf[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    with open(path, "rb") as f:
        data = f.read()
    for number, value in fields(data):
        if number == 2:
            return next((v for k, v in fields(value) if k == 3), 1)
    return 1


class Traversal:
    """Forward states over sorted words; the states of a shared prefix are reused."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.apart: dict[tuple[str, str], bool] = {}
        self.steps = 0  # trie edges worked

    def merged(self, text: str) -> list[str]:
        """BPE of a short text, merge by merge: best score first, then leftmost."""
        score, parts = self.v.score, list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            known = self.apart[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def last_bpe(self, word: str, n: int, back: list[int]) -> int:
        """Where the last piece of word[:n]'s encoding starts."""
        endings, found = self.v.endings, []
        for m in range(n - 2, -1, -1):
            whole = endings.get(word[m:n])
            if whole is None:
                break
            if whole:
                found.append(m)
        for m in reversed(found):  # the longest is the likeliest
            if self.stay_apart(word[back[m] : m], word[m:n]):
                return m
        return n - 1

    def walk(self, words: list[str]):
        """(word, ids) for sorted distinct words."""
        bpe, longest, score, lowest = self.v.bpe, self.v.longest, self.v.score, self.v.lowest
        previous, back, forward = "", [0], [0.0]
        for word in words:
            shared, most = 0, min(len(previous), len(word))
            while shared < most and previous[shared] == word[shared]:
                shared += 1
            del back[shared + 1 :], forward[shared + 1 :]
            self.steps += len(word) - shared
            for n in range(shared + 1, len(word) + 1):
                if bpe:
                    back.append(self.last_bpe(word, n, back))
                else:
                    best, at = forward[n - 1] + score.get(word[n - 1], lowest), n - 1
                    for m in range(max(0, n - longest), n - 1):
                        s = score.get(word[m:n])
                        if s is not None and forward[m] + s > best:
                            best, at = forward[m] + s, m
                    back.append(at)
                    forward.append(best)
            previous = word
            pieces, n = [], len(word)
            while n:
                pieces.append(word[back[n] : n])
                n = back[n]
            yield word, self.v.emit(pieces[::-1])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Coder:
    """Encodes batches of texts; decodes ids."""

    def __init__(self, path: str | None = None):
        self.v = Vocabulary(path or default_model())
        self.t = Traversal(self.v)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.v.words.findall(self.v.marked(t)) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        fresh = {w for words in split for w in words} - known.keys()
        now = {w: ids.tobytes() for w, ids in self.t.walk(sorted(fresh))}
        known.update(now)
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u4") for words in split]
        for w in fresh:
            if len(w) > LONG:
                del known[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = self.v.raw
        text = b"".join(map(raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.v.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, ids: the pieces of each whole text."""

    def run(frames):
        coder = Coder(model)
        for pdf in frames:
            for part in batches([pdf], BATCH, "text"):
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": [x.astype(np.int32) for x in coder.encode(part["text"].tolist())]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id, text of arrays of ids (null: empty)."""

    def run(frames):
        coder = Coder(model)
        for pdf in frames:
            texts = [coder.decode(np.asarray(x if x is not None else [], dtype=np.int64)) for x in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": texts})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """encode and decode in one pass: doc_id, n_pieces, ids_crc32, decoded_sha256."""

    def run(frames):
        coder = Coder(model)
        for pdf in frames:
            for part in batches([pdf], BATCH, "text"):
                rows = []
                for doc, ids in zip(part["doc_id"], coder.encode(part["text"].tolist())):
                    back = hashlib.sha256(coder.decode(ids).encode()).hexdigest()
                    rows.append((doc, len(ids), zlib.crc32(ids.tobytes()), back))
                yield pd.DataFrame(rows, columns=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 (of the text decoded from the ids)."""
    return digests(table(spark, sf_dir, "documents"))
