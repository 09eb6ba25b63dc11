"""WARC archives with an index: written by tasks, read back by coalesced byte ranges.

Each task writes one gzip-per-record archive (rolled at `roll` bytes) through the file system that
the root's URI names, and returns an index row per record: file, offset, length, URL, digest. The
index is stored before anything is read. A reader selects index rows, sorts them by file and offset,
joins neighbours into ranges and reads each range at once. An archive of an attempt that was lost
is never in the index.

Of records with equal payloads of at least `least` bytes the one with the largest page_id is the
response and the others revisit it; a revisit holds the response's HTTP head, with the payload's
length, and its digest, but no payload.

Defined results: a null payload counts as empty; null URLs are left out of the record; equal
payloads are told by SHA-1, SHA-256 and length; records that repeat the largest page_id are all responses;
a null page_id is smaller than any other (a group of null ids is all responses); an empty table
gives an empty index. Columns other than those named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, slices, table, work_dir

LEAST = 1000  # payloads of fewer bytes are never revisits
ROLL = 1 << 30  # bytes of an archive before a task begins another
CHUNK = 8 << 20  # bytes of one range read
TASK = 128 << 20  # bytes of archives that one task reads
GAP = 64 << 10  # bytes between selected records that are read and dropped

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def store(uri: str):
    """File system and path of a URI: file, hdfs, s3 and the like."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member. digest: lower-case hex SHA-1."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + gz.compress(block + b"\r\n\r\n") + gz.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of one uncompressed WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def read_record(member: bytes) -> tuple:
    """A row of RECORD from one gzip member."""
    from urllib.parse import unquote

    fields, block = parse(zlib.decompress(member, 31))
    head, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?im)^content-length: (\d+)", head)[1])
    kind = fields["warc-type"]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['warc-record-id']}: the payload is damaged")
    url = unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None
    return page_of(fields["warc-record-id"]), url, payload if kind == "response" else None, n, digest, kind, page_of(fields.get("warc-refers-to"))


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """page_id, url, payload, digest, refers_to and whether the record is a revisit."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.length("payload"), "same": F.unhex(F.sha2("payload", 256))})
    large = rows.filter(F.col("n") >= least)
    # ids and digests alone are gathered, and by map-side sums; the payloads move once
    keepers = large.groupBy("digest", "same", "n").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    rows = rows.join(keepers, ["digest", "same", "n"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("keeper")).alias("refers_to"), revisit.alias("revisit"))


def _int(x) -> int | None:
    return None if pd.isna(x) else int(x)


def write_archives(
    pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, roll: int = ROLL
) -> DataFrame:
    """Write archives below root/archives and their index to root/index; the index."""

    def write(frames):
        fs, path = store(f"{root}/archives")
        fs.create_dir(path, recursive=True)
        ctx = TaskContext.get()
        out, at, part = None, 0, 0
        for pdf in frames:
            rows = []
            for page_id, url, payload, digest, refers_to, revisit in pdf.itertuples(index=False):
                if out is None or at >= roll:
                    if out is not None:
                        out.close()
                    name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{part:03d}.warc.gz"
                    out, at, part = fs.open_output_stream(f"{path}/{name}", compression=None), 0, part + 1
                page_id, refers_to = _int(page_id), _int(refers_to)
                member = record(page_id, url, bytes(payload), digest, refers_to, revisit)
                out.write(member)
                rows.append((name, at, len(member), page_id, url, digest, "revisit" if revisit else "response", refers_to))
                at += len(member)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if out is not None:
            out.close()

    return cut(with_revisits(pages, id_col, url_col, payload_col, least).mapInPandas(write, INDEX), f"{root}/index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = CHUNK) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) joined into (start, end, members)."""
    out: list = []
    for offset, length in rows:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], offset + length)
            out[-1][2].append((offset, length))
        else:
            out.append([offset, offset + length, [(offset, length)]])
    return [tuple(x) for x in out]


def read_selected(selected: DataFrame, root: str) -> DataFrame:
    """The records that index rows (file, offset, length) name, as RECORD rows."""

    def read(frames):
        fs, path = store(f"{root}/archives")
        for pdf in frames:
            for name, part in pdf.groupby("file", sort=False):
                rows = []
                with fs.open_input_file(f"{path}/{name}") as f:
                    for start, end, members in ranges(sorted(zip(part["offset"].tolist(), part["length"].tolist()))):
                        f.seek(start)
                        raw = f.read(end - start)
                        rows += [read_record(raw[o - start : o - start + n]) for o, n in members]
                        if sum(len(r[2] or b"") for r in rows) > CHUNK:
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    # a large archive is dealt out by chunks of it, over as many tasks as its bytes ask for
    spark = selected.sparkSession
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(slices(total, TASK), min(spark.sparkContext.defaultParallelism, slices(total, CHUNK)))
    dealt = selected.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / CHUNK))
    return dealt.sortWithinPartitions("file", "offset").mapInPandas(read, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), root)
    return read_selected(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
         max(page_id) OVER (PARTITION BY payload) AS keeper
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM d
"""
