"""Near-duplicate vectors: an exact metric range join over pivot cells.

Cosine >= 0.9 is an angle of at most r, and angles are a metric. A bounded number of pivots spread
over a bounded sample gives each vector its home, the nearest pivot. By the triangle inequality a
vector within r of one whose home is q has an angle to q of at most w + r (w: the widest angle of
those it is held against to q) and of at most its own nearest angle + 2 r, and is within r of the plane
halfway between q and its own home. Vectors are sorted by cell and stored as blocks, a row each, of
at most BLOCK vectors of one cell, with the least angle to each pivot of the vectors that satisfy the
last two. Two blocks are compared if these angles leave a link between them possible, by a product
of the stored table with itself that copies nothing to disk: a task reads its part of either side. So
the disk taken is a few times the vectors, however many cells a vector has to be held against; the work
is that of the pairs of blocks. Pivots grow with the table, one for CELL vectors, up to MAX_PIVOTS for a
length; beyond 33 million vectors cells grow instead, in blocks of the same size. A task returns
counts and, for components, edges that connect what its links connect: a count for each vector of
its parts, and an edge where its smallest number known changes. Products are compared in single precision where that
is certain and else in double. Rows of equal vectors, but for their length, take part as one vector that counts as
many, so a vector that a third of all rows repeat is compared once; they are known by 128 bits of a hash.

Defined results: vectors that are null, zero, or hold null or non-finite components, link with
nothing: n_links 0, component_id their own id. Vectors of different lengths never link. Every row is
a vector of its own, compared whatever its id: rows that repeat an id have links and components of
their own, and so have rows with a null id, whose component_id is the smallest id of their component,
null if it has none (kept is then true). An empty table gives no rows. Labels and other columns are
not read. The vectors are read more than once: their rows must not change meanwhile.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .components import components
from .shared import cut, slices, table, work_dir

COSINE = 0.9
SAMPLE = 4096  # vectors that pivots are chosen from
MAX_PIVOTS = 4096
CELL = 8192  # vectors that a pivot is meant for
BLOCK = 4096  # vectors of one block
BLOCK_BYTES = 32 << 20  # of a block's vectors, in double precision
STRIP = 1024  # vectors whose angles to all pivots are held at once, or their products with a block
SLACK = 1e-7  # of angles, for rounding
SALTS = 16  # parts of the rows that share a vector
UNSURE = 1e-4  # single-precision cosines nearer to the bound are computed again
AGAIN = 1 << 16  # so many of them at once
TOP = np.iinfo(np.int64).max


def scaled_rows(raw) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of one length (double), each divided by its largest component, and which rows they are."""
    x = np.array(raw, dtype=np.float64)
    ok = np.isfinite(x).all(axis=1)
    largest = np.abs(np.where(np.isfinite(x), x, 0)).max(axis=1, initial=0)
    at = np.flatnonzero(ok & (largest > 0))
    return x[at] / largest[at, None], at  # neither overflow nor underflow in the squares


def unit_rows(raw) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (double) of the usable vectors of one length, and which rows they are."""
    x, at = scaled_rows(raw)
    return x / np.linalg.norm(x, axis=1)[:, None], at


def usable(batch: pa.RecordBatch):
    """Of each vector length in a batch: which rows are usable, their values as they are, and scaled."""
    v = batch.column("v")
    sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dims)
        flat = pc.list_flatten(v.take(pa.array(at)))
        raw = pc.fill_null(flat, pa.scalar(math.nan, flat.type)).to_numpy(zero_copy_only=False).reshape(-1, dims)
        scaled, ok = scaled_rows(raw)
        yield int(dims), at[ok], raw[ok], scaled


def keys_of(scaled: np.ndarray) -> list[bytes]:
    return [blake2b(x.tobytes(), digest_size=16).digest() for x in scaled]


def keyed(batches):
    """id, no_id, dims and key of every row; dims 0 and no key where it can link with nothing."""
    for batch in batches:
        dims, key = np.zeros(len(batch), dtype=np.int32), np.full(len(batch), None, dtype=object)
        for d, at, _, scaled in usable(batch):
            dims[at], key[at] = d, keys_of(scaled)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("no_id"), pa.array(dims), pa.array(key, pa.binary())], ["id", "no_id", "dims", "key"])


def matrix(raw: bytes, dims: int, kind: str) -> np.ndarray:
    """Unit vectors of a block."""
    return unit_rows(np.frombuffer(raw, dtype=kind).reshape(-1, dims))[0]


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def spread(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows of the sample, each the farthest from those before."""
    chosen, far = [0], angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(k, len(sample)):
        i = int(far.argmax())
        if far[i] <= 1e-6:
            break
        chosen.append(i)
        far = np.minimum(far, angles(sample, sample[i : i + 1])[:, 0])
    return sample[chosen]


def goes(theta: np.ndarray, own: np.ndarray, chord: np.ndarray, reach: float) -> np.ndarray:
    """Of vectors with angles theta to pivots and own to their home's: which can be within reach of a vector whose home is that pivot.

    The plane between both pivots parts the cells: its angle to the vector, by the pivots' chord.
    """
    inside = np.cos(own)[:, None] - np.cos(theta) <= math.sin(min(reach, math.pi / 2)) * chord + SLACK
    return inside & (theta <= own[:, None] + 2 * reach + SLACK)


def linked(home: np.ndarray, other: np.ndarray, cosine: float) -> np.ndarray:
    """Boolean matrix of cosine >= bound, exact in double."""
    a, b = home.astype(np.float32), other.astype(np.float32)
    out = np.zeros((len(a), len(b)), dtype=bool)
    for at in range(0, len(a), STRIP):
        s = a[at : at + STRIP] @ b.T
        part = s >= np.float32(cosine - UNSURE)
        if not part.any():
            continue
        i, j = np.nonzero(part & (s < np.float32(cosine + UNSURE)))
        for k in range(0, len(i), AGAIN):
            x, y = i[k : k + AGAIN], j[k : k + AGAIN]
            part[x, y] = np.einsum("ij,ij->i", home[at + x], other[y]) >= cosine
        out[at : at + STRIP] = part
    return out


def lowered(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers of rows and columns the smallest of all that the links connect with each."""
    rows, cols = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    links, a, b = links[np.ix_(rows, cols)], a.copy(), b.copy()
    x, y = a[rows], b[cols]
    while len(rows):
        was = x.copy(), y.copy()
        for at in range(0, len(rows), 256):  # minima over the links, a strip at a time
            part = links[at : at + 256]
            y = np.minimum(y, np.where(part, x[at : at + 256, None], TOP).min(axis=0))
        for at in range(0, len(rows), 256):
            part = links[at : at + 256]
            x[at : at + 256] = np.minimum(x[at : at + 256], np.where(part, y[None, :], TOP).min(axis=1))
        if np.array_equal(x, was[0]) and np.array_equal(y, was[1]):
            break
    a[rows], b[cols] = x, y
    return a, b


def merged(vectors: pd.DataFrame) -> pd.DataFrame:
    """Rows of equal vectors as one."""
    by = ["dims", "cell", "key"]
    if not vectors.duplicated(by).any():
        return vectors
    how = {"row": "first", "raw": "first", "copies": "sum", "least": "min", "no_id": "min"}
    return vectors.groupby(by, sort=False, as_index=False).agg({k: v for k, v in how.items() if k in vectors})


def per_block(dims: int) -> int:
    return max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))


#: Vectors that stand for their equals: copies says for how many, least is the smallest id of these; no_id says that none has one.
PLACED = pa.schema([("dims", pa.int32()), ("cell", pa.int32()), ("key", pa.binary()), ("raw", pa.binary()), ("copies", pa.int64()), ("least", pa.int64()), ("no_id", pa.bool_())])
#: The i-th vector of a block has the number block + i. near: of each pivot the least angle of a vector that may link with one of its cell.
BLOCKS = "block long, dims int, cell int, widest double, near array<double>, raw binary, key array<binary>, copies array<long>, least array<long>, no_id array<boolean>"


def few_at_once(df: DataFrame, path: str) -> DataFrame:
    """cut(), with rows given to Python one by one, as each holds two blocks."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = conf.get(name)
    conf.set(name, "1")
    try:
        return cut(df, path)
    finally:
        conf.set(name, was)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, root: str | None = None) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept."""
    spark = vectors.sparkSession
    root = root or work_dir(spark, "vectors")
    single = isinstance(getattr(vectors.schema[vec_col].dataType, "elementType", None), FloatType)
    kind = "f4" if single else "f8"
    key = F.col(id_col).cast("long")
    rows = vectors.select(F.coalesce(key, F.lit(0).cast("long")).alias("id"), key.isNull().alias("no_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v"))
    reach = math.acos(cosine) + SLACK
    of_size = rows.filter("v is not null and size(v) > 0").select("v", F.size("v").alias("dims"))
    sizes = {r["dims"]: r["n"] for r in of_size.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each vector length
    pivots: dict[int, np.ndarray] = {}
    for dims, n in sizes.items():
        k = min(MAX_PIVOTS, slices(n, CELL))
        pivots[dims] = np.eye(1, dims)  # one cell, whatever its pivot
        if k > 1:
            want = min(SAMPLE, 16 * k)
            share = math.ceil(2 * want / n * (1 << 20))
            some = of_size.filter((F.col("dims") == dims) & (F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < share)).select("v").distinct()
            few = some.orderBy(F.xxhash64("v")).limit(want).collect()
            sample = unit_rows([[math.nan if c is None else c for c in r["v"]] for r in few])[0] if few else []
            if len(sample):
                pivots[dims] = spread(sample, k)
    shared = spark.sparkContext.broadcast(pivots)

    def placed(batches):
        """Vectors with their cells; those that are equal within a batch are one."""
        for batch in batches:
            ids, none = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "no_id"))
            for dims, at, raw, scaled in usable(batch):
                unit, home = scaled / np.linalg.norm(scaled, axis=1)[:, None], shared.value[dims].T
                cell = [(unit[i : i + STRIP] @ home).argmax(axis=1) for i in range(0, len(unit), STRIP)]
                if not cell:
                    continue
                pdf = pd.DataFrame({"dims": np.int32(dims), "cell": np.concatenate(cell).astype(np.int32), "key": keys_of(scaled), "raw": [r.tobytes() for r in raw], "copies": np.int64(1), "least": np.where(none[at], TOP, ids[at]), "no_id": none[at].astype(bool)})
                yield pa.RecordBatch.from_pandas(merged(pdf), schema=PLACED, preserve_index=False)

    def block(part: pd.DataFrame) -> pd.DataFrame:
        dims, cell, raw = int(part["dims"].iloc[0]), int(part["cell"].iloc[0]), b"".join(part["raw"])
        unit, pivot = matrix(raw, dims, kind), shared.value[dims]
        chord = 2 * np.sin(angles(pivot[cell : cell + 1], pivot)[0] / 2)
        widest, near = 0.0, np.full(len(pivot), np.inf)
        for at in range(0, len(unit), STRIP):
            theta = angles(unit[at : at + STRIP], pivot)
            own = theta[:, cell]
            can = goes(theta, own, chord, reach)
            can[:, cell] = True
            widest, near = max(widest, float(own.max())), np.minimum(near, np.where(can, theta, np.inf).min(axis=0))
        held = {c: [part[c].tolist()] for c in ("key", "copies", "least", "no_id")}
        return pd.DataFrame({"block": part["row"].iloc[:1].to_numpy(), "dims": np.int32(dims), "cell": np.int32(cell), "widest": widest, "near": [near], "raw": [raw]} | held)

    def blocks_of(frames):
        """Rows sorted by cell and vector, cut where a cell ends or a block is full; what may have equals to come waits."""
        held = None
        for pdf in frames:
            pdf = merged(pdf if held is None else pd.concat([held, pdf], ignore_index=True))
            cells, held = [part for _, part in pdf.groupby(["dims", "cell"], sort=False)], None
            for part in cells:
                each, at = per_block(int(part["dims"].iloc[0])), 0
                while len(part) - at > (each if part is cells[-1] else 0):
                    yield block(part.iloc[at : at + each])
                    at += each
                held = part.iloc[at:]
        if held is not None and len(held):
            yield block(held)

    by = ("dims", "cell", "key")
    parts = slices(sum(slices(n, per_block(d)) for d, n in sizes.items()), 2)
    home = "dims int, cell int, key binary, raw binary, copies long, least long, no_id boolean"
    in_order = rows.mapInArrow(placed, home).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    blocks = cut(in_order.withColumn("row", F.monotonically_increasing_id()).mapInPandas(blocks_of, BLOCKS), f"{root}/blocks")

    # each two blocks meet once, in an order that spreads them over the tasks
    one = blocks.select("block", "dims", "cell", "widest", "near", "raw", "copies")
    two = one.toDF(*[f"{c}2" for c in one.columns]).hint("shuffle_replicate_nl")
    turn = F.struct(F.xxhash64("block"), "block") <= F.struct(F.xxhash64("block2"), "block2")
    near = (F.get("near2", F.col("cell")) <= F.col("widest") + reach + SLACK) & (F.get("near", F.col("cell2")) <= F.col("widest2") + reach + SLACK)
    pairs = one.join(two, (F.col("dims") == F.col("dims2")) & turn & near).drop("near", "near2", "dims2")

    def within(unit: np.ndarray, dims: int, cell: int, other: int, widest: float) -> np.ndarray:
        """Which vectors of a cell can link with one of another cell that is at most `widest` from its pivot."""
        if cell == other:
            return np.arange(len(unit))
        pivot = shared.value[dims][[cell, other]]
        theta = angles(unit, pivot)
        can = goes(theta[:, 1:], theta[:, 0], 2 * np.sin(angles(pivot[:1], pivot[1:])[0] / 2), reach)[:, 0]
        return np.flatnonzero(can & (theta[:, 1] <= widest + reach + SLACK))

    def join(frames):
        n: dict[int, np.ndarray] = {}  # links of the vectors of each block that the task meets
        least: dict[int, np.ndarray] = {}  # the smallest number known to be in a vector's component
        edges: list[np.ndarray] = []
        for pdf in frames:
            for p in pdf.itertuples(index=False):
                x, y = matrix(p.raw, p.dims, kind), matrix(p.raw2, p.dims, kind)
                i, j = within(x, p.dims, p.cell, p.cell2, p.widest2), within(y, p.dims, p.cell2, p.cell, p.widest)
                links = linked(x[i], y[j], cosine)
                if not links.any():
                    continue
                for k, size in ((p.block, len(x)), (p.block2, len(y))):
                    if k not in n:
                        n[k], least[k] = np.zeros(size, dtype=np.int64), k + np.arange(size, dtype=np.int64)
                many = np.asarray(p.copies2, dtype=np.int64)[j] - 1
                hot = np.flatnonzero(many)
                n[p.block][i] += links.sum(axis=1) + links[:, hot] @ many[hot]
                if p.block == p.block2:
                    n[p.block] -= 1  # itself
                else:
                    many = np.asarray(p.copies, dtype=np.int64)[i] - 1
                    hot = np.flatnonzero(many)
                    n[p.block2][j] += links.sum(axis=0) + many[hot] @ links[hot]
                was = least[p.block][i], least[p.block2][j]
                now = lowered(links, *was)
                for a, b in zip(was, now):
                    if (a != b).any():
                        edges.append(np.unique(np.stack([a, b], axis=1)[a != b], axis=0))
                least[p.block][i] = now[0]
                least[p.block2][j] = now[1]
        for k, sums in n.items():
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"row": k + at, "to": k + at, "n": sums[at]})
        if edges:
            e = np.unique(np.concatenate(edges), axis=0)
            yield pd.DataFrame({"row": e[:, 0], "to": e[:, 1], "n": np.int64(0)})

    found = few_at_once(pairs.mapInPandas(join, "row long, to long, n long"), f"{root}/found")
    groups = components(found.filter("n = 0").select(F.col("row").alias("a"), F.col("to").alias("b")), f"{root}/components")
    links = found.filter("n > 0").groupBy("row").agg(F.sum("n").alias("links"))
    each = blocks.select("block", "dims", F.posexplode(F.arrays_zip("key", "copies", "least", "no_id")).alias("at", "v"))
    each = each.select((F.col("block") + F.col("at")).alias("row"), "dims", "v.key", "v.copies", F.when(~F.col("v.no_id"), F.col("v.least")).alias("least"))
    members = each.select("row", "least").join(groups.withColumnRenamed("node", "row"), "row")
    firsts = members.groupBy("component").agg(F.min("least").alias("first"))  # combined before the shuffle
    linked_to = members.join(firsts, "component").select("row", "first")
    result = each.join(links, "row").join(linked_to, "row", "left").select("dims", "key", "copies", "least", "links", F.coalesce("first", "least").alias("first"))
    # equal vectors as near to one pivot as to another can be in both cells
    result = cut(result.groupBy("dims", "key").agg(F.sum("copies").alias("copies"), F.min("least").alias("least"), F.max("links").alias("n_links"), F.min("first").alias("first")), f"{root}/result")
    # rows find their answer by the vector, dealt out as one may be very common; a vector that one row has goes with that row's id
    real_id = F.when(~F.col("no_id"), F.col("id"))
    salt = lambda id_: F.pmod(F.xxhash64(id_), F.lit(SALTS).cast("long"))
    salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(salt(F.col("least"))))
    shared_by = result.select("dims", "key", "n_links", "first", F.lit(True).alias("found"), F.explode(salts).alias("salt"))
    answer = rows.mapInArrow(keyed, "id long, no_id boolean, dims int, key binary").withColumn("salt", salt(real_id)).join(shared_by, ["dims", "key", "salt"], "left")
    answer = answer.select(real_id.alias("id"), "n_links", F.when(F.col("found"), F.col("first")).otherwise(real_id).alias("component"))
    component = F.coalesce("component", "id")
    return answer.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
