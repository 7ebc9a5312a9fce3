"""Embedding near-duplicates by inverted lists and product quantisation.

Vectors are normalised. A coarse k-means, whose number of centres grows with the square root of the vectors, gives inverted lists; product
quantisation codes each vector's residual in SUBSPACES sub-vectors of CODES centres. All centres are fitted over all vectors by Lloyd's
iterations that pass sums and counts alone to the driver; the search for a vector's nearest lists, the costly part, is done once for coding,
routing and the codebooks' iterations. Every vector is a query: it is sent to its nearest PROBES lists, but for those that by the triangle
inequality hold nothing within reach, compared there by table look-ups of its own residual against the codes, and pairs that the look-up,
with SLACK for its error, puts within reach are reranked by the exact cosine. A list with more than HOT vectors is searched by several
tasks. Vectors that are equal are collapsed first, so copies cost no pairs of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, mix, ranges, ship, written
from .simhash import components

COSINE = 0.95
SUBSPACES, CODES = 8, 256
#: Vectors a list has on average are LIST_FACTOR * sqrt(n); lists probed; Lloyd iterations of the lists' centres and of the codebooks. The
#: centres are broadcast: in 64 dimensions 0.3 MB for a million vectors and 60 MB for 5 * 10**10.
LIST_FACTOR, PROBES, COARSE_ITERATIONS, ITERATIONS = 1.0, 4, 3, 5
#: What the look-up's squared distance may exceed the true one by at most, in standard deviations of the coding error.
SLACK = 4.0
#: Vectors of a list to a task; each task has the codes of all of the list, and so many of its vectors as queries.
HOT = 50_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Normalised rows; a row of zeros stays one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each row's k nearest centres, nearest first, and their distances."""
    out = np.zeros((len(x), min(k, len(centres))), np.int64)
    far = np.zeros(out.shape, np.float32)
    half = (centres**2).sum(1) / 2
    step = max(1, (1 << 22) // max(len(centres), 1))
    for i in range(0, len(x), step):
        d = half - x[i : i + step] @ centres.T
        if k == 1:
            near = d.argmin(1)[:, None]
        else:
            near = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        out[i : i + step] = near
        far[i : i + step] = 2 * np.take_along_axis(d, near, 1) + (x[i : i + step] ** 2).sum(1)[:, None]
    return out, np.sqrt(np.maximum(far, 0))


def _sums(vectors: DataFrame, assign, groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums, of `width` numbers, and counts of the rows that `assign` gives each group, over all rows; partitions add up before anything is
    sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((groups, width)), np.zeros(groups, np.int64)
        for batch in batches:
            if batch.num_rows:
                for rows, group in assign(batch):
                    np.add.at(total, group, rows)
                    count += np.bincount(group, minlength=groups)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["g", "n", "s"])

    parts = vectors.mapInArrow(run, "g bigint, n bigint, s array<double>")
    rows = parts.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]).toArrow()
    total, count = np.zeros((groups, width)), np.zeros(groups)
    g = rows.column("g").to_numpy()
    count[g] = rows.column("n").to_numpy()
    for i in range(width):
        total[g, i] = rows.column(f"s{i}").to_numpy()
    return total, count


def _moved(centres: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres).astype(np.float32)


class Index:
    """Coarse centres, the residuals' codebooks, and the coding error's mean and deviation."""

    def __init__(self, coarse: np.ndarray, books: np.ndarray):
        self.coarse, self.books, self.error = coarse, books, (0.0, 0.0)
        self.sizes = np.zeros(len(coarse))

    def codes(self, residual: np.ndarray) -> np.ndarray:
        m = len(self.books)
        return np.stack([_nearest(r, b)[0][:, 0] for r, b in zip(np.split(residual, m, axis=1), self.books)], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distance of each query's sub-vectors to every code."""
        m = len(self.books)
        return np.stack([((r[:, None, :] - b[None]) ** 2).sum(2) for r, b in zip(np.split(residual, m, axis=1), self.books)], 1)


def coarse_centres(vectors: DataFrame, n: int, dim: int, iterations: int = COARSE_ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """The lists' centres, and the vectors that all fitting starts from: those whose hashes are least."""
    k = max(1, min(n, int(round(LIST_FACTOR * math.sqrt(n)))))
    first = vectors.orderBy(F.xxhash64("v"), "v").limit(max(k, min(n, CODES))).select("v").toArrow().column(0).combine_chunks()
    seed = _matrix(first if isinstance(first, pa.Array) else first.chunk(0))
    coarse = seed[:k].copy()
    for _ in range(iterations):

        def assign(batch: pa.RecordBatch, coarse=coarse):
            x = _matrix(batch.column(0))
            return [(x, _nearest(x, coarse)[0][:, 0])]

        coarse = _moved(coarse, *_sums(vectors.select("v"), assign, k, dim))
    return coarse, seed


def listed(vectors: DataFrame, coarse: np.ndarray, probes: int) -> DataFrame:
    """id, v, and the nearest lists with their distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, far = _nearest(_matrix(batch.column(1)), coarse, probes)
                off = pa.array(np.arange(0, near.size + 1, near.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(off, near.ravel().astype(np.int32)), pa.ListArray.from_arrays(off, far.ravel())], names=["id", "v", "near", "far"])

    return written(vectors.select("id", "v").mapInArrow(run, "id bigint, v array<float>, near array<int>, far array<float>"))


def fit(rows: DataFrame, coarse: np.ndarray, seed: np.ndarray, iterations: int = ITERATIONS) -> Index:
    """The codebooks over the residuals of all rows of listed(), the coding error, and the lists' sizes."""
    dim = coarse.shape[1]
    m = next(s for s in range(min(SUBSPACES, dim), 0, -1) if dim % s == 0)
    sub = dim // m
    rest = seed - coarse[_nearest(seed, coarse)[0][:, 0]]
    books = np.stack([np.resize(r, (CODES, sub)) + (1e-4 * np.arange(CODES, dtype=np.float32)[:, None] if len(r) < CODES else 0) for r in np.split(rest, m, axis=1)]).astype(np.float32)
    first = rows.select("v", F.col("near")[0].alias("list"))

    def residual(batch: pa.RecordBatch) -> np.ndarray:
        return _matrix(batch.column(0)) - coarse[batch.column(1).to_numpy()]

    for _ in range(iterations):

        def assign(batch: pa.RecordBatch, books=books):
            return [(part, j * CODES + _nearest(part, b)[0][:, 0]) for j, (part, b) in enumerate(zip(np.split(residual(batch), m, axis=1), books))]

        total, count = _sums(first, assign, m * CODES, sub)
        books = _moved(books.reshape(m * CODES, sub), total, count).reshape(m, CODES, sub)
    index = Index(coarse, books)

    def errors(batch: pa.RecordBatch):
        r = residual(batch)
        e = np.linalg.norm(r - index.decoded(index.codes(r)), axis=1)
        return [(np.stack([e, e**2], 1), batch.column(1).to_numpy().astype(np.int64))]

    total, index.sizes = _sums(first, errors, len(coarse), 2)
    n = index.sizes.sum()
    mean = total[:, 0].sum() / n
    index.error = (float(mean), float(math.sqrt(max(total[:, 1].sum() / n - mean**2, 0))))
    return index


PAIRS = "a bigint, b bigint, cosine double"


def _search(query: tuple, base: tuple, index: Index, centre: int, cosine: float) -> pa.Table:
    """Pairs of a list's queries and members with a < b that the look-up lets through and the exact cosine confirms."""
    qn, qx = query
    bn, bx, codes = base
    reach = math.sqrt(max(2 - 2 * cosine, 0)) + index.error[0] + SLACK * index.error[1]
    out_a, out_b, out_c = [], [], []
    tables = None
    step = max(1, (1 << 21) // max(len(bn), 1))
    m = len(index.books)
    for i in range(0, len(qn), step):
        part = qx[i : i + step]
        tables = index.tables(part - index.coarse[centre])
        d = np.zeros((len(part), len(bn)), np.float32)
        for j in range(m):
            d += tables[:, j, :][:, codes[:, j]]
        q, b = np.nonzero(d <= reach * reach)
        less = qn[i + q] != bn[b]
        q, b = q[less], b[less]
        exact = np.einsum("ij,ij->i", part[q], bx[b]).astype(float)
        good = exact >= cosine
        x, y = qn[i + q[good]], bn[b[good]]
        out_a.append(np.minimum(x, y))
        out_b.append(np.maximum(x, y))
        out_c.append(exact[good])
    cat = [np.concatenate(x) if x else np.zeros(0) for x in (out_a, out_b, out_c)]
    return pa.table([pa.array(cat[0].astype(np.int64)), pa.array(cat[1].astype(np.int64)), pa.array(cat[2].astype(float))], names=["a", "b", "cosine"])


def near_pairs(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, probes: int = PROBES) -> DataFrame:
    """vec_a < vec_b, the cosine, rounded to six places, of near vectors, and `same`: whether they are equal.

    Of vectors that are equal, the one with the least id is paired with each other copy (cosine 1, same) and alone stands for them in other
    pairs; all_pairs() gives the rest. Vectors that are null, empty, without direction, with a null or NaN in them, or without an id, have
    no partner; those of different lengths are searched apart. Rows that repeat count once. Other columns are left out.
    """
    ship(df.sparkSession)
    v = F.col("v")
    base = columns(df, id_col, vector_col).toDF("id", "v").selectExpr("cast(id as bigint) id", "cast(v as array<float>) v").filter("id is not null and v is not null")
    base = base.filter((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = written(base.distinct())
    unique = written(rows.groupBy("v").agg(F.min("id").alias("id")))
    copies = rows.join(unique.select("v", F.col("id").alias("a")), "v").filter("a <> id").select("a", F.col("id").alias("b"), F.lit(1.0).alias("cosine"), F.lit(True).alias("same"))
    out = copies
    for dim, n in sorted((r.dim, r.n) for r in unique.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()):
        if n > 1:
            out = out.unionByName(_pairs_of(unique.filter(F.size("v") == dim), n, dim, cosine, probes).withColumn("same", F.lit(False)))
    return out.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"), F.round("cosine", 6).alias("cosine"), "same")


def all_pairs(pairs: DataFrame) -> DataFrame:
    """vec_a < vec_b and cosine of every pair, copies' own and those with what is near them among them, of what near_pairs() gave."""
    copies = pairs.filter("same").select(F.col("vec_a").alias("rep"), F.col("vec_b").alias("id"))
    near = pairs.filter("not same")
    stands = near.select(F.col("vec_a").alias("rep")).union(near.select("vec_b")).union(copies.select("rep")).distinct()
    members = copies.union(stands.select("rep", F.col("rep").alias("id")))
    left, right = members.toDF("vec_a", "x"), members.toDF("vec_b", "y")
    others = near.join(left, "vec_a").join(right, "vec_b").select("x", "y", "cosine")
    own = copies.select("rep").distinct().join(members.toDF("rep", "x"), "rep").join(members.toDF("rep", "y"), "rep").filter("x < y").select("x", "y", F.lit(1.0))
    return others.union(own).select(F.least("x", "y").alias("vec_a"), F.greatest("x", "y").alias("vec_b"), "cosine")


def groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, probes: int = PROBES) -> DataFrame:
    """vec_id, group_id, links and same_as, for every row.

    group_id is the least id of those that near pairs connect it with, links the number of other vectors that are near it, all copies
    counted, and same_as the least id of the vectors that equal it, if that is another. Of an id with several vectors the links add up. A vector without a partner is a group of its own; a
    row without an id has neither group nor links. Other columns are left out.
    """
    ids = columns(df, id_col).toDF("vec_id").select(F.col("vec_id").cast("bigint"))
    pairs = written(near_pairs(df, id_col, vector_col, cosine, probes))
    same, near = pairs.filter("same"), pairs.filter("not same")
    # Vectors that are equal are counted and connected by the one that stands for them.
    copies = written(same.select(F.col("vec_a").alias("rep"), F.col("vec_b").alias("id")))
    size = copies.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("more"))
    ends = near.select(F.col("vec_a").alias("rep"), F.col("vec_b").alias("id")).union(near.select("vec_b", "vec_a"))
    around = ends.join(size, "id", "left").groupBy("rep").agg(F.sum(F.lit(1) + F.coalesce("more", F.lit(0))).alias("links"))
    labels = components(pairs.select(F.col("vec_a").alias("a"), F.col("vec_b").alias("b")))
    members = copies.union(near.select("vec_a", "vec_a").union(near.select("vec_b", "vec_b")).union(copies.select("rep", F.col("rep"))).distinct())
    links = members.join(around, "rep", "left").join(size.withColumnRenamed("id", "rep"), "rep", "left")
    links = links.groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("links"), F.min(F.when(F.col("rep") != F.col("id"), F.col("rep"))).alias("same_as"))
    found = labels.join(links.withColumnRenamed("id", "node"), "node").withColumnRenamed("node", "vec_id")
    return ids.join(found, "vec_id", "left").select("vec_id", F.coalesce("label", "vec_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "same_as")


def _pairs_of(vectors: DataFrame, n: int, dim: int, cosine: float, probes: int) -> DataFrame:
    coarse, seed = coarse_centres(vectors, n, dim)
    rows = listed(vectors, coarse, probes)
    index = fit(rows, coarse, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    reach = math.sqrt(max(2 - 2 * cosine, 0))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        tasks = np.maximum(1, -(-ix.sizes.astype(np.int64) // HOT))
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.num_rows
            x = _matrix(batch.column(1))
            near, far = (batch.column(c).flatten().to_numpy().reshape(k, -1) for c in (2, 3))
            codes = pa.array([c.tobytes() for c in ix.codes(x - ix.coarse[near[:, 0]])], pa.binary())
            draw = (mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(1)).astype(np.int64)
            for j in range(near.shape[1]):
                if j:
                    # What is within reach is in a list whose centre is no further than the nearest one's distance and twice the reach.
                    row = np.flatnonzero(far[:, j] <= far[:, 0] + 2 * reach + 1e-4)
                    split = draw[row] % tasks[near[row, j]]
                    asks, code = np.ones(len(row), bool), pa.nulls(len(row), pa.binary())
                else:
                    per = tasks[near[:, 0]]
                    row, split = np.repeat(np.arange(k), per), ranges(np.zeros(k, np.int64), per)
                    asks, code = split == (draw % per)[row], codes.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(near[row, j].astype(np.int64)), pa.array(split), pa.array(asks), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), code], names=["list", "split", "asks", "id", "v", "code"])

    def search(table: pa.Table) -> pa.Table:
        ix = shared.value
        member, asks = table.column("code").is_valid().to_numpy(), table.column("asks").to_numpy()
        ids = table.column("id").to_numpy()
        v = table.column("v").combine_chunks()
        x = _matrix(v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks))
        if not member.any():
            return _search((ids[:0], x[:0]), (ids[:0], x[:0], np.zeros((0, len(ix.books)), np.uint8)), ix, 0, cosine)
        code = table.column("code").filter(pa.array(member)).to_pylist()
        codes = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
        return _search((ids[asks], x[asks]), (ids[member], x[member], codes), ix, table.column("list")[0].as_py(), cosine)

    routed = rows.mapInArrow(route, "list bigint, split bigint, asks boolean, id bigint, v array<float>, code binary")
    return routed.groupBy("list", "split").applyInArrow(search, PAIRS).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
