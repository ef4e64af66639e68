"""Operator 5: nearest neighbours by randomly rotated one-bit codes.

Every vector, less the mean, is turned by a random rotation and kept as the signs of its
components, with two correction scalars: its length, and the inner product of the
direction with its code.  An inner product with a query is estimated from packed bits
(the query in ``PLANES`` bit planes, popcounts), with a bound of the error.  A vector is
reranked by the exact inner product only if its upper bound reaches the k-th best of
lower bounds and exact scores so far.  Bounds hold with ``sigmas`` standard deviations, so
results are exact but for rare misses.

Queries are taken in blocks of ``query_block`` (the only thing broadcast; its size is
that times the dimensions).  A task keeps its k best of each query, and Spark ranks these.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do
rows without id or with another number of components than most have (the smaller number,
if equally many).  Rows of one id are vectors of their own, but none is a neighbour of a
query of the same id.  Ties go to the smaller id.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLANES = 6
#: queries and vectors estimated at once, and pairs reranked at once: they bound a task's memory
_TILE, _SLICE, _PAIRS = 128, 2048, 1 << 13


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random rotation of dims, padded to whole words of 64 bits."""
    size = -(-dims // 64) * 64
    turn, upper = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (turn * np.sign(np.diag(upper)))[:dims]


class Codes:
    """One-bit codes of vectors: packed signs, how many are set, and the scalars."""

    def __init__(self, vectors: np.ndarray, center: np.ndarray, turn: np.ndarray):
        turned = (vectors - center) @ turn
        self.length = np.linalg.norm(turned, axis=1)
        signs = turned > 0
        size = turn.shape[1]
        self.bits = np.packbits(signs, axis=1).view(np.uint64)
        self.ones = signs.sum(axis=1)
        dot = np.abs(turned).sum(axis=1) / np.sqrt(size)  # with its own code, of length 1
        self.agreement = np.where(self.length > 0, dot / np.maximum(self.length, 1e-300), 1.0)
        self.spread = self.length * np.sqrt(np.maximum(1 - self.agreement ** 2, 0)) / self.agreement / np.sqrt(size - 1)


class Queries:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, center: np.ndarray, turn: np.ndarray):
        self.ids, self.vectors = ids, vectors
        turned = vectors @ turn
        self.base, self.norm, self.sum = vectors @ center, np.linalg.norm(vectors, axis=1), turned.sum(axis=1)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [np.packbits(levels >> j & 1, axis=1).view(np.uint64) for j in range(PLANES)]

    def bounds(self, some: slice, codes: Codes, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and error bounds of the inner products, queries by vectors."""
        counts = np.zeros((len(self.ids[some]), len(codes.ones)), np.int32)
        for j, plane in enumerate(self.planes):
            for word in range(plane.shape[1]):
                both = np.bitwise_count(plane[some, word][:, None] & codes.bits[:, word])
                counts += both.astype(np.int32) << j
        size = self.planes[0].shape[1] * 64
        inside = self.step[some, None] * counts + self.low[some, None] * codes.ones
        with_code = (2 * inside - self.sum[some, None]) / np.sqrt(size)
        scale = codes.length / codes.agreement
        error = sigmas * (self.norm[some, None] * codes.spread + self.step[some, None] / np.sqrt(12) * scale)
        return self.base[some, None] + with_code * scale, error


def _best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, by score, then smaller id."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], ids[place < k], score[place < k]


def _search(queries: Queries, batches: Iterator[tuple[np.ndarray, np.ndarray]], center: np.ndarray, turn: np.ndarray, k: int,
            sigmas: float):
    n = len(queries.ids)
    row, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    reach = np.full(n, -np.inf)  # the k-th best score so far
    for own, vectors in batches:
        codes = Codes(vectors, center, turn)
        found = [(row, ids, score)]
        for i in range(0, n, _TILE):
            some = slice(i, min(i + _TILE, n))
            guess, error = queries.bounds(some, codes, sigmas)
            floor = reach[some].copy()
            same = queries.ids[some, None] == own
            if len(own) > k:
                low = np.where(same, -np.inf, guess - error)
                floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
            at, of = np.nonzero((guess + error >= floor[:, None]) & ~same)
            exact = np.empty(len(at))
            for j in range(0, len(at), _PAIRS):
                pairs = slice(j, j + _PAIRS)
                exact[pairs] = np.einsum("ij,ij->i", queries.vectors[at[pairs] + i], vectors[of[pairs]])
            found.append(_best(at + i, own[of], exact, k))
        row, ids, score = _best(*(np.concatenate(x) for x in zip(*found)), k)
        counts = np.bincount(row, minlength=n)
        last = np.cumsum(counts) - 1
        full = counts == k
        reach[full] = score[last[full]]
    return row, ids, score


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
            query_block: int = 1 << 15, sigmas: float = 3.5, seed: int = 7) -> DataFrame:
    """(query_id, rank, id, score): the k rows of largest inner product for each row that
    ``queries`` (a condition on the id) selects."""
    vector = F.col(vector_col)
    rows = df.filter(F.col(id_col).isNotNull() & usable(vector)).select(
        F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("vector"), queries.alias("asks"))
    out = "query_id long, id long, score double"
    usual = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not usual:
        none = df.sparkSession.createDataFrame([], out)
        return none.select("query_id", F.lit(0).alias("rank"), F.col("id").alias(id_col), "score")
    dims = usual[0].dims
    rows = rows.filter(F.size("vector") == dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims), 0
        for batch in batches:
            total += _matrix(batch.column("vector"), dims).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"nr": np.arange(dims), "total": total, "n": np.full(dims, n)})

    mean = rows.select("vector").mapInArrow(sums, "nr long, total double, n long").groupBy("nr").agg(
        (F.sum("total") / F.sum("n")).alias("mean")).orderBy("nr").collect()
    center, turn = np.array([r.mean for r in mean]), rotation(dims, seed)
    asked = rows.filter("asks")
    blocks = max(1, -(-asked.count() // query_block))
    spark, parts = df.sparkSession, []
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "vector").toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        vectors = _matrix(mine["vector"].combine_chunks(), dims)
        shared = spark.sparkContext.broadcast(Queries(mine["id"].to_numpy(), vectors, center, turn))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            slices = (b.slice(i, _SLICE) for b in batches for i in range(0, b.num_rows, _SLICE))
            data = ((b.column("id").to_numpy(), _matrix(b.column("vector"), dims)) for b in slices)
            row, ids, score = _search(shared.value, data, center, turn, k, sigmas)
            yield pa.RecordBatch.from_pydict({"query_id": shared.value.ids[row], "id": ids, "score": score})

        parts.append(rows.select("id", "vector").mapInArrow(search, out))
    if not parts:
        parts = [spark.createDataFrame([], out)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")
