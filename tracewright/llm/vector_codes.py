"""Operator 11: product codes of vectors, by Lloyd rounds over cover trees.

Components become integers (``floor(scale * x)``), a vector is cut into ``parts`` equal
consecutive parts, and each part position has a codebook of up to ``size`` entries, which
start as the parts of the rows of the smallest ids.  A round assigns every part to its
nearest entry and moves each entry to the floor of its parts' mean; after the last round
parts are assigned once more.

Every partition cuts its rows into blocks, and builds a cover tree of the distinct parts of
a block for each position, once; the trees are written and read again by all rounds.  A
tree keeps its points in such an order that each subtree is a range, so cumulative sums
give the sum and the count of any subtree.  With r the largest distance of a point of the
subtree from its centre, and d1 <= d2 the centre's distances to the two nearest entries,
the whole subtree belongs to the nearest entry if d1 + r < d2 - r (triangle inequality);
otherwise its bucket is compared exactly, and its children are asked in turn.  A round
sends a row for each component of each entry from a task; the driver holds codebooks.

Rows with a null vector, or with a null or non-finite component, are dropped.  Components
beyond 2**27 in absolute value (after scaling) count as +-2**27.  The dimension is that of
the row of smallest id; a row of another dimension stays with null codes and error, and
teaches nothing.  Vectors whose dimension is no multiple of ``parts`` are filled up with
zeros.  Rows without id come after all others, rows of equal id in the order of their
components; repeated rows count as often as they occur.  With fewer than ``size`` rows
the codebook has an entry for each; without any row the result is empty.  Ties go to the
smaller entry.  Columns named in ``keep`` stay as they are, others are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import checkpointed

LIMIT = 1 << 27
#: products of components below this are exact sums in double precision, for up to 2**11 components
_EXACT = 1 << 21
_TILE = 1 << 11


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact."""
    if not points.size or max(np.abs(points).max(), np.abs(entries).max()) < _EXACT:
        p, e = points.astype(float), entries.astype(float)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for at in range(points.shape[1]):
        out += (points[:, at, None].astype(np.int64) - entries[None, :, at]) ** 2
    return out


class CoverTree:
    """Distinct points in the order of the tree.  Node i covers points low[i]:high[i]; of these
    low[i]:direct[i] are its own bucket (its centre first), the rest its children's."""

    FIELDS = {"points": np.int32, "weight": np.int32, "place": np.int32, "low": np.int32, "direct": np.int32, "high": np.int32,
              "child": np.int32, "children": np.int32, "radius": np.float64}

    def __init__(self, dims: int, **arrays: np.ndarray):
        for name, kind in self.FIELDS.items():
            setattr(self, name, np.asarray(arrays[name], kind))
        self.points = self.points.reshape(-1, dims)
        self.dims = dims

    @classmethod
    def build(cls, rows: np.ndarray, base: float = 1.6, bucket: int = 8) -> CoverTree:
        """``bucket``: a ball that holds fewer points is no node of its own."""
        points, place, weight = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        apart = np.sqrt(squares(points, points).astype(float))
        order: list[np.ndarray] = []
        nodes: list[list] = []
        # depth first, so that a subtree's points are neighbours; (members with the centre first, parent)
        stack = [(np.argsort(apart[0], kind="stable") if len(points) else np.zeros(0, int), -1)]
        filled = 0
        while stack:
            members, parent = stack.pop()
            away = apart[members[0], members]
            radius = float(away.max())
            low, children = filled, []
            own = members
            if radius > 0 and len(members) > bucket:
                close = apart[np.ix_(members, members)] <= radius / base
                alone = close.sum(axis=1) < bucket
                alone[0] = True  # the centre stays in its node's bucket
                left = ~alone
                loose = [np.flatnonzero(alone)]
                while left.any():
                    first = int(np.argmax(np.where(left, away, -1)))
                    ball = left & close[first]
                    at = np.flatnonzero(ball)
                    left &= ~ball
                    if len(at) < bucket:
                        loose.append(at)
                    else:
                        children.append(members[np.concatenate(([first], at[at != first]))])
                own = members[np.concatenate(loose)]
            order.append(own)
            filled += len(own)
            nodes.append([low, filled, low + len(members), parent, radius])
            stack += [(x, len(nodes) - 1) for x in reversed(children)]
        order_of = np.concatenate(order) if order else np.zeros(0, int)
        # children of a node get neighbouring numbers
        parents = np.array([x[3] for x in nodes])
        by_depth = np.zeros(len(nodes), int)
        for i, parent in enumerate(parents):
            by_depth[i] = 0 if parent < 0 else by_depth[parent] + 1
        rank = {-1: -1}
        sequence: list[int] = []
        for depth in range(by_depth.max(initial=-1) + 1):
            level = np.flatnonzero(by_depth == depth)
            level = level[np.argsort([rank[parents[i]] for i in level], kind="stable")]
            for i in level.tolist():
                rank[i] = len(sequence)
                sequence.append(i)
        new_parent = np.array([rank[parents[i]] for i in sequence], int)
        children = np.bincount(new_parent[1:], minlength=len(nodes)) if len(nodes) else np.zeros(0, int)
        child = np.searchsorted(new_parent, np.arange(len(nodes)))
        back = np.empty(len(points), int)
        back[order_of] = np.arange(len(points))
        table = [[nodes[i][k] for i in sequence] for k in (0, 1, 2, 4)]
        return cls(rows.shape[1], points=points[order_of], weight=weight[order_of], place=back[place.reshape(-1)],
                   low=table[0], direct=table[1], high=table[2], child=child, children=children, radius=table[3])

    def pack(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name in self.FIELDS}

    @classmethod
    def unpack(cls, dims: int, row: dict[str, bytes]) -> CoverTree:
        return cls(dims, **{name: np.frombuffer(row[name], kind) for name, kind in cls.FIELDS.items()})

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
        """The nearest entry of each point; the nodes given away whole and their entries; and
        the points that were compared one by one."""
        found = np.zeros(len(self.points), np.int64)
        whole, given, exact = [], [], []
        front = np.arange(min(1, len(self.low)))
        while len(front):
            following = []
            for i in range(0, len(front), _TILE):
                some = front[i:i + _TILE]
                far = squares(self.points[self.low[some]], entries)
                best = far.argmin(axis=1)
                radius = self.radius[some]
                near = np.sqrt(far.astype(float))
                if len(entries) > 1:
                    first, second = np.partition(near, 1, axis=1)[:, :2].T
                    sure = first + radius < second - radius - 1e-9 * (1 + second)
                else:
                    sure = np.ones(len(some), bool)
                # a node of one point is its centre, whose distances are exact
                sure |= self.high[some] - self.low[some] == 1
                whole.append(some[sure])
                given.append(best[sure])
                open_ = some[~sure]
                exact.append(_ranges(self.low[open_], self.direct[open_]))
                following.append(_ranges(self.child[open_], self.child[open_] + self.children[open_]))
            front = np.concatenate(following)
        whole, given = np.concatenate(whole or [front]), np.concatenate(given or [front])
        exact = np.concatenate(exact or [front])
        for i in range(0, len(exact), _TILE):
            found[exact[i:i + _TILE]] = squares(self.points[exact[i:i + _TILE]], entries).argmin(axis=1)
        found[_ranges(self.low[whole], self.high[whole])] = np.repeat(given, self.high[whole] - self.low[whole])
        return found, (whole, given), exact

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the parts of each entry: of subtrees by cumulative sums."""
        found, (whole, given), exact = self.assign(entries)
        weighted = self.points.astype(np.int64) * self.weight[:, None]
        running = np.vstack((np.zeros((1, self.dims), np.int64), np.cumsum(weighted, axis=0)))
        numbers = np.concatenate(([0], np.cumsum(self.weight, dtype=np.int64)))
        total, count = np.zeros((len(entries), self.dims), np.int64), np.zeros(len(entries), np.int64)
        low, high = self.low[whole], self.high[whole]
        np.add.at(total, given, running[high] - running[low])
        np.add.at(count, given, numbers[high] - numbers[low])
        np.add.at(total, found[exact], weighted[exact])
        np.add.at(count, found[exact], self.weight[exact])
        return total, count


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges low[i]:high[i], one after the other."""
    size = (high - low).astype(np.int64)
    if not size.sum():
        return np.zeros(0, np.int64)
    start = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(low - start, size)


def _usable(vector):
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def _integers(column: pa.Array, scale: float, width: int, dims: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
    with np.errstate(over="ignore"):
        whole = np.floor(np.clip(values * scale, -LIMIT, LIMIT)).astype(np.int64)
    return np.hstack((whole, np.zeros((len(whole), width - dims), np.int64)))


_ARROW_TREES = pa.list_(pa.struct([(x, pa.binary()) for x in CoverTree.FIELDS]))
_TREES = T.ArrayType(T.StructType([T.StructField(x, T.BinaryType()) for x in CoverTree.FIELDS]))
_SUMS = "part int, entry int, at int, value long"


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = 4,
             size: int = 256, rounds: int = 4, scale: float = 1024.0, block_rows: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """(id, kept columns, codes, error) of each row, and the codebooks (part, entry, component).

    ``codes`` has the number of the entry of each part, ``error`` the sum of squared distances.
    """
    names = [id_col, *(x for x in keep if x != id_col)]
    rows = df.select(F.struct(*(df[x] for x in names)).alias("key"), df[vector_col].cast("array<double>").alias("vector"))
    rows = rows.filter(_usable(F.col("vector")))
    in_order = [F.col(f"key.`{id_col}`").asc_nulls_last(), F.col("vector")]
    key_type = rows.schema["key"].dataType
    out = T.StructType([T.StructField("key", key_type), T.StructField("codes", T.ArrayType(T.IntegerType())),
                        T.StructField("error", T.LongType())])
    # the only rows that pass through the driver: ``size`` of them
    first = rows.select("key", "vector").orderBy(*in_order).limit(size).collect()
    if not first:
        return df.sparkSession.createDataFrame([], out).select("key.*", "codes", "error"), np.zeros((parts, 0, 0), np.int64)
    dims = len(first[0].vector)
    if any(len(r.vector) != dims for r in first):
        first = rows.filter(F.size("vector") == dims).select("key", "vector").orderBy(*in_order).limit(size).collect()
    width = max(-(-dims // parts), 1) * parts
    start = _integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), scale, width, dims)
    books = np.stack(np.split(start, parts, axis=1))

    blocks = T.StructType([T.StructField("keys", T.ArrayType(key_type)), T.StructField("trees", _TREES)])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, block_rows):
            whole = _integers(table["vector"].combine_chunks(), scale, width, dims)
            trees = [CoverTree.build(x).pack() for x in np.split(whole, parts, axis=1)]
            keys = table["key"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([trees], _ARROW_TREES)], ["keys", "trees"])

    planted = checkpointed(rows.filter(F.size("vector") == dims).mapInArrow(plant, blocks))
    for _ in range(rounds):
        moved = _moved(planted, books, width // parts)
        if (moved == books).all():
            break
        books = moved
    shared = df.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                codes, error = [], 0
                for part, row in enumerate(batch.column("trees")[at].as_py()):
                    tree = CoverTree.unpack(width // parts, row)
                    found, _, _ = tree.assign(shared.value[part])
                    gap = ((tree.points - shared.value[part][found]) ** 2).sum(axis=1)
                    codes.append(found[tree.place])
                    error = error + gap[tree.place]
                keys = batch.column("keys").slice(at, 1).flatten()
                flat_codes = np.stack(codes, axis=1).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * parts, pa.int32()), pa.array(flat_codes, pa.int32())),
                     pa.array(error, pa.int64())], ["key", "codes", "error"])

    coded = planted.mapInArrow(code, out)
    odd = rows.filter(F.size("vector") != dims).select(
        "key", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    return coded.union(odd).select("key.*", "codes", "error"), books


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, size - n))
            batch = batch.slice(size - n)
            n += held[-1].num_rows
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _moved(planted: DataFrame, books: np.ndarray, dims: int) -> np.ndarray:
    """The codebooks after one round; an entry without parts stays."""
    shared = planted.sparkSession.sparkContext.broadcast(books)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total = np.zeros(books.shape, np.int64)
        count = np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                for part, row in enumerate(batch.column("trees")[at].as_py()):
                    sums, n = CoverTree.unpack(dims, row).sums(books[part])
                    total[part] += sums
                    count[part] += n
        part, entry = np.nonzero(count)
        values = np.hstack((total[part, entry], count[part, entry][:, None]))
        width = dims + 1  # the last is the number of parts
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(part, width), pa.int32()), pa.array(np.repeat(entry, width), pa.int32()),
            pa.array(np.tile(np.arange(width), len(part)), pa.int32()), pa.array(values.reshape(-1), pa.int64())],
            ["part", "entry", "at", "value"])

    totals = planted.select("trees").mapInArrow(gather, _SUMS).groupBy("part", "entry", "at").agg(
        F.sum("value").alias("value")).toArrow()
    shared.unpersist()
    sums = np.zeros((*books.shape[:2], dims + 1), np.int64)
    sums[totals["part"].to_numpy(), totals["entry"].to_numpy(), totals["at"].to_numpy()] = totals["value"].to_numpy()
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def codebook_text(books: np.ndarray) -> str:
    """Components of all entries by part, entry and position, in decimals."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def with_label_error(coded: DataFrame, label_col: str, spread: int = 16) -> DataFrame:
    """``label_error``: the sum of the errors of all rows of the same label (null is one label).

    Sums are made before the shuffle; a label that many rows hold is spread over ``spread``
    keys where the sums meet the rows again."""
    sums = coded.groupBy(F.col(label_col).alias("of_label")).agg(F.sum("error").alias("label_error"))
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    rows = coded.withColumn("salt_of_row", F.pmod(F.xxhash64(*coded.columns), F.lit(spread)).cast("int"))
    return rows.join(salted, rows[label_col].eqNullSafe(salted["of_label"]) & (rows["salt_of_row"] == salted["salt"])).drop(
        "of_label", "salt", "salt_of_row")
