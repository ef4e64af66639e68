"""Operator 9: near-duplicates by MinHash with tensored banding.

A document is the set of its shingles of ``shingle`` words (A-Z lower-cased; a shorter
text is one shingle).  Two documents are linked when their sets' Jaccard similarity is
``percent`` / 100 or more; groups are the connected components.

1. One pass over the texts gives each document the size and a 128-bit sum of its set, and
   two collections of ``half`` keys, each made of ``rows`` minhashes.  Documents with
   equal sets become one class.
2. Tensored banding: table (i, j) is keyed by key i of the first collection and key j of
   the second, so half * half tables cost only 2 * half * rows minhashes.  At similarity s a
   pair meets in none with probability of at most 2 * (1 - s**rows)**half: 0.004 % at 0.75,
   0.00012 % at 0.8 with the defaults.  Classes none of whose keys another class holds stop here.
3. Within a table's bucket, classes whose minhash sketches agree in ``agree`` or more (0.55 of
   120, five standard deviations below 0.75) are joined in a spanning forest, so a bucket gives
   fewer rows than members.  The components of these edges are the clusters to verify.
4. Verification on the full sets: a cluster's sets are compared within tasks, by counting
   common shingles, so no pair becomes a row; a large cluster is cut into blocks, each task
   compares two of them.  Tasks return links that span what they found connected.
5. Components of the verified links by alternating large-star and small-star steps.

Null or empty texts, and texts without words, have an empty set and are linked with
nothing.  Equal rows have equal sets and one component.  Ids may be null: the smallest
id of a group is taken over the others, and a group without any id has a null component.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, NOT_SPACE, U, flat, lists, mix, parts, run_hashes, runs, window_hashes, window_starts
from .components import connected_components
from .exchange import checkpointed, shuffle_partitions

#: shingles of a block (8 bytes each)
BLOCK_SHINGLES = 2 << 20
#: members of a bucket's block
BLOCK_MEMBERS = 1 << 15
#: rows of a task that makes buckets
PART_ROWS = 1 << 17


def shingle_sets(column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and offsets."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = runs(data, offsets, NOT_SPACE)
    words = run_hashes(data, starts, ends)
    at = np.flatnonzero(window_starts(first, shingle, len(words)))
    hashes = window_hashes(words, shingle)[at]
    doc = np.searchsorted(first, at, "right") - 1
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        whole = np.array([window_hashes(words[first[i]:first[i + 1]], int(counts[i]))[0] for i in short], U)
        hashes, doc = np.concatenate([hashes, whole]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def _minhashes(sets: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """(n, texts) minhashes; texts with an empty set hold no meaning."""
    out = np.zeros((n, len(offsets) - 1), U)
    if not len(sets):
        return out
    full = np.flatnonzero(np.diff(offsets))
    # multiples of one factor would make the same hashes small for many k
    for k, factor in enumerate(mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)):
        out[k, full] = np.minimum.reduceat((sets ^ (sets >> U(29))) * factor, offsets[full])
    return out


def signatures(docs: DataFrame, shingle: int, half: int, rows: int) -> DataFrame:
    """Set size, set sums, the two key collections and the sketch of every (row_key, id, text)."""
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    kinds = {"row_key": T.StringType(), "id": docs.schema["id"].dataType, "n": long, "sum_a": long, "sum_b": long, "first": longs,
             "second": longs, "sketch": T.BinaryType()}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", 1 << 19):
                sets, offsets = shingle_sets(part.column("text"), shingle)
                sizes = np.diff(offsets)
                sums = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets ^ U(salt)), dtype=U)])
                    sums.append(total[offsets[1:]] - total[offsets[:-1]])
                hashes = _minhashes(sets, offsets, 2 * half * rows)
                keys = np.zeros((2 * half, len(sizes)), U)
                for k in range(2 * half):
                    for value in hashes[k * rows:(k + 1) * rows]:
                        keys[k] = mix(keys[k] * U(0x9E3779B97F4A7C15) + value + U(k + 1))
                full = sizes > 0
                ends = np.concatenate(([0], np.cumsum(np.where(full, half, 0))))
                sketch = np.ascontiguousarray((mix(hashes) >> U(56)).astype(np.uint8).T)
                yield pa.RecordBatch.from_arrays([
                    part.column("row_key"), part.column("id"), pa.array(sizes, pa.int64()),
                    *(pa.array(x.view(np.int64)) for x in sums),
                    *(lists(np.ascontiguousarray(x.T[full]).view(np.int64).ravel(), ends, pa.int64()) for x in (keys[:half], keys[half:])),
                    pa.array([x.tobytes() for x in sketch], pa.binary())],
                    list(kinds))

    return docs.mapInArrow(make, T.StructType([T.StructField(*kind) for kind in kinds.items()]))


def _shared_keys(classes: DataFrame) -> DataFrame:
    """(class, sketch, first, second): of each class, the keys that another class holds as well;
    those of the first collection (u) with the number of blocks of their bucket.

    The holders are counted on narrow rows, so the wide rows that are made of ``first`` are
    shuffled once, to their bucket."""
    half_keys = classes.select("class", F.posexplode(F.concat("first", "second")).alias("at", "key"), F.size("first").alias("half"))
    shared = half_keys.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("blocks"),
                                          F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    is_first = F.col("at") < F.col("half")
    own = half_keys.join(shared, "key").groupBy("class").agg(
        F.collect_list(F.when(is_first, F.struct(F.col("key").alias("u"), "blocks"))).alias("first"),
        F.collect_list(F.when(~is_first, F.col("key"))).alias("second"))
    return (classes.select("class", "sketch").join(own, "class")
            .filter((F.size("first") > 0) & (F.size("second") > 0)))


def _forest(sketches: np.ndarray, agree: int) -> list[tuple[int, int]]:
    """Spanning forest of the members whose sketches agree: each member is compared with
    those not reached yet."""
    edges, open_ = [], np.arange(len(sketches))
    while len(open_) > 1:
        frontier, open_ = [int(open_[0])], open_[1:]
        while frontier and len(open_):
            x = frontier.pop()
            near = (sketches[open_] == sketches[x]).sum(axis=1) >= agree
            reached = open_[near].tolist()
            edges += [(x, y) for y in reached]
            frontier += reached
            open_ = open_[~near]
    return edges


def _in_block_pairs(rows: DataFrame) -> DataFrame:
    """Rows of a group of ``blocks`` blocks, once for each pair of blocks (i, j) that their
    class's block is part of: any two classes of the group meet in a pair."""
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(
        F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(others, lambda x: x != F.col("block"))),
        lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    return (rows.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
            .withColumn("pair", F.explode(pairs)).withColumns({"i": F.col("pair.i"), "j": F.col("pair.j")}))


def candidate_edges(classes: DataFrame, agree: int) -> DataFrame:
    """(a, b) spanning the members of each bucket whose sketches agree.

    A class is sent once per key of its first collection, with its second collection: the
    buckets (i, j) of one first key are made within the task."""
    tables = _shared_keys(classes).select("class", "sketch", F.inline("first"), "second")
    most = classes.agg(F.sum(F.size("first"))).first()[0] or 0
    n = max(shuffle_partitions(classes.sparkSession) * 4, -(-most // PART_ROWS))
    met = (_in_block_pairs(tables).withColumn("bucket", F.xxhash64("u", "i", "j"))
           .select("bucket", "class", "sketch", "second", F.pmod(F.col("bucket"), F.lit(n)).cast("int").alias("part")))

    def join(table: pa.Table) -> pa.Table:
        second = table["second"].combine_chunks()
        row = np.repeat(np.arange(len(second)), second.value_lengths().to_numpy())
        first = mix(table["bucket"].to_numpy().view(U)[row])
        bucket = mix(first + second.flatten().to_numpy().view(U))
        names = table["class"].to_numpy()[row]
        order = np.lexsort((names, bucket))
        bucket, names, row = bucket[order], names[order], row[order]
        data, _ = flat(table["sketch"])
        sketch = data.reshape(len(second), -1)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        sizes = np.diff(cuts)
        pairs = cuts[:-1][sizes == 2]
        pairs = pairs[(sketch[row[pairs]] == sketch[row[pairs + 1]]).sum(axis=1) >= agree]
        a, b = [names[pairs]], [names[pairs + 1]]
        for i in np.flatnonzero(sizes > 2):
            own = slice(cuts[i], cuts[i + 1])
            if edges := _forest(sketch[row[own]], agree):
                x = np.array(edges)
                a.append(names[own][x[:, 0]])
                b.append(names[own][x[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        low, high = np.minimum(a, b), np.maximum(a, b)
        if len(low):
            low, high = np.unique(np.stack([low, high]), axis=1)
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    return met.groupBy("part").applyInArrow(join, "a long, b long").distinct()


def links_of(names: np.ndarray, sets: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[list, list, list]:
    """Links that span the components of the sets, by counting common shingles.

    A set inside the largest component is put off, so copies of one text cost one comparison
    each; those outside it in the end, as another one became larger, are compared then.  So
    of two sets that are not in one component at least one was compared with all."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(sets, kind="stable")
    ordered = sets[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(first, len(ordered)))
    which = np.empty(len(sets), np.int64)
    which[order] = np.repeat(np.arange(len(first)), counts)
    holders = owner[order]
    spread = np.bincount(owner, weights=counts[which], minlength=len(sizes))
    root = np.arange(len(sizes))
    members = np.ones(len(sizes), np.int64)
    a, b, shared = [], [], []
    big = -1
    open_ = np.argsort(-spread / np.maximum(sizes, 1), kind="stable").tolist()
    while open_:
        put_off = []
        for i in open_:
            if big >= 0 and root[i] == root[big]:
                put_off.append(i)
                continue
            own = which[offsets[i]:offsets[i + 1]]
            own = own[counts[own] > 1]
            if not len(own):
                continue
            length = counts[own]
            at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            common = np.bincount(holders[at], minlength=len(sizes))
            linked = np.flatnonzero(100 * common >= percent * (sizes[i] + sizes - common))
            for j in linked.tolist():
                if root[j] != root[i]:
                    a.append(names[i])
                    b.append(names[j])
                    shared.append(int(common[j]))
                    keep, gone = root[i], root[j]
                    if members[keep] < members[gone]:
                        keep, gone = gone, keep
                    root[root == gone] = keep
                    members[keep] += members[gone]
            if big < 0 or members[root[i]] > members[root[big]]:
                big = i
        open_ = [i for i in put_off if root[i] != root[big]]
    return a, b, shared


def verified_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, common): links that span the components of each cluster's classes.

    ``sets`` is (class, cluster, blocks, shingles), blocks being the number of the cluster's blocks."""
    tasks = _in_block_pairs(sets).select("cluster", "i", "j", "class", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        data, offsets = flat(table["shingles"])
        a, b, common = links_of(table["class"].to_numpy(), np.frombuffer(data.tobytes(), U), offsets // 8, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "common": pa.array(common, pa.int64())})

    return tasks.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long, common long")


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text: 128 bits, as two hashes of both in hex digits."""
    parts_ = [F.col(id_col), F.col(text_col).cast("string")]
    hashes = F.xxhash64(*parts_), F.xxhash64(F.lit(1), *reversed(parts_))
    return F.concat(*(F.lpad(F.hex(h), 16, "0") for h in hashes))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75,
                    half: int = 20, rows: int = 3, agree: int | None = None) -> DataFrame:
    """(row_key, id, n_shingles, n_same, component_id, keeper, kept): n_same counts rows of equal
    id and text, which share their row_key (a hash of both) and are one row here; keeper is
    the row_key of the one row that stands for its group."""
    if agree is None:
        agree = int(0.55 * 2 * half * rows)
    text = F.col(text_col).cast("string")
    docs = df.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("id"), text.cast("binary").alias("text"))
    made = signatures(docs, shingle, half, rows)
    # small rows only; the texts are read again for the classes that must be verified
    signed = checkpointed(made)
    # rows of equal sets are a class: equal sizes and two 64-bit sums.  Its number is unique
    same = ("n", "sum_a", "sum_b")
    classes = checkpointed(signed.filter("n > 0").groupBy(*same).agg(
        F.min("row_key").alias("row_key"), F.first("first").alias("first"), F.first("second").alias("second"),
        F.first("sketch").alias("sketch")).withColumn("class", F.monotonically_increasing_id()))
    clusters = checkpointed(connected_components(candidate_edges(classes, agree)).select(
        F.col("node").alias("class"), F.col("component").alias("cluster")))

    wanted = classes.select("class", "row_key", "n").join(clusters, "class")
    blocks = wanted.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    # the sets are shuffled once, to the blocks that compare them
    chosen = docs.select("row_key", "text").join(wanted.join(blocks, "cluster").drop("n"), "row_key")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", 1 << 19):
                sets, offsets = shingle_sets(part.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in ("class", "cluster", "blocks")),
                    pa.array([sets[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())],
                    ["class", "cluster", "blocks", "shingles"])

    # equal rows have one row_key: their class appears once per row, which adds no link
    sets = chosen.select("class", "cluster", "blocks", "text").mapInArrow(
        sets_of, "class long, cluster long, blocks int, shingles binary")
    links = checkpointed(verified_links(sets, percent))
    groups = connected_components(links.select("a", "b")).select(F.col("node").alias("class"), "component")

    rows_ = signed.groupBy("row_key", "id", *same).agg(F.count(F.lit(1)).alias("n_same"))
    rows_ = rows_.join(classes.select(*same, "class"), [*same], "left").withColumnRenamed("n", "n_shingles").drop("sum_a", "sum_b").join(
        groups, "class", "left")
    empty = F.col("n_shingles") == 0
    # an empty set is a group of its own row
    rows_ = rows_.withColumn("group", F.when(empty, F.struct(F.lit(0).alias("kind"), F.col("row_key").alias("key"))).otherwise(
        F.struct(F.lit(1).alias("kind"), F.coalesce("component", "class").cast("string").alias("key"))))
    least = rows_.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("least")).select(
        "group", F.col("least.id").alias("component_id"), F.col("least.row_key").alias("keeper"))
    return rows_.join(least, "group").select(
        "row_key", F.col("id").alias(id_col), "n_shingles", "n_same", "component_id", "keeper",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
