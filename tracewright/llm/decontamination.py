"""Operator 2: find benchmark passages in training documents by winnowing.

Both sides keep the smallest hash of every ``window - gram + 1`` consecutive word
``gram``-grams, so two texts that share ``window`` words share a kept hash.  The kept
hashes of the documents are reduced to those that any item keeps; each carries the hashes of the
document's windows it was kept for, and those are joined with the distinct windows of the items.
So a gram that many documents and many items hold makes no pairs of them, only a whole shared
window does.  Windows that the same items hold stand for each other when the items of a
document are listed.  Hits are extended over the whole texts.  An item of fewer words than a
window is one window of its own length, and is joined on the hash of all its words.

Before the join, documents drop hashes whose slot no item uses, by a bit table of fixed
size (2**20 bits, whatever the size of the benchmark); it only saves rows.

Null or empty text: no words, no hits.  Items without words occur nowhere.  Items of
one id count once; an item without id has the empty string for id.  Equal rows get
equal results.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import ALNUM, LOWER, U, covered, flat, lists, mix, parts, run_hashes, runs, spans_of, window_hashes, \
    window_starts
from .exchange import checkpointed
from .near_dedup import row_key

SLOTS = 1 << 20
_KEY = 0x9E3779B97F4A7C15


def _words(column):
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = runs(data, offsets, ALNUM)
    return data, starts, ends, first


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def _windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words; equal windows of different lengths do not meet."""
    return mix(window_hashes(words, n) + U(n * _KEY % (1 << 64)))


def _short_keys(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(window_starts(first, n, len(words)))
    return _windows(words, n)[at], at


def _kept(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes and the word each window starts at."""
    grams = window_hashes(words, gram)
    span = window - gram + 1
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    least = grams[:n].copy()
    for i in range(1, span):
        np.minimum(least, grams[i:i + n], out=least)
    at = np.flatnonzero(window_starts(first, window, len(words)))
    return least[at], at


ITEM = T.StructType([
    T.StructField("item", T.StringType()), T.StructField("n", T.IntegerType()),
    T.StructField("windows", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType()))])


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """One row per item with words: words of its windows, hashes of its windows, join keys."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data, starts, ends, first = _words(batch.column("text").slice(i, 1))
                words = run_hashes(data, starts, ends)
                if not len(words):
                    continue
                n = min(len(words), window)
                keys = _kept(words, first, window, gram)[0] if n == window else _short_keys(words, first, n)[0]
                rows.append({"item": batch.column("item")[i].as_py(), "n": n,
                             "windows": _signed(np.unique(_windows(words, n))).tolist(),
                             "keys": _signed(np.unique(keys)).tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("item", pa.string()), ("n", pa.int32()), ("windows", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))]))

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                         F.col(text_col).cast("string").cast("binary").alias("text"))
    return named.mapInArrow(make, ITEM)


def item_sets(windows: DataFrame) -> DataFrame:
    """(w, n, like): like is one of the windows that the same items hold.  Sets of items are told
    apart by their size and 128 bits."""
    sets = windows.groupBy("w", "n").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("item")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("y"))
    likes = sets.groupBy("size", "x", "y").agg(F.min("w").alias("like"))
    return sets.join(likes, ["size", "x", "y"]).select("w", "n", "like")


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5,
                  with_text: bool = False) -> DataFrame:
    """(id, n_words, n_hit, items, starts, ends[, text]): ids of the items that occur, sorted
    as strings, and the hit word intervals [start, end)."""
    found = checkpointed(item_windows(items, item_id, item_text, window, gram))
    # lengths below the window and used slots: bounded by the window and by SLOTS
    short = sorted(r.n for r in found.filter(F.col("n") < window).select("n").distinct().collect())
    used = np.zeros(SLOTS, bool)
    slots = found.select(F.explode("keys").alias("key")).select(F.col("key").bitwiseAND(SLOTS - 1).cast("int").alias("slot"))
    used[slots.distinct().toArrow()["slot"].to_numpy()] = True

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                data, starts, ends, first = _words(part.column("text"))
                words = run_hashes(data, starts, ends)
                made = [_kept(words, first, window, gram), *(_short_keys(words, first, n) for n in short)]
                named = [_windows(words, n)[at] for n, (_, at) in zip((window, *short), made)]
                keys, at, named = (np.concatenate(x) for x in (*zip(*made), named))
                hit = used[(keys & U(SLOTS - 1)).astype(np.int64)]
                keys, named, doc = keys[hit], named[hit], np.searchsorted(first, at[hit], "right") - 1
                order = np.lexsort((named, keys, doc))
                keys, named, doc = keys[order], named[order], doc[order]
                other = np.ones(len(keys), bool)
                other[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                new = other.copy()
                new[1:] |= named[1:] != named[:-1]
                starts_at = np.append(np.flatnonzero(other[new]), np.count_nonzero(new))
                if len(keys):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row_key").take(pa.array(doc[other])), pa.array(_signed(keys[other]), pa.int64()),
                         lists(_signed(named[new]), starts_at, pa.int64())], ["row_key", "key", "windows"])

    text = F.col(text_col).cast("string")
    docs = df.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("id"),
                     text.cast("binary").alias("text"))
    keyed = docs.select("row_key", "text").mapInArrow(candidates, "row_key string, key long, windows array<long>")
    fingerprints = found.select(F.explode("keys").alias("key")).distinct()
    windows = found.select("item", "n", F.explode("windows").alias("w")).distinct()
    near = keyed.join(fingerprints, "key", "left_semi").select("row_key", F.explode("windows").alias("w"))
    # windows of documents that are windows of items: hits, each once for each distinct row
    spots = checkpointed(near.join(item_sets(windows), "w").distinct())
    names = (spots.select("row_key", F.col("like").alias("w")).distinct().join(windows.select("w", "item"), "w")
             .groupBy("row_key").agg(F.collect_set("item").alias("items")))
    hits = spots.groupBy("row_key").agg(F.collect_list(F.struct("n", "w")).alias("spots")).join(names, "row_key")

    out = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
        *[T.StructField(text_col, T.BinaryType())] * with_text])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                data, starts, ends, first = _words(part.column("text"))
                n_hit, names, begins, stops = [], [], [], []
                for i, (spots, items) in enumerate(zip(part.column("spots").to_pylist(), part.column("items").to_pylist())):
                    mask = np.zeros(int(first[i + 1] - first[i]), bool)
                    if spots:
                        words = run_hashes(data, starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])
                        lengths = np.array([x["n"] for x in spots])
                        of = np.array([x["w"] for x in spots], np.int64)
                        for n in np.unique(lengths).tolist():
                            at = np.flatnonzero(np.isin(_signed(_windows(words, n)), of[lengths == n]))
                            mask |= covered(at, n, len(mask))
                    low, high = spans_of(mask)
                    n_hit.append(int(mask.sum()))
                    names.append(sorted(items or [], key=lambda x: x.encode()))
                    begins.append(low)
                    stops.append(high)
                ends_of = np.concatenate(([0], np.cumsum([len(x) for x in begins])))
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array(names, pa.list_(pa.string())), lists(np.concatenate(begins), ends_of, pa.int32()),
                    lists(np.concatenate(stops), ends_of, pa.int32()), *[part.column("text")] * with_text],
                    names=[f.name for f in out.fields])

    found = docs.join(hits, "row_key", "left").select("id", "text", "spots", "items").mapInArrow(extend, out)
    return found.withColumn(text_col, F.col(text_col).cast("string")) if with_text else found
