"""Operator 6: drop lines that many documents share.

A line's key is the line without white space at its ends, A-Z lower-cased.  Chunks of
documents send each distinct key's 64-bit hash and the number of their documents that
hold it, one blob per hash range (``exchange``).  Each range is a shard: it builds a
minimal perfect hash over its distinct hashes, which indexes an array of fingerprints
and an array of counts.  Documents do not join lines: a chunk's blob probes the
arrays of its shard and gets one bit per key back.

Null or empty text: one empty line.  Keys shorter than ``min_chars`` code points (1 at
least) never go.  Equal rows are documents of their own.  If all lines go, the text is
empty.  Ids may be null or equal; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .arrays import LOWER, NOT_SPACE, U, blob_sizes, flat, lists, mix, pack, run_hashes

BYTES_PER_LINE = 20  # for the number of shards only
_GAMMA = 2           # bits per key of a level
_BLOCK = 512         # bits between two entries of the rank directory


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit values: levels of bit arrays, in which a
    value sits on the first level where nothing else falls on its bit; the number of set
    bits before it is its index."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        padded = np.concatenate([bits, np.zeros(-len(bits) % (_BLOCK // 8), np.uint8)])
        per_block = np.bitwise_count(padded.reshape(-1, _BLOCK // 8)).sum(axis=1, dtype=np.int64)
        self.ranks = np.concatenate(([0], np.cumsum(per_block)))
        self.padded = padded.reshape(-1, _BLOCK // 8)

    @staticmethod
    def _place(values: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(values + U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, values: np.ndarray) -> PerfectHash:
        sizes, parts, level = [], [], 0
        while len(values):
            size = -(-_GAMMA * len(values) // 64) * 64
            place = cls._place(values, level, size)
            alone = np.bincount(place, minlength=size) == 1
            parts.append(np.packbits(alone))
            sizes.append(size)
            values = values[~alone[place]]
            level += 1
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint8))

    def index(self, values: np.ndarray) -> np.ndarray:
        """Index of each value; any index or -1 for values that were not built in."""
        out = np.full(len(values), -1, np.int64)
        open_ = np.arange(len(values))
        for level, size in enumerate(self.sizes.tolist()):
            at = self._place(values[open_], level, size) + self.offsets[level]
            hit = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            out[open_[hit]] = self._rank(at[hit])
            open_ = open_[~hit]
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 16):
            a = at[i:i + (1 << 16)]
            block, inside = a // _BLOCK, a % _BLOCK
            ones = np.bitwise_count(self.padded[block])
            whole = np.arange(_BLOCK // 8) < (inside >> 3)[:, None]
            last = self.padded[block, inside >> 3] >> (8 - (inside & 7)).astype(np.uint8)
            out[i:i + len(a)] = (self.ranks[block] + (ones * whole).sum(axis=1, dtype=np.int64)
                                 + np.where(inside & 7, np.bitwise_count(last), 0))
        return out


INDEX = T.StructType([
    T.StructField("range", T.IntegerType()), T.StructField("sizes", T.BinaryType()), T.StructField("bits", T.BinaryType()),
    T.StructField("fingerprints", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    T.StructField("count_bytes", T.IntegerType())])
PROBES = T.StructType([*X.BLOBS.fields, T.StructField("documents", T.BinaryType())])


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(~hashes) >> U(48)).astype(np.uint16)


def _keys(column, min_chars: int):
    """Of a chunk's lines: key hash, whether there is a key, and first line of each text."""
    data, offsets = flat(column)
    data = LOWER[data]
    breaks = np.flatnonzero(data == 0x0A)
    edges = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # a text that ends in a line break has an empty line after it, which starts where
    # the next text does: count lines by text instead of by position
    n_breaks = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
    first = np.concatenate(([0], np.cumsum(n_breaks + 1)))
    stops = np.empty(len(edges), np.int64)
    stops[:-1] = edges[1:]
    solid = np.flatnonzero(NOT_SPACE[data])
    if len(edges):
        stops[-1] = len(data)
    low, high = np.searchsorted(solid, edges), np.searchsorted(solid, stops)
    some = high > low
    starts, ends = solid[low[some]], solid[high[some] - 1] + 1
    hashes = np.zeros(len(edges), U)
    hashes[some] = run_hashes(data, starts, ends)
    if min_chars > 1:
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        some[some] = chars[ends] - chars[starts] >= min_chars
    return hashes, some, first


def line_index(probes: DataFrame) -> DataFrame:
    """One row per shard: its perfect hash, fingerprints and document counts."""
    def build(table: pa.Table) -> pa.Table:
        hashes, _ = blob_sizes(table["hashes"])
        data, _ = flat(table["documents"])
        distinct, which = np.unique(hashes, return_inverse=True)
        counts = np.zeros(len(distinct), np.uint64)
        np.add.at(counts, which, np.frombuffer(data.tobytes(), np.uint32).astype(np.uint64))
        function = PerfectHash.build(distinct)
        at = function.index(distinct)
        fingerprints, compact = np.empty(len(distinct), np.uint16), np.empty(len(distinct), np.uint64)
        fingerprints[at], compact[at] = _fingerprints(distinct), counts
        compact = compact.astype(np.min_scalar_type(int(counts.max())))
        return pa.table({
            "range": table["range"][:1], "sizes": pa.array([function.sizes.tobytes()], pa.binary()),
            "bits": pa.array([function.bits.tobytes()], pa.binary()),
            "fingerprints": pa.array([fingerprints.tobytes()], pa.binary()),
            "counts": pa.array([compact.tobytes()], pa.binary()),
            "count_bytes": pa.array([compact.dtype.itemsize], pa.int32())})

    return probes.groupBy("range").applyInArrow(build, INDEX)


def probe(probes: DataFrame, index: DataFrame, min_docs: int) -> DataFrame:
    """For each blob, one bit per hash: whether min_docs documents or more hold it."""
    def look(table: pa.Table, shard: pa.Table) -> pa.Table:
        row = shard.to_pylist()[0]
        function = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint8))
        counts = np.frombuffer(row["counts"], f"u{row['count_bytes']}")
        hashes, sizes = blob_sizes(table["hashes"])
        at = function.index(hashes)
        known = np.frombuffer(row["fingerprints"], np.uint16)[at] == _fingerprints(hashes)
        bits = (at >= 0) & known & (counts[at] >= min_docs)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        return pa.table({"chunk": table["chunk"], "range": table["range"],
                         "answer": pa.array([pack(bits[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})

    return probes.groupBy("range").cogroup(index.groupBy("range")).applyInArrow(look, X.ANSWERS)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
               min_chars: int = 1) -> DataFrame:
    """(id, n_lines, n_dropped, dropped, kept): numbers of the dropped lines from 0, and the
    other lines joined by line breaks."""
    min_chars = max(min_chars, 1)
    total = X.text_bytes(df, text_col)
    chunks, _ = X.chunked(df, id_col, text_col, total)
    n_ranges = max(X.shuffle_partitions(df.sparkSession), -(-total // (BYTES_PER_LINE * X.RANGE_HASHES)))
    bounds = X.range_bounds(n_ranges)

    def send(table: pa.Table) -> pa.Table:
        hashes, some, first = _keys(table["text"], min_chars)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[some]
        hashes = hashes[some]
        order = np.lexsort((doc, hashes))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])  # a document counts once
        distinct, counts = np.unique(hashes[new], return_counts=True)
        blobs = X.blobs_table(table["chunk"][0].as_py(), distinct, bounds)
        counts, at, documents = counts.astype(np.uint32), 0, []
        for blob in blobs["hashes"].to_pylist():
            documents.append(counts[at:at + len(blob) // 8].tobytes())
            at += len(blob) // 8
        return blobs.append_column("documents", pa.array(documents, pa.binary()))

    probes = chunks.groupBy("chunk").applyInArrow(send, PROBES)
    answers = probe(probes, line_index(probes), min_docs)
    out = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()), T.StructField("dropped", T.ArrayType(T.IntegerType())),
        T.StructField("kept", T.BinaryType())])

    def mark(docs: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, some, first = _keys(docs["text"], min_chars)
        distinct, which = np.unique(hashes[some], return_inverse=True)
        gone = np.zeros(len(hashes), bool)
        gone[some] = X.answer_bits(X.read_answers(answers), distinct, bounds)[which]
        sums = np.concatenate(([0], np.cumsum(gone)))
        dropped = sums[first[1:]] - sums[first[:-1]]
        kept = []
        for i, text in enumerate(docs["text"].to_pylist()):
            text = text or b""
            if dropped[i]:
                text = b"\n".join(compress(text.split(b"\n"), (~gone[first[i]:first[i + 1]]).tolist()))
            kept.append(text)
        at = np.flatnonzero(gone)
        numbers = at - np.repeat(first[:-1], dropped)
        return pa.table({
            id_col: docs["id"], "n_lines": pa.array(np.diff(first), pa.int64()),
            "n_dropped": pa.array(dropped, pa.int64()),
            "dropped": lists(numbers, np.concatenate(([0], np.cumsum(dropped))), pa.int32()),
            "kept": pa.array(kept, pa.binary())})

    marked = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(mark, out)
    return marked.withColumn("kept", F.col("kept").cast("string"))
