"""Operator 1: remove words covered by a repeated window of words.

Every window of ``window`` consecutive words gets a Rabin-Karp hash; Spark counts the
hashes over the corpus (``exchange``); repeated windows merge into maximal removal
intervals.  Windows are judged on the input and never cross documents.

A 64-bit hash stands for a window: for N windows the chance of any false repeat is
about N*N / 2**65 (1e-3 at 2e8 windows); no true repeat is ever missed.

Null text: no words.  Empty texts and texts shorter than a window lose nothing.  Equal
rows are documents of their own and repeat each other.  Ids may be null or equal; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .arrays import NOT_SPACE, covered, flat, lists, run_hashes, runs, spans_of, window_hashes, window_starts

BYTES_PER_WORD = 5  # for the number of ranges only


def _windows(column, window: int):
    """Window hashes of a chunk, their word positions, and the first word of each text."""
    data, offsets = flat(column)
    starts, ends, first = runs(data, offsets, NOT_SPACE)
    words = run_hashes(data, starts, ends)
    at = np.flatnonzero(window_starts(first, window, len(words)))
    return window_hashes(words, window)[at], at, first


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """(id, n_words, n_removed, starts, ends, kept): removed word intervals [start, end) in
    order, and the kept words joined by one space."""
    total = X.text_bytes(df, text_col)
    chunks, _ = X.chunked(df, id_col, text_col, total)
    n_ranges = max(X.shuffle_partitions(df.sparkSession), -(-total // (BYTES_PER_WORD * X.RANGE_HASHES)))
    bounds = X.range_bounds(n_ranges)
    blobs = X.send(chunks, lambda texts: np.unique(_windows(texts, window)[0]), n_ranges)
    answers = X.in_several_chunks(blobs)

    out = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("kept", T.BinaryType())])

    def mark(docs: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, at, first = _windows(docs["text"], window)
        distinct, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        repeated = (counts > 1) | X.answer_bits(X.read_answers(answers), distinct, bounds)
        gone = covered(at[repeated[which]], window, int(first[-1]))
        sums = np.concatenate(([0], np.cumsum(gone)))
        removed = sums[first[1:]] - sums[first[:-1]]
        kept, n_spans, begins, stops = [], [0], [], []
        for i, text in enumerate(docs["text"].to_pylist()):
            words = (text or b"").split()
            if removed[i]:
                mask = gone[first[i]:first[i + 1]]
                s, e = spans_of(mask)
                begins.append(s)
                stops.append(e)
                words = list(compress(words, (~mask).tolist()))
                n_spans.append(len(s))
            else:
                n_spans.append(0)
            kept.append(b" ".join(words))
        ends = np.cumsum(n_spans)
        none = np.zeros(0, np.int64)
        return pa.table({
            id_col: docs["id"], "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "starts": lists(np.concatenate([none, *begins]), ends, pa.int32()),
            "ends": lists(np.concatenate([none, *stops]), ends, pa.int32()), "kept": pa.array(kept, pa.binary())})

    marked = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(mark, out)
    return marked.withColumn("kept", F.col("kept").cast("string"))
