"""Operator 13: a quality classifier, as a factorisation machine.

Features of a text are its words (hashed into ``1 << BITS`` buckets, damped counts, length 1
as a vector), statistics of its structure (shares of letters, digits, capitals, symbols,
repeated words, lines, ...), each as one of ``BINS`` bins, and numeric metadata columns,
each as the bin of its logarithm.  The score is the logistic function of

    bias + sum of w[i] x[i] + sum over pairs of <v[i], v[j]> x[i] x[j]

where the pairs cost no more than the features, as twice their sum is, for each of the
``factors``, the square of sum(v x) less sum((v x) squared).

The machine learns from at most ``sample_rows`` labelled rows with at most ``sample_bytes`` bytes
of text, taken in the order of a hash of id and text (at least the rows of the first of 4096
ranges of hashes); all else covers all rows.  The sample's ids are the only
thing that is broadcast besides the model; one task fits it, always in the same order.

Null texts count as empty ones, which have a score as well.  Null metadata is a bin of its
own, as are values below 0 and non-finite ones.  Several labels of one id count as the
majority (ties as 1); null labels and labels of null ids teach nothing.  Without any labelled row
every score is 0.5.  Equal rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, NOT_SPACE, U, flat, lists, parts, run_hashes, runs

BITS, BINS = 15, 20
_WORDS = 1 << BITS
#: bytes of text measured at once; longer texts are cut between words
_PIECE = 1 << 20

_kinds = np.zeros(256, np.uint8)  # of bytes: 1 letter, 2 capital, 3 digit, 4 sentence mark, 5 other symbol, 6 line end
_kinds[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_kinds[0x41:0x5B] = 2
_kinds[0x30:0x3A] = 3
_kinds[[ord(c) for c in ".,;:?'\"()-"]] = 4
_kinds[[x for x in range(0x21, 0x7F) if not _kinds[x]]] = 5
_kinds[0x0A] = 6
#: what is counted for each text
COUNTED = ("letters", "capitals", "digits", "marks", "symbols", "lines", "bytes", "words", "repeated", "marked", "odd")
#: what the counts become
STATISTICS = ("length", "words", "word_length", "capitals", "digits", "marks", "symbols", "repeated", "marked", "odd", "distinct",
              "words_a_line")


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(texts from, to, bytes from, to): whole texts, or parts of one text cut between words."""
    i = 0
    while i < len(offsets) - 1:
        j = max(int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1, i + 1)
        low, end = int(offsets[i]), int(offsets[j])
        while end - low > _PIECE:
            space = np.flatnonzero(~NOT_SPACE[data[low:low + _PIECE]])
            if len(space):
                cut = low + int(space[-1]) + 1
            else:  # a word longer than a piece
                space = np.flatnonzero(~NOT_SPACE[data[low + _PIECE:end]])
                cut = low + _PIECE + int(space[0]) + 1 if len(space) else end
            yield i, j, low, cut
            low = cut
        if low < end or low == offsets[i]:
            yield i, j, low, end
        i = j


def measure(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the words of all texts, each pair once, and what is counted of each text."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    counted = np.zeros((n, len(COUNTED)), np.int64)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    last, last_text = U(0), -1
    for i, j, low, high in _pieces(data, offsets):
        piece = data[low:high]
        own = np.clip(offsets[i:j + 1], low, high) - low
        kinds = _kinds[piece]
        for kind in range(1, 7):
            seen = np.concatenate(([0], np.cumsum(kinds == kind)))[own]
            counted[i:j, kind - 1] += np.diff(seen)
        counted[i:j, 6] += np.diff(own)
        starts, ends, first = runs(piece, own, NOT_SPACE)
        if not len(starts):
            continue
        hashes = run_hashes(LOWER[piece], starts, ends)
        text = np.repeat(np.arange(i, j), np.diff(first))
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        again[0] = hashes[0] == last and text[0] == last_text
        last, last_text = hashes[-1], int(text[-1])
        ending = kinds[ends - 1]
        for at, what in ((7, np.ones(len(text), bool)), (8, again), (9, ending == 4), (10, ending == 5)):
            counted[:, at] += np.bincount(text[what], minlength=n)
        key, count = np.unique((text << BITS) | (hashes >> U(64 - BITS)).astype(np.int64), return_counts=True)
        keys.append(key)
        counts.append(count)
    if len(keys) > 2:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
    else:
        key, count = keys[-1], counts[-1]
    return key >> BITS, key & (_WORDS - 1), count, counted


def statistics(counted: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Bin of each of ``STATISTICS`` for each text."""
    c = dict(zip(COUNTED, counted.T.astype(float)))
    letters = np.maximum(c["letters"] + c["capitals"], 1)
    words, size = np.maximum(c["words"], 1), np.maximum(c["bytes"], 1)

    def share(x, of):
        return np.sqrt(np.minimum(x / of, 1)) * (BINS - 1)

    def log(x, step):
        return np.log2(1 + x) * step

    bins = (log(c["bytes"], 1), log(c["words"], 1), log((letters + c["digits"]) / words, 3), share(c["capitals"], letters),
            share(c["digits"], size), share(c["marks"], words), share(c["symbols"], size), share(c["repeated"], words),
            share(c["marked"], words), share(c["odd"], words), share(distinct, words), log(words / (c["lines"] + 1), 2))
    return np.stack([np.minimum(np.ceil(b), BINS - 1) for b in bins], axis=1).astype(np.int64).reshape(-1, len(STATISTICS))


def metadata_bins(values: np.ndarray) -> np.ndarray:
    """1 + the logarithm of each value; 0 for a missing, negative or non-finite one."""
    fine = np.isfinite(values) & (values >= 0)
    return np.where(fine, 1 + np.minimum(np.floor(np.log2(1 + np.where(fine, values, 0))), BINS - 2), 0).astype(np.int64)


def features(column, metadata: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, offsets): the features of each text."""
    text, bucket, count, counted = measure(column)
    n = len(counted)
    words = np.bincount(text, minlength=n)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(text, weights=value * value, minlength=n))
    bins = np.hstack([statistics(counted, words), *(metadata_bins(m)[:, None] for m in metadata)])
    extra = bins.shape[1]
    row = np.concatenate((text, np.repeat(np.arange(n), extra)))
    index = np.concatenate((bucket, (_WORDS + np.arange(extra) * BINS + bins).reshape(-1)))
    value = np.concatenate((value / norm[text], np.full(n * extra, 0.5)))
    order = np.argsort(row, kind="stable")
    return index[order].astype(np.int32), value[order].astype(np.float32), np.concatenate(([0], np.cumsum(words + extra)))


class Machine:
    """bias, weights, and a row of factors for each feature."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray, metadata: tuple[str, ...] = ()):
        self.bias, self.weights, self.factors, self.metadata = bias, weights, factors, metadata

    def forward(self, index: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic function, and sum(v x) of each text; every text has features."""
        linear = np.add.reduceat(self.weights[index] * value, offsets[:-1], dtype=np.float64)
        vx = self.factors[index] * value[:, None]
        total = np.add.reduceat(vx, offsets[:-1], axis=0, dtype=np.float64)
        squares = np.add.reduceat((vx * vx).sum(axis=1), offsets[:-1], dtype=np.float64)
        return self.bias + linear + ((total ** 2).sum(axis=1) - squares) / 2, total

    def scores(self, index: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.forward(index, value, offsets)[0], -40, 40)))


def fit(index: np.ndarray, value: np.ndarray, offsets: np.ndarray, label: np.ndarray, size: int, factors: int = 8, epochs: int = 15,
        least_steps: int = 600, step: float = 0.02, decay: float = 1e-4, seed: int = 3, batch: int = 128) -> Machine:
    """Logistic loss, by small batches with adaptive steps: ``epochs`` times over the rows, more often if these
    are few.  Features that no row has keep no weight."""
    rng = np.random.default_rng(seed)
    rate = np.clip(label.mean(), 0.01, 0.99)
    machine = Machine(float(np.log(rate / (1 - rate))), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, factors)).astype(np.float32))
    speed_w, speed_v, speed_b = np.full(size, 1e-8, np.float32), np.full((size, factors), 1e-8, np.float32), 1e-8
    lengths = np.diff(offsets)
    for _ in range(max(epochs, -(-least_steps // -(-len(label) // batch)))):
        order = rng.permutation(len(label))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            cuts = np.concatenate(([0], np.cumsum(lengths[rows])))
            at = np.arange(cuts[-1]) + np.repeat(offsets[rows] - cuts[:-1], lengths[rows])
            own, x = index[at], value[at]
            raw, total = machine.forward(own, x, cuts)
            error = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - label[rows]
            g = np.repeat(error / len(rows), lengths[rows]).astype(np.float32) * x
            slope = g[:, None] * (np.repeat(total, lengths[rows], axis=0).astype(np.float32) - machine.factors[own] * x[:, None])
            names, where = np.unique(own, return_inverse=True)
            dw = np.bincount(where, weights=g, minlength=len(names)).astype(np.float32) + decay * machine.weights[names]
            dv = np.stack([np.bincount(where, weights=slope[:, k], minlength=len(names)) for k in range(factors)], axis=1).astype(
                np.float32) + decay * machine.factors[names]
            speed_w[names] += dw * dw
            speed_v[names] += dv * dv
            machine.weights[names] -= step * 5 * dw / np.sqrt(speed_w[names])
            machine.factors[names] -= step * dv / np.sqrt(speed_v[names])
            db = float(error.mean())
            speed_b += db * db
            machine.bias -= step * db / np.sqrt(speed_b)
    seen = np.zeros(size, bool)
    seen[index] = True
    machine.factors[~seen] = 0
    return machine


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels teach nothing: crc32 of the id as text is a multiple of 5 (null as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _measured(batch: pa.RecordBatch, metadata: int):
    """(part of the batch, its features): parts of about a piece of text each."""
    for part in parts(batch, "text", _PIECE):
        columns = [part.column(f"m{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(metadata)]
        yield part, features(part.column("text"), columns)


def _inputs(df: DataFrame, text_col: str, metadata: Sequence[str]) -> list[Column]:
    return [df[text_col].cast("string").cast("binary").alias("text"),
            *(F.coalesce(df[m].cast("double"), F.lit(float("nan"))).alias(f"m{i}") for i, m in enumerate(metadata))]


def train(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          teach: Column | None = None, metadata: tuple[str, ...] = ("n_chars",), sample_rows: int = 20_000,
          sample_bytes: int = 64 << 20, **how) -> Machine | None:
    """The machine that the labels of the rows chosen by ``teach`` (a condition on ``id_col`` of ``labels``) give."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.lit(True) if teach is None else teach))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))
    order = F.xxhash64(df[id_col], df[text_col])
    slim = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), order.alias("order"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("size"))
    found = slim.join(known, "id")
    ranges = found.groupBy(F.shiftright("order", 52).alias("range")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).orderBy("range").collect()
    if not ranges:
        return None
    rows, size = np.cumsum([r.n for r in ranges]), np.cumsum([r["size"] for r in ranges])
    last = ranges[max(int(((rows <= sample_rows) & (size <= sample_bytes)).sum()) - 1, 0)].range
    # at most ``sample_rows`` small rows
    chosen = found.filter(F.shiftright("order", 52) <= last).select("id", "order", "label").distinct()
    sample = df.select(F.col(id_col).alias("id"), order.alias("order"), *_inputs(df, text_col, metadata)).filter(
        F.shiftright("order", 52) <= last).join(F.broadcast(chosen), ["id", "order"]).drop("id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, (index, value, offsets) in _measured(batch, len(metadata)):
                yield pa.RecordBatch.from_arrays(
                    [part.column("order"), part.column("label"), lists(index, offsets, pa.int32()), lists(value, offsets, pa.float32())],
                    ["order", "label", "index", "value"])

    total = _WORDS + BINS * (len(STATISTICS) + len(metadata))

    def learn(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("order", "ascending"), ("label", "ascending")])
        index, value = table["index"].combine_chunks(), table["value"].combine_chunks()
        offsets = np.concatenate(([0], np.cumsum(index.value_lengths().to_numpy())))
        machine = fit(index.flatten().to_numpy(), value.flatten().to_numpy(), offsets, table["label"].to_numpy(), total, **how)
        return pa.table({"bias": [machine.bias], "weights": [machine.weights.tobytes()], "factors": [machine.factors.tobytes()]})

    rows = sample.mapInArrow(measured, "order long, label int, index array<int>, value array<float>").withColumn("one", F.lit(1)).groupBy("one").applyInArrow(
        learn, "bias double, weights binary, factors binary").collect()
    weights = np.frombuffer(rows[0].weights, np.float32)
    return Machine(rows[0].bias, weights, np.frombuffer(rows[0].factors, np.float32).reshape(len(weights), -1), tuple(metadata))


def score(df: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the chance that the label is 1."""
    metadata = machine.metadata if machine else ()
    shared = df.sparkSession.sparkContext.broadcast(machine)
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(batch.num_rows, 0.5))], [id_col, "score"])
                continue
            for part, found in _measured(batch, len(metadata)):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(shared.value.scores(*found))], [id_col, "score"])

    return df.select(df[id_col].alias("id"), *_inputs(df, text_col, metadata)).mapInArrow(scored, out)
