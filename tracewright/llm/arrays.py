"""Array helpers used inside tasks: words of a batch of texts, and polynomial hashes.

Everything works on whole Arrow batches of UTF-8 bytes; no loop runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1          # odd, so it has an inverse modulo 2**64
_INV = pow(_B, -1, 1 << 64)
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
_SLICE = 1 << 18                     # hashed at once; bounds the temporaries of long texts

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of a word that only white space ends
NOT_SPACE = ~_space
#: digits, small letters, and every byte of a character outside ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1), base, U)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:n]


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and low bits of hashes behave as random."""
    x = values.copy()
    x ^= x >> U(30)
    x *= _MIX[0]
    x ^= x >> U(27)
    x *= _MIX[1]
    x ^= x >> U(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column; a null holds no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, ends, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0]:ends[-1]], ends - ends[0]


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes within each text: starts, ends, and first run of each text."""
    inside = member[data]
    if not inside.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[edges > 0] - 1
    last[edges] = inside[edges]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for ordered, disjoint runs."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + _SLICE, "right")), i + 1)
        low, high = int(starts[i]), int(ends[j - 1])
        n = high - low
        sums = np.zeros(n + 1, U)
        np.cumsum((data[low:high].astype(U) + U(1)) * powers(_B, n), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * powers(_INV, n + 1)[s]
        i = j
    return mix(out ^ (ends - starts).astype(U))


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive values (len(values) - k + 1 of them)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    for i in range(0, n, _SLICE):
        part = values[i:min(i + _SLICE, n) + k - 1]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * powers(_B, len(part)), out=sums[1:])
        m = len(part) - k + 1
        out[i:i + m] = (sums[k:] - sums[:m]) * powers(_INV, m)
    return mix(out)


def window_starts(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """True where a window of k items starts and stays within its text."""
    inside = np.zeros(max(total - k + 1, 0), bool)
    counts = np.diff(first)
    begin = first[:-1][counts >= k]
    if begin.size:
        edge = np.zeros(len(inside) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + counts[counts >= k] - k + 1, -1)
        inside = np.cumsum(edge[:-1]) > 0
    return inside


def covered(starts: np.ndarray, lengths: np.ndarray | int, total: int) -> np.ndarray:
    """True for items within any [start, start + length)."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def blob_sizes(column) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit values of a column of blobs, and how many each blob holds."""
    data, offsets = flat(column)
    return np.frombuffer(data.tobytes(), U), np.diff(offsets) // 8


def lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def parts(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Consecutive slices of a batch with about ``limit`` bytes of text each (one row at least)."""
    lengths = batch.column(column).cast(pa.large_binary())
    _, offsets = flat(lengths)
    i = 0
    while i < len(offsets) - 1:
        j = max(int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1, i + 1)
        yield batch.slice(i, j - i)
        i = j
