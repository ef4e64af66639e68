"""Operator 3: remove bytes covered by a repeated string, by enhanced suffix arrays.

A suffix array of a whole corpus would be one sort of every byte.  Here the suffixes that can
begin or hold a repeat are picked first, and their arrays are built group by group:

1. In every ``report`` bytes (``length`` at most) the smallest hash of a ``gram``-byte string
   is an anchor (of equal smallest ones, each).  Equal strings of so many bytes have the same
   anchors, so every repeat joins anchors of one gram.  An anchor's context is all that a
   repeat of ``length`` bytes through it can cover: up to ``length - gram`` bytes before it and
   ``length`` from it on.
2. Anchors are counted by (gram, context) over the corpus (``exchange``).  A gram that
   occurs once ends here.  Equal contexts are one suffix with a multiplicity: their whole
   context repeats.  Of grams with several contexts, one copy of each context is sent on.
3. The contexts of a gram are sorted by what follows the anchor: a suffix array with
   its longest common prefixes.  A stack scan gives the tree of common-prefix intervals.  An
   interval of depth d is a repeat wherever its suffixes also agree in length - d bytes before
   the anchor: its members are compared by their left extensions, and where these are not
   all one, each class of two or more is a repeat group of its own.  All members of a
   class are occurrences, so a repeat is found between any two, not only neighbours.
4. Documents merge the covered intervals.  Strings are judged on the input and never cross
   documents.  Repeats of ``length`` bytes are removed; ``n_repeated`` counts the bytes of all
   that have ``report`` bytes or more, and ``longest_repeat`` is the length of the longest
   repeat, ``length`` at most (0 below ``report``).

64-bit hashes stand for grams and contexts; bytes are compared only between different
contexts of a gram.  A task holds one chunk of documents, or the distinct contexts of one
range of grams.

Null or empty text: no bytes.  Texts shorter than ``length`` lose nothing.  Equal rows are
documents of their own and repeat each other.  Ids may be null or equal; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .arrays import _B, _INV, U, covered, flat, lists, mix, powers, spans_of

CHUNK_BYTES = 4 << 20
RANGE_BYTES = 8 << 20   # of text for each range of grams
PIECE_BYTES = 1 << 19    # of text hashed at once
_TOP = U(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """choose() over every ``width`` consecutive values."""
    out, have = values, 1
    while 2 * have <= width:
        out = choose(out[:-have], out[have:])
        have *= 2
    return choose(out[:len(out) - (width - have)], out[width - have:]) if width > have else out


def _pieces(offsets: np.ndarray, length: int, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Spans of bytes to hash at once: (from, to, edges, first window, last window) with edges
    of the texts within.  A long text is cut so that each window and its context are whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        low = int(offsets[i])
        j = max(int(np.searchsorted(offsets, low + PIECE_BYTES, "right")) - 1, i + 1)
        high = int(offsets[j])
        if j > i + 1 or high - low <= PIECE_BYTES:
            edges = offsets[i:j + 1]
            yield low, high, edges, edges[:-1], edges[1:] - window
        else:
            for a in range(low, high - window + 1, PIECE_BYTES):
                b = min(a + PIECE_BYTES, high - window + 1)
                begin, end = max(low, a - length), min(high, b + 2 * length)
                yield begin, end, np.array([begin, end]), np.array([a]), np.array([b - 1])
        i = j


class Anchors:
    """Anchors of a chunk: place, gram hash, context hash, and context [start, end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int, window: int | None = None):
        found = [np.zeros((5, 0), U)]
        window = length if window is None else window
        for piece in _pieces(offsets, length, window):
            found.append(self._of(data, *piece, length, gram, window))
        place, self.gram, self.context, start, end = np.concatenate(found, axis=1)
        # a long text's neighbouring pieces may both pick an anchor
        order = np.unique(place, return_index=True)[1] if len(place) else np.zeros(0, np.int64)
        self.place, self.start, self.end = (x[order].astype(np.int64) for x in (place, start, end))
        self.gram, self.context = self.gram[order], self.context[order]

    @staticmethod
    def _of(data, low, high, edges, first, last, length, gram, window) -> np.ndarray:
        size, edges = high - low, edges - low
        if size < window:
            return np.zeros((5, 0), U)
        sums = np.zeros(size + 1, U)
        np.cumsum((data[low:high].astype(U) + U(1)) * powers(_B, size), out=sums[1:])
        inverse = powers(_INV, size + 1)
        hashes = mix((sums[gram:] - sums[:-gram]) * inverse[:size - gram + 1])
        least = _sliding(hashes, window - gram + 1, np.minimum)  # by first byte of the window
        ok = np.zeros(len(least) + 1, np.int64)
        begin, stop = first - low, last - low + 1
        some = stop > begin
        np.add.at(ok, begin[some], 1)
        np.add.at(ok, stop[some], -1)
        least = np.where(np.cumsum(ok[:-1]) > 0, least, U(0))
        # windows [p - (window - gram), p] hold gram p
        pad = np.zeros(window - gram, U)
        most = _sliding(np.concatenate([pad, least, pad]), window - gram + 1, np.maximum)
        at = np.flatnonzero(most == hashes)
        text = np.searchsorted(edges, at, "right") - 1
        start = np.maximum(at - (length - gram), edges[text])
        end = np.minimum(at + length, edges[text + 1])
        context = mix((sums[end] - sums[start]) * inverse[start] ^ mix(((at - start) * 1_000_003 + (end - start)).astype(U)))
        # smallest hashes lie close together: mixed again, they spread over the ranges
        return np.stack([(at + low).astype(U), mix(hashes[at]), context, (start + low).astype(U), (end + low).astype(U)])


def _distinct(anchors: Anchors):
    """Distinct (gram, context) in order, where each first occurs, which each anchor is, counts."""
    order = np.lexsort((anchors.context, anchors.gram))
    gram, context = anchors.gram[order], anchors.context[order]
    new = np.ones(len(order), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    cuts = np.append(np.flatnonzero(new), len(order))
    return gram[new], context[new], order[new], which, np.diff(cuts)


def _cuts(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.searchsorted(grams, bounds), [len(grams)]))


# ---- the suffix arrays of a range ------------------------------------------------------------
class Texts:
    """Strings that start at one end of the anchor, sorted: their order, ranks and common
    prefixes, with the minimum of any stretch of these."""

    def __init__(self, group: np.ndarray, rows: np.ndarray, lengths: np.ndarray):
        n = len(group)
        key = np.concatenate([group.astype(">u8").view(np.uint8).reshape(n, 8), rows,
                              lengths.astype(">u2").view(np.uint8).reshape(n, 2)], axis=1)
        # a last 1 keeps the comparison from dropping zero bytes
        key = np.concatenate([key, np.ones((n, 1), np.uint8)], axis=1)
        self.order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        self.common = np.zeros(n, np.int32)  # with the string before
        for i in range(1, n, 4096):
            a, b = self.order[i:i + 4096], self.order[i - 1:i + 4095][:len(self.order[i:i + 4096])]
            differ = rows[a] != rows[b]
            depth = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
            depth = np.minimum(depth, np.minimum(lengths[a], lengths[b]))
            self.common[i:i + len(a)] = np.where(group[a] == group[b], depth, 0)
        self.tables = [self.common]
        while 2 << (len(self.tables) - 1) <= n:
            half = 1 << (len(self.tables) - 1)
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-half], last[half:]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Common prefix of the strings of ranks low < high."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int32)
        for k in np.unique(level):
            at = level == k
            table = self.tables[k]
            out[at] = np.minimum(table[low[at] + 1], table[high[at] - (1 << k) + 1])
        return out


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every common-prefix interval, children before parents;
    common[i] is the common prefix of suffixes i - 1 and i, for i from 1."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(common) + 1):
        depth, first = (common[i] if i < len(common) else -1), i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeats(group: np.ndarray, right: np.ndarray, right_length: np.ndarray, left: np.ndarray, left_length: np.ndarray,
            *least: int) -> tuple[np.ndarray, ...]:
    """Bytes before and after its anchor that each context's repeats with others cover, for
    repeats of each of the lengths ``least``; and the length of the longest.

    ``right`` are the bytes from the anchor on, ``left`` those before it, backwards."""
    n = len(group)
    longest, *cover = (np.zeros(n, np.int32) for _ in range(2 * len(least) + 1))
    if n < 2:
        return *cover, longest
    suffixes, prefixes = Texts(group, right, right_length), Texts(group, left, left_length)
    order, common = suffixes.order, suffixes.common
    cuts = np.append(np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1]))), n)
    sizes = np.diff(cuts)

    def extend(members: np.ndarray, depth: np.ndarray | int) -> None:
        """Members agree in ``depth`` bytes from the anchor; cover those that also agree
        with another member in the bytes before it that a repeat needs."""
        rank = prefixes.rank[members]
        by_left = np.argsort(rank)
        members, rank = members[by_left], rank[by_left]
        shared = prefixes.between(rank[:-1], rank[1:])
        widest = np.maximum(np.append(shared, -1), np.insert(shared, 0, -1))
        longest[members] = np.maximum(longest[members], widest + depth)
        for k, length in enumerate(least):
            hit = widest + depth >= length
            at = members[hit]
            cover[2 * k][at] = np.maximum(cover[2 * k][at], widest[hit])
            cover[2 * k + 1][at] = np.maximum(cover[2 * k + 1][at], depth)

    # groups of two at once: one interval each
    two = cuts[:-1][sizes == 2]
    a, b, depth = order[two], order[two + 1], common[two + 1]
    ranks = prefixes.rank[a], prefixes.rank[b]
    shared = prefixes.between(np.minimum(*ranks), np.maximum(*ranks)) if len(two) else np.zeros(0, np.int32)
    for x in (a, b):
        longest[x] = shared + depth
        for k, length in enumerate(least):
            hit = shared + depth >= length
            cover[2 * k][x[hit]], cover[2 * k + 1][x[hit]] = shared[hit], depth[hit]
    for k in np.flatnonzero(sizes > 2):
        first, last = int(cuts[k]), int(cuts[k + 1])
        own = common[first:last].tolist()
        own[0] = 0
        for depth, i, j in intervals(own):
            extend(order[first + i:first + j + 1], depth)
    return *cover, longest


# ---- the operator ----------------------------------------------------------------------------
SENT = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
                     *(T.StructField(x, T.BinaryType()) for x in ("grams", "contexts", "several"))])
TEXTS = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
                      *(T.StructField(x, T.BinaryType()) for x in ("grams", "which", "lefts", "sizes", "bytes"))])
FOUND = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("range", T.IntegerType()),
                      *(T.StructField(x, T.BinaryType()) for x in ("answer", "wanted", "which", "cover"))])


def _status(table: pa.Table) -> pa.Table:
    """For each chunk's (gram, context): whether the context repeats as a whole, and
    whether this chunk is the one to send its bytes."""
    grams, offsets = flat(table["grams"])
    cuts = offsets // 8
    grams = np.frombuffer(grams.tobytes(), U)
    contexts = np.frombuffer(flat(table["contexts"])[0].tobytes(), U)
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(
        table["several"].to_pylist(), np.diff(cuts))] or [np.zeros(0, np.uint8)])
    chunk = np.repeat(table["chunk"].to_numpy(), np.diff(cuts))
    order = np.lexsort((chunk, contexts, grams))
    g, x, s = grams[order], contexts[order], several[order].astype(np.int64) + 1
    new_gram, new_context = np.ones(len(g), bool), np.ones(len(g), bool)
    new_gram[1:] = g[1:] != g[:-1]
    new_context[1:] = new_gram[1:] | (x[1:] != x[:-1])
    of_gram, of_context = np.cumsum(new_gram) - 1, np.cumsum(new_context) - 1
    total = np.bincount(of_context, weights=s)[of_context]
    kinds = np.bincount(of_gram, weights=new_context)[of_gram]
    whole, send = np.zeros(len(g), bool), np.zeros(len(g), bool)
    whole[order] = total > 1
    send[order] = new_context & (kinds > 1)
    packed = [[np.packbits(bits[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])] for bits in (whole, send)]
    none = pa.array([None] * table.num_rows, pa.binary())
    return pa.table({"chunk": table["chunk"], "range": table["range"], "answer": pa.array(packed[0], pa.binary()),
                     "wanted": pa.array(packed[1], pa.binary()), "which": none, "cover": none})


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                 gram: int | None = None, report: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, starts, ends, kept, n_repeated, longest_repeat): maximal removed byte
    intervals [start, end), and the other bytes."""
    report = length if report is None else min(report, length)
    gram = max(1, length // 4 if report == length else report // 2) if gram is None else gram
    total = X.text_bytes(df, text_col)
    chunks, _ = X.chunked(df, id_col, text_col, total, CHUNK_BYTES)
    # the shorter the reported repeats, the more anchors a byte
    n_ranges = max(X.shuffle_partitions(df.sparkSession), -(-total * (length - gram + 1) // ((report - gram + 1) * RANGE_BYTES)))
    bounds = X.range_bounds(n_ranges)

    def send(table: pa.Table) -> pa.Table:
        grams, contexts, _, _, counts = _distinct(Anchors(*flat(table["text"]), length, gram, report))
        cuts = _cuts(grams, bounds)
        used = np.flatnonzero(np.diff(cuts))
        cut = lambda values: pa.array([values[cuts[i]:cuts[i + 1]].tobytes() for i in used], pa.binary())
        return pa.table({
            "range": pa.array(used, pa.int32()), "chunk": pa.array(np.full(len(used), table["chunk"][0].as_py()), pa.int32()),
            "grams": cut(grams), "contexts": cut(contexts),
            "several": pa.array([np.packbits(counts[cuts[i]:cuts[i + 1]] > 1).tobytes() for i in used], pa.binary())})

    status = chunks.groupBy("chunk").applyInArrow(send, SENT).groupBy("range").applyInArrow(_status, FOUND)

    def bits_of(answers: pa.Table, column: str, cuts: np.ndarray) -> np.ndarray:
        out = np.zeros(int(cuts[-1]), bool)
        for i, bits in zip(answers["range"].to_pylist(), answers[column].to_pylist()):
            n = int(cuts[i + 1] - cuts[i])
            out[cuts[i]:cuts[i + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        return out

    def texts(docs: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets = flat(docs["text"])
        anchors = Anchors(data, offsets, length, gram, report)
        grams, _, first, _, _ = _distinct(anchors)
        cuts = _cuts(grams, bounds)
        wanted = np.flatnonzero(bits_of(answers, "wanted", cuts))
        at = np.searchsorted(wanted, cuts)
        rows = []
        for i in np.flatnonzero(np.diff(at)):
            which = wanted[at[i]:at[i + 1]]
            own = first[which]
            start, end = anchors.start[own], anchors.end[own]
            rows.append({
                "range": int(i), "chunk": docs["chunk"][0].as_py(), "grams": grams[which].tobytes(),
                "which": which.tobytes(), "lefts": (anchors.place[own] - start).tobytes(), "sizes": (end - start).tobytes(),
                "bytes": b"".join(data[a:b].tobytes() for a, b in zip(start, end))})
        kind = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), *((x, pa.binary()) for x in
                          ("grams", "which", "lefts", "sizes", "bytes"))])
        return pa.Table.from_pylist(rows, schema=kind)

    def compare(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(flat(table[name])[0].tobytes(), kind)
        grams, lefts, sizes = read("grams", U), read("lefts", np.int64), read("sizes", np.int64)
        data, n = flat(table["bytes"])[0], len(grams)
        start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        right, left = np.zeros((n, length), np.uint8), np.zeros((n, max(length - gram, 1)), np.uint8)
        steps = np.arange(length)
        for i in range(0, n, 4096):  # bounded index arrays
            own = slice(i, i + 4096)
            inside = steps < (sizes - lefts)[own, None]
            right[own] = np.where(inside, data[np.minimum((start + lefts)[own, None] + steps, len(data) - 1)], 0)
            back = steps[:left.shape[1]]
            left[own] = np.where(back < lefts[own, None], data[np.maximum((start + lefts)[own, None] - 1 - back, 0)], 0)
        cover = np.stack(repeats(grams, right, sizes - lefts, left, lefts, length, report), axis=1)
        cuts = flat(table["grams"])[1] // 8
        which, rows = read("which", np.int64), []
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            hit = np.flatnonzero(cover[a:b, -1] >= report) + a
            if len(hit):
                rows.append({"chunk": table["chunk"][k].as_py(), "range": table["range"][k].as_py(), "which": which[hit].tobytes(),
                             "cover": cover[hit].tobytes()})
        kind = pa.schema([("chunk", pa.int32()), ("range", pa.int32()), *((x, pa.binary()) for x in ("answer", "wanted", "which", "cover"))])
        return pa.Table.from_pylist(rows, schema=kind)

    sent = chunks.groupBy("chunk").cogroup(status.groupBy("chunk")).applyInArrow(texts, TEXTS)
    found = status.union(sent.groupBy("range").applyInArrow(compare, FOUND))
    out = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType()),
        T.StructField("n_repeated", T.LongType()), T.StructField("longest_repeat", T.LongType())])

    def mark(docs: pa.Table, found: pa.Table) -> pa.Table:
        data, offsets = flat(docs["text"])
        anchors = Anchors(data, offsets, length, gram, report)
        grams, _, _, which, _ = _distinct(anchors)
        cuts = _cuts(grams, bounds)
        is_status = np.array([x is not None for x in found["answer"].to_pylist()], bool)
        whole = bits_of(found.filter(pa.array(is_status)), "answer", cuts)
        cover = np.zeros((len(grams), 5), np.int64)
        for row in found.filter(pa.array(~is_status)).to_pylist():
            cover[np.frombuffer(row["which"], np.int64)] = np.frombuffer(row["cover"], np.int32).reshape(-1, 5)
        size = anchors.end - anchors.start
        cover = cover[which]

        def reached(least: int, before: np.ndarray, after: np.ndarray) -> np.ndarray:
            all_ = whole[which] & (size >= least)
            start, end = np.where(all_, anchors.start, anchors.place - before), np.where(all_, anchors.end, anchors.place + after)
            hit = all_ | (after > 0)
            return covered(start[hit], (end - start)[hit], len(data))

        gone = reached(length, cover[:, 0], cover[:, 1])
        told = np.concatenate(([0], np.cumsum(gone if report == length else reached(report, cover[:, 2], cover[:, 3]))))
        best = np.maximum(np.where(whole[which], size, 0), cover[:, 4])
        longest = np.zeros(docs.num_rows, np.int64)
        np.maximum.at(longest, np.searchsorted(offsets, anchors.place, "right") - 1, np.where(best >= report, np.minimum(best, length), 0))
        removed, n_spans, begins, stops, kept = [], [0], [], [], []
        for i in range(docs.num_rows):
            low, high = int(offsets[i]), int(offsets[i + 1])
            mask = gone[low:high]
            s, e = spans_of(mask)
            removed.append(int(mask.sum()))
            n_spans.append(len(s))
            begins.append(s)
            stops.append(e)
            kept.append(data[low:high][~mask].tobytes() if len(s) else data[low:high].tobytes())
        ends = np.cumsum(n_spans)
        return pa.table({
            id_col: docs["id"], "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "starts": lists(np.concatenate(begins), ends, pa.int64()), "ends": lists(np.concatenate(stops), ends, pa.int64()),
            "kept": pa.array(kept, pa.binary()), "n_repeated": pa.array(np.diff(told[offsets]), pa.int64()),
            "longest_repeat": pa.array(longest, pa.int64())})

    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(mark, out)
