"""Operators 1, 3 and 6 against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import arrays, exchange, line_dedup as lines_module, suffix_dedup as suffixes
from tracewright.llm.line_dedup import PerfectHash, line_dedup
from tracewright.llm.substring_dedup import substring_dedup
from tracewright.llm.suffix_dedup import suffix_dedup

from .helpers import ODD, bag, documents, sample_texts, sha, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gone_of(items, starts, window):
    """Covered places of one sequence, given the repeated windows."""
    gone = [False] * len(items)
    for i in range(len(items) - window + 1):
        if starts[tuple(items[i:i + window])] > 1:
            gone[i:i + window] = [True] * window
    return gone


def windows_of(sequences, window):
    return Counter(tuple(s[i:i + window]) for s in sequences for i in range(len(s) - window + 1))


@pytest.mark.parametrize("rows, window", [
    (ODD, 3), ([(i, t) for i, t in enumerate(sample_texts(1, 80, "abcdefgh", 60))], 5), ([(1, "a a a a a a a")], 3)])
def test_substring_dedup(spark, rows, window):
    starts = windows_of([words(t) for _, t in rows], window)
    want = []
    for doc, text in rows:
        w = words(text)
        gone = gone_of(w, starts, window)
        want.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    got = substring_dedup(documents(spark, rows), window=window).collect()
    assert bag((r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in got) == bag(want)
    for r in got:  # maximal intervals
        assert sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_removed
        assert all(e < s for e, s in zip(r.ends, r.starts[1:]))


def test_words_of_long_texts_are_hashed_in_slices(monkeypatch):
    text = b"some words here and more words there " * 50
    data = np.frombuffer(text, np.uint8)
    starts, ends, first = arrays.runs(data, np.array([0, len(data)]), arrays.NOT_SPACE)
    whole, windows = arrays.run_hashes(data, starts, ends), None
    windows = arrays.window_hashes(whole, 7)
    monkeypatch.setattr(arrays, "_SLICE", 16)
    assert (arrays.run_hashes(data, starts, ends) == whole).all() and (arrays.window_hashes(whole, 7) == windows).all()
    assert len(set(whole.tolist())) == 6


def bytes_want(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    starts = windows_of([t for _, t in texts], length)
    out = []
    for doc, text in texts:
        gone = gone_of(text, starts, length)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(text), sum(gone), spans, sha(bytes(x for x, g in zip(text, gone) if not g))))
    return bag(out)


def near_texts(seed, alphabet, n=60):
    """Copies with edits of a few base texts: many contexts of one anchor."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(120)) for _ in range(3)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = rng.choice(alphabet)
        out.append((i, "".join(t[rng.randrange(20):])))
    return out


@pytest.mark.parametrize("rows, length, gram", [
    ([r for r in ODD if r[0] != 15] + [(15, "word " * 300)], 9, None), (near_texts(2, "abcdefghijklmnop"), 24, 6),
    (near_texts(3, "ab"), 16, 3), (near_texts(4, "a\x00\x01é"), 20, 5), ([(1, "x" * 500), (2, "x" * 30)], 12, None)])
def test_suffix_dedup(spark, rows, length, gram):
    got = suffix_dedup(documents(spark, rows), length=length, gram=gram).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, len(r.starts), sha(bytes(r.kept))) for r in got) == bytes_want(rows, length)


@pytest.mark.parametrize("rows, length, gram, report", [
    (near_texts(2, "abcdefghijklmnop"), 24, 4, 12), (near_texts(3, "ab"), 16, 3, 9), (near_texts(4, "a\x00\x01é"), 20, 5, 6),
    (near_texts(5, "abcdefghijklmnop"), 60, None, 20), ([(1, "x" * 500), (2, "x" * 30), (3, "xxy"), (4, None)], 12, None, 7)])
def test_reported_repeats(spark, rows, length, gram, report):
    """Shorter repeats are counted, not removed; the longest one is found up to the removed length."""
    got = suffix_dedup(documents(spark, rows), length=length, gram=gram, report=report).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, len(r.starts), sha(bytes(r.kept))) for r in got) == bytes_want(rows, length)
    texts = {d: (t or "").encode() for d, t in rows}
    starts = {n: windows_of(list(texts.values()), n) for n in range(report, length + 1)}
    for r in got:
        gone = {n: sum(gone_of(texts[r.doc_id], starts[n], n)) for n in starts}
        assert r.n_repeated == gone[report]
        assert r.longest_repeat == max((n for n in gone if gone[n]), default=0)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    data = np.frombuffer(np.random.default_rng(5).integers(0, 3, 5000, np.uint8).tobytes(), np.uint8)
    offsets = np.array([0, 40, 4500, 4500, 5000])
    whole = suffixes.Anchors(data, offsets, 32, 6)
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 300)
    cut = suffixes.Anchors(data, offsets, 32, 6)
    for name in ("place", "gram", "context", "start", "end"):
        assert (getattr(whole, name) == getattr(cut, name)).all(), name


def test_common_prefix_intervals():
    # suffixes of mississippi in order, common prefixes of neighbours
    found = set(suffixes.intervals([0, 1, 1, 4, 0, 0, 1, 0, 2, 1, 3]))
    assert found == {(1, 0, 3), (4, 2, 3), (1, 5, 6), (2, 7, 8), (3, 9, 10), (1, 7, 10), (0, 0, 10)}
    common = [0, 3, 3, 5]
    assert list(suffixes.intervals(common)) == [(5, 2, 3), (3, 0, 3)]


def test_repeats_between_any_two_members():
    # b agrees with c on the left, with a on the right: only non-neighbours share a whole window
    group = np.zeros(4, np.uint64)
    right = np.array([list(b"aaaa"), list(b"aaab"), list(b"aaac"), list(b"aaad")], np.uint8)
    left = np.array([list(b"zyx"), list(b"qrs"), list(b"zyx"), list(b"mno")], np.uint8)
    before, after, longest = suffixes.repeats(group, right, np.full(4, 4), left, np.full(4, 3), 6)
    assert before.tolist() == [3, 0, 3, 0] and after.tolist() == [3, 0, 3, 0]
    assert longest.tolist() == [6, 3, 6, 3]


LINES = ["The end.", " the END.\t", "x", "", "  ", "é", "unique {}", "A"]


@pytest.mark.parametrize("least, min_chars", [(2, 1), (10, 1), (3, 2)])
def test_line_dedup(spark, least, min_chars):
    rng = random.Random(6)
    rows = ODD + [(100 + i, "\n".join(rng.choice(LINES).format(i) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOW)
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    want = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < least]
        want.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    got = line_dedup(documents(spark, rows), min_docs=least, min_chars=min_chars).collect()
    assert bag((r.doc_id, r.n_lines, r.n_dropped, sha(r.kept)) for r in got) == bag(want)
    assert all(len(r.dropped) == r.n_dropped for r in got)


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000, 200_000):
        values = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        function = PerfectHash.build(values)
        again = PerfectHash(function.sizes, function.bits)
        assert sorted(again.index(values).tolist()) == list(range(len(values)))
        assert len(function.bits) <= n / 2 + 64  # about three bits a key
    assert lines_module._fingerprints(values).dtype == np.uint16


def test_empty_tables(spark):
    none = documents(spark, [])
    for operator in (substring_dedup, suffix_dedup, line_dedup):
        assert operator(none).collect() == []


def test_shared_folder_is_asked_of_a_cluster(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"
    with pytest.raises(RuntimeError):
        exchange.shared_folder(Cluster)
