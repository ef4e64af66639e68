"""Operator 12 against all pairs of words."""

import random
import re
import zlib

import numpy as np
import pytest

from tracewright.llm.spelling import Trie, Words, corpus_words, inserted, letter_groups, near_words, spelling_variants

from .helpers import documents


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(counts, factor=2):
    out = {}
    for w, n in counts.items():
        others = [(-counts[o], o) for o in counts if near(w, o)]
        form = min(others, default=None)
        form = form and -form[0] >= factor * n and form[1] or None
        out[w] = [form, n, len(others), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


def found_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def vocabulary(seed, n, letters="abcé", longest=9):
    """Many words of few letters, so that leaves are full and near words many."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(n)}
    return {w: rng.choice([1, 1, 2, 4, 4, 9, 20, 100]) for w in sorted(words)}


@pytest.mark.parametrize("groups, cell_words", [(12, 1 << 15), (2, 1 << 15), (3, 40), (4, 7), (1, 25)])
def test_equals_all_pairs(spark, groups, cell_words):
    counts = vocabulary(groups, 700)
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = spelling_variants(rows, groups=groups, cell_words=cell_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found_of(got) == brute(counts)


def test_chain_of_forms(spark):
    """Each word is near the next, twice as frequent one; ties go to the smaller word."""
    counts = {"a" * i: 3 * 2 ** i for i in range(5, 18)} | {"xyzzy": 5, "xyzzx": 10, "xyzza": 10}
    got = found_of(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts)
    assert got["aaaaa"][1] == "a" * 17 and got["xyzzy"][0] == "xyzza"


def test_long_and_unusual_words(spark):
    long = "ab" * 400
    words = [long, long[:-1], long[:300] + "z" + long[301:], "z" + long, "zz" + long, "😀bcde", "😀bcdf", "bcdef", "é" * 6, "é" * 7]
    counts = {w: 3 + 10 * i for i, w in enumerate(words)}
    got = found_of(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), groups=4))
    assert got == brute(counts)


def test_trie_reaches_what_one_edit_reaches():
    words = sorted(vocabulary(4, 300))
    table = np.arange(0x110000) % 5
    counts = Words(words).counts(table, 5)
    trie = Trie(counts)
    asks, leaf = trie.search(counts, 1, 1)
    got = set(zip(asks.tolist(), leaf.tolist()))
    assert len(got) == len(asks)
    for i, a in enumerate(counts):
        want = {int(trie.leaf[j]) for j, b in enumerate(counts) if (d := b - a).max() <= 1 and d.min() >= -1
                and (d > 0).sum() == (d < 0).sum() <= 1}
        assert {x for y, x in got if y == i} == want


def test_inserted():
    pairs = [("abc", "abcd"), ("abc", "xabc"), ("abc", "abxc"), ("abc", "abdd"), ("aab", "aaab"), ("abc", "acbx"), ("", "a")]
    width = 5
    short, long = (np.array([[ord(c) for c in w.ljust(n, "\0")] for w in side], np.uint32)
                   for side, n in ((([a for a, _ in pairs]), width), ([b for _, b in pairs], width + 1)))
    assert inserted(short, long, np.array([len(a) for a, _ in pairs])).tolist() == [near(a, b) for a, b in pairs]


def words_of(rows, one_in):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_words_of_texts(spark):
    rng = random.Random(8)
    some = ["Straße", "ÉCOLE", "école", "coffee", "Coffees", "abcd", "x" * 300, "naïve÷", "word_with", "tab\tsplit", "日本語abcde"]
    rows = [(i // 2, " ".join(rng.choice(some) for _ in range(40)) + rng.choice([",", "\n", "9"])) for i in range(60)]
    rows += [(None, "coffee coffee"), (None, "coffee coffee"), (7, None), (8, ""), (9, "1 2 3"), (10, "longer " * 50_000)]
    got = {r.word: r.n for r in corpus_words(documents(spark, rows), misspell_one_in=3).collect()}
    assert got == words_of(rows, 3) and len(got) > 8


def test_nothing(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling_variants(none).collect() == [] and near_words(none).collect() == []
    assert corpus_words(documents(spark, [])).collect() == [] and letter_groups(none) == [""]
    one = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert found_of(spelling_variants(one)) == {"alone": (None, "alone", 3, 0, None)}
