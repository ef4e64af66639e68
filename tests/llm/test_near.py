"""Operator 9 against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F
import pytest

from tracewright.llm import near_dedup
from tracewright.llm.components import connected_components
from tracewright.llm.near_dedup import links_of, near_duplicates

from .helpers import ODD, bag, documents, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = words((text or "").translate(LOW))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return bag((doc, len(sets[i]), least.get(find(i)), doc == least.get(find(i))) for i, (doc, _) in enumerate(rows))


def copies(seed, n, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))] for _ in range(5)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(edits)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary).upper()
        rows.append((i, " ".join(t)))
    rng.shuffle(rows)
    return rows


def result(df, **more):
    return bag((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, **more).collect()
               for _ in range(r.n_same))


@pytest.mark.parametrize("rows", [ODD + copies(1, 60, 12), copies(2, 120, 25)])
def test_near_duplicates(spark, rows):
    rows = [(d if d is None else d + 1000 if i >= len(ODD) else d, t) for i, (d, t) in enumerate(rows)]
    assert result(documents(spark, rows)) == brute(rows)


def test_blocks_find_the_same(spark, monkeypatch):
    rows = copies(3, 80, 20)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1500)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 7)
    assert result(documents(spark, rows)) == brute(rows)


def test_pairs_at_the_border_meet(spark):
    """Pairs of similarity 0.75 exactly, which 12 keys of a side, or factors in steps, let miss each other."""
    rows = []
    for i, seed in enumerate((16, 220, 402, 744, 804, 900, 1156, 1190, 1227, 1296, 2003, 2010, 2111)):
        page = [f"s{seed}w{k}" for k in range(28)]
        rows += [(2 * i, " ".join(page)), (2 * i + 1, " ".join(page[:22]))]
    assert result(documents(spark, rows)) == brute(rows)


def test_one_row_stands_for_a_group(spark):
    found = near_duplicates(documents(spark, ODD)).collect()
    keepers = {r.row_key for r in found} & {r.keeper for r in found}
    assert {r.keeper for r in found} == keepers  # keepers are rows
    same = [r for r in found if r.n_shingles == 2]
    assert sorted((r.doc_id or 0, r.n_same) for r in same) == [(0, 2), (7, 2)] and len({r.keeper for r in same}) == 1


def test_equal_hashes_of_rows_lose_no_row(spark, monkeypatch):
    """Were the names of all rows the same, rows of other ids would still be rows, and sets that differ no class."""
    monkeypatch.setattr(near_dedup, "row_key", lambda *columns: F.lit("same"))
    rows = [(i, f"w{i} x{i} y{i} z{i} q{i} r{i}") for i in range(40)] + [(100, "w0 x0 y0 z0 q0 r0"), (101, "")]
    found = near_duplicates(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in rows) and all(r.n_same == 1 for r in found)
    groups = {r.doc_id: r.component_id for r in found}
    assert groups.pop(100) == 0 and groups == {i: i for i in groups}


def test_links_span_components():
    sets = [[1, 2, 3, 4], [1, 2, 3, 4, 5], [9], [1, 2, 3, 4, 5, 6], [9]]
    flat = np.array([x for s in sets for x in s], np.uint64)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    a, b, common = links_of(np.arange(5), flat, offsets, 75)
    assert {frozenset(x) for x in zip(a, b)} == {frozenset((1, 3)), frozenset((0, 1)), frozenset((2, 4))} and sorted(common) == [1, 4, 5]


def spanned(sets, percent=75):
    """Partitions of the sets by the links found, and by all pairs."""
    flat = np.array([x for s in sets for x in sorted(s)], np.uint64)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    a, b, _ = links_of(np.arange(len(sets)), flat, offsets, percent)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    out = []
    for links in (zip(a, b), pairs):
        group = list(range(len(sets)))
        for i, j in links:
            group = [group[i] if g == group[j] else g for g in group]
        out.append({frozenset(k for k, g in enumerate(group) if g == x) for x in group})
    return out


def test_links_when_another_component_becomes_the_largest():
    """Pages of a few templates that share most of their words, shortened and extended."""
    for seed in (168, 298, 468, 515, 578, *range(100)):
        rng, pages = random.Random(seed), []
        for k in range(rng.randrange(2, 5)):
            body = list(range(20, 20 + rng.randrange(20, 30))) + [k * 100 + 500 + x for x in range(rng.randrange(0, 12))]
            for _ in range(rng.randrange(8, 20)):
                cut = rng.randrange(12)
                page = body[:len(body) - cut] if rng.random() < 0.5 else body + [1000 * (k + 1) + x for x in range(cut)]
                pages.append(set(page) | {10**6 + rng.randrange(10**6) for _ in range(rng.randrange(4))})
        rng.shuffle(pages)
        found, want = spanned(pages)
        assert found == want, seed


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)] + [(200, x) for x in range(201, 230)]
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, **{x: 200 for x in range(200, 230)}}
    assert {r.node: r.component for r in found} == want and len(found) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).collect() == []
