"""Operator 11 against plain Lloyd rounds on integers."""

import numpy as np
import pytest

from tracewright.llm import vector_codes
from tracewright.llm.vector_codes import LIMIT, CoverTree, compress, squares, with_label_error


def plain(rows, parts, size, rounds, scale=1024):
    """(codes, errors, codebooks) of (id, vector) rows."""
    rows = sorted(rows)
    whole = np.array([[int(np.floor(np.clip(np.float64(np.float32(x)) * scale, -LIMIT, LIMIT))) for x in v] for _, v in rows])
    split = np.split(whole, parts, axis=1)
    books, codes, error = [], [], np.zeros(len(rows), np.int64)
    for own in split:
        book = own[:size].copy()
        for step in range(rounds + 1):
            far = ((own[:, None] - book[None]) ** 2).sum(axis=-1)
            near = far.argmin(axis=1)
            if step < rounds:
                for j in np.unique(near):
                    total, n = own[near == j].sum(axis=0), int((near == j).sum())
                    book[j] = [int(t) // n for t in total]
        codes.append(near)
        error += far.min(axis=1)
        books.append(book)
    return {i: (tuple(map(int, c)), int(e)) for (i, _), c, e in zip(rows, np.stack(codes, axis=1), error)}, np.stack(books)


def clustered(seed, n, dims, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (7, dims))
    points = centres[rng.integers(0, 7, n)] + rng.normal(0, spread, (n, dims))
    points[n // 3:n // 2] = points[0]  # copies
    return [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]


def table_of(spark, rows, label=lambda i: None):
    return spark.createDataFrame([(i, v, label(i), "x", 1) for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, key string, part int").repartition(3)


@pytest.mark.parametrize("dims, size, parts, block", [(8, 16, 4, 50), (8, 300, 2, 1000), (4, 1, 4, 7), (12, 5, 3, 64)])
def test_equals_plain_rounds(spark, dims, size, parts, block):
    rows = clustered(dims + size, 240, dims)
    coded, books = compress(table_of(spark, rows), parts=parts, size=size, rounds=4, block_rows=block)
    want, want_books = plain(rows, parts, size, 4)
    assert {r.vec_id: (tuple(r.codes), r.error) for r in coded.collect()} == want
    assert (books == want_books).all()


def test_whole_subtrees_are_given_away():
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (12, 6))
    points = centres[rng.integers(0, 12, 900)] + rng.integers(-20, 21, (900, 6))
    tree = CoverTree.unpack(6, CoverTree.build(points).pack())
    found, (whole, _), exact = tree.assign(centres)
    assert (found[tree.place] == squares(points, centres).argmin(axis=1)).all()
    sizes = tree.high[whole] - tree.low[whole]
    assert sizes.max() > 20 and len(exact) < 200
    total, count = tree.sums(centres)
    near = squares(points, centres).argmin(axis=1)
    assert (count == np.bincount(near, minlength=12)).all()
    assert all((points[near == j].sum(axis=0) == total[j]).all() for j in range(12))


def test_tree_covers_each_point_once():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 700):
        points = rng.integers(-30, 30, (n, 3))
        tree = CoverTree.build(points)
        assert (tree.points[tree.place] == points).all() and tree.weight.sum() == n
        for i in range(len(tree.low)):
            inside = tree.points[tree.low[i]:tree.high[i]]
            assert squares(inside, tree.points[tree.low[i]][None]).max() <= tree.radius[i] ** 2 * (1 + 1e-9)
            kids = range(tree.child[i], tree.child[i] + tree.children[i])
            ends = [tree.direct[i], *(tree.high[k] for k in kids)]
            assert [tree.low[k] for k in kids] == ends[:-1] and ends[-1] == tree.high[i]


def test_ties_go_to_the_smaller_entry(spark):
    """Entries 0 and 1 are equally far from the third row; equal entries at the start."""
    rows = [(0, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])]
    coded, _ = compress(table_of(spark, rows), parts=2, size=2, rounds=0)
    assert {r.vec_id: r.codes[0] for r in coded.collect()} == {0: 0, 1: 1, 2: 0, 3: 0}
    want, _ = plain(rows, 2, 4, 4)
    coded, _ = compress(table_of(spark, rows), parts=2, size=4, rounds=4)
    assert {r.vec_id: (tuple(r.codes), r.error) for r in coded.collect()} == want


def test_large_components_stay_exact(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 40_000, 4)]) for i in range(60)] + [(99, [3e38, -3e38, 1.0, 0.5])]
    want, want_books = plain(rows, 2, 6, 2)
    coded, books = compress(table_of(spark, rows), parts=2, size=6, rounds=2)
    assert {r.vec_id: (tuple(r.codes), r.error) for r in coded.collect()} == want and (books == want_books).all()
    small = rng.integers(-900, 900, (50, 5))
    floats = squares(small, small[:9])
    monkeypatch.setattr(vector_codes, "_EXACT", 0)
    assert (squares(small, small[:9]) == floats).all()


def test_odd_rows(spark):
    rows = [(5, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (None, [4.0, 2.0, 3.0]), (6, None), (7, [1.0, None, 2.0]), (8, [float("nan")] * 3),
            (9, [float("inf"), 0.0, 0.0]), (10, [1.0]), (11, []), (5, [1.0, 2.0, 3.0]), (5, [-1.0, 0.0, 0.0])]
    coded, books = compress(table_of(spark, rows, label=lambda i: 1 if i == 5 else None), keep=("label", "key"), size=8)
    got = with_label_error(coded, "label").collect()
    assert sorted((r.vec_id is None, r.vec_id, r.codes is None) for r in got if r.vec_id is not None) == [
        (False, 5, False)] * 3 + [(False, 10, True), (False, 11, True)]
    assert len(got) == 7 and {r.key for r in got} == {"x"}
    assert books.shape == (4, 5, 1) and all(r.error == 0 for r in got if r.codes)  # filled up with a zero
    assert {r.vec_id: r.label_error for r in got} == {5: 0, None: 0, 10: 0, 11: 0}
    # nothing at all
    coded, books = compress(table_of(spark, [(1, None)]))
    assert coded.collect() == [] and books.shape[1] == 0 and coded.columns == ["vec_id", "codes", "error"]
    coded, _ = compress(table_of(spark, [(1, [])]))
    assert [(r.codes, r.error) for r in coded.collect()] == [([0, 0, 0, 0], 0)]


def test_label_errors_are_sums(spark):
    rows = clustered(3, 200, 4, spread=0.4)
    coded, _ = compress(table_of(spark, rows, label=lambda i: None if i % 3 == 0 else i % 2), keep=("label",), size=6)
    got = with_label_error(coded, "label").collect()
    want = {}
    for r in got:
        want[r.label] = want.get(r.label, 0) + r.error
    assert len(got) == 200 and all(r.label_error == want[r.label] for r in got)
