"""Operator 5 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm.queries import QUERIES, table
from tracewright.llm.vector_search import Codes, Queries, nearest, rotation


def brute(ids, vectors, asked, k):
    scores = {}
    for i in asked:
        own = [(-float(vectors[i] @ v), int(d)) for d, v in zip(ids, vectors) if d != ids[i]]
        scores[int(ids[i])] = [(d, -s) for s, d in sorted(own)[:k]]
    return scores


def found_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "embeddings").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, vectors, np.flatnonzero(ids % 20 == 0), 20)
    got = found_of(QUERIES["op5_vector_search"](spark, sf))
    assert got.keys() == want.keys()
    hits = sum(len({d for d, _ in want[q]} & {d for d, _ in got[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def vectors_table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string").repartition(3)


@pytest.mark.parametrize("dims, block", [(3, 4), (70, 1000)])
def test_blocks_ties_and_repeats(spark, dims, block):
    rng = np.random.default_rng(dims)
    points = rng.integers(-2, 3, (60, dims)).astype(float)
    points[points.any(axis=1) == False, 0] = 1  # noqa: E712
    points[20:30] = points[10]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    got = found_of(nearest(vectors_table(spark, rows), F.col("vec_id") % 5 == 0, k=7, query_block=block))
    assert got == brute(np.arange(60), points, range(0, 60, 5), 7)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (6, [2.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (0, [3.0, 0.0])]
    got = nearest(vectors_table(spark, rows), F.col("vec_id") % 5 == 0, k=3).collect()
    # only 0, 0 and 6 take part; a row of the query's own id is no neighbour
    assert {(r.query_id, r.vec_id) for r in got} == {(0, 6)} and len(got) == 2
    assert sorted(r.score for r in got) == [2.0, 6.0]


def test_empty_tables(spark):
    assert nearest(vectors_table(spark, []), F.lit(True)).collect() == []
    assert nearest(vectors_table(spark, [(1, [1.0])]), F.lit(False)).collect() == []
    assert nearest(vectors_table(spark, [(1, [1.0])]), F.lit(True)).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    vectors, asked = rng.standard_normal((2000, 64)) + 0.3, rng.standard_normal((40, 64))
    center, turn = vectors.mean(axis=0), rotation(64, 1)
    assert np.allclose(turn @ turn.T, np.eye(64))
    guess, error = Queries(np.arange(40), asked, center, turn).bounds(slice(0, 40), Codes(vectors, center, turn), 3.5)
    off = np.abs(guess - asked @ vectors.T)
    assert (off <= error).mean() > 0.999 and np.abs((guess - asked @ vectors.T).mean()) < 0.1
