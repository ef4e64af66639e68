"""Operator 13: features and scores against plain loops, held-out labels, odd rows."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import quality
from tracewright.llm.quality import BINS, Machine, features, fit, held_out, measure, metadata_bins, score, train
from tracewright.llm.queries import QUERIES, table

from .helpers import ODD, documents, sample_texts

SF = "/root/testdata/sf0.01"


def column(texts):
    return pa.array([None if t is None else t.encode() for t in texts], pa.binary())


def labels_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, quality int, text string, n_chars long")


def test_held_out_labels(spark):
    found = QUERIES["op13_quality"](spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(table(spark, SF, "labels"), "doc_id").filter("held_out").toPandas()
    assert found.count() == 1000 and len(rows) > 50
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert np.mean([(g > b) for g in good for b in bad]) > 0.99
    assert (rows[rows.quality == 1].predicted == 1).mean() > 0.98 and (rows[rows.quality == 0].predicted == 0).mean() > 0.7
    assert found.filter("score < 0 OR score > 1 OR score IS NULL OR predicted <> int(score >= 0.3)").count() == 0


def test_held_out_rows_teach_nothing(spark):
    docs = documents(spark, [(i, f"text {i}", "l", "s") for i in range(60)])
    labels = labels_table(spark, [(i, i % 2) for i in range(60)])
    outside = labels.filter(held_out("doc_id"))
    assert 0 < outside.count() < 60
    assert train(docs, outside, teach=~held_out("doc_id")) is None
    one = train(docs, labels, teach=~held_out("doc_id"), least_steps=5)
    two = train(docs, labels.filter(~held_out("doc_id")), least_steps=5)
    assert one.bias == two.bias and (one.weights == two.weights).all() and (one.factors == two.factors).all()


def test_scores_are_pair_sums():
    rng = np.random.default_rng(1)
    machine = Machine(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    rows = [rng.choice(50, n, replace=False) for n in (1, 2, 9, 30)]
    values = [rng.normal(size=len(r)).astype(np.float32) for r in rows]
    got = machine.scores(np.concatenate(rows), np.concatenate(values), np.concatenate(([0], np.cumsum([len(r) for r in rows]))))
    for r, x, s in zip(rows, values, got):
        raw = 0.3 + sum(float(machine.weights[i]) * v for i, v in zip(r, x))
        raw += sum(float(machine.factors[r[a]] @ machine.factors[r[b]]) * x[a] * x[b] for a in range(len(r)) for b in range(a))
        assert s == pytest.approx(1 / (1 + math.exp(-raw)), rel=1e-4)


def plain(text):
    text = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text) if w]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    of = quality._kinds
    return [sum(of[c] == k for c in text) for k in range(1, 7)] + [
        len(text), len(words), sum(a == b for a, b in zip(low, low[1:])), sum(of[w[-1]] == 4 for w in words), sum(of[w[-1]] == 5 for w in words)], low


@pytest.mark.parametrize("piece", [1 << 20, 40, 7])
def test_counts_of_texts(monkeypatch, piece):
    """Also where texts are cut into pieces."""
    monkeypatch.setattr(quality, "_PIECE", piece)
    texts = [None, "", "  ", "One two two TWO three.", "a b! c| | d\n\ne, é ñ", "x" * 50 + " y " + "z" * 90, "no no no no " * 9, "\n", "end "]
    texts += sample_texts(4, 20, ["aa", "Bb.", "c1", "##"], 30)
    text, bucket, count, counted = measure(column(texts))
    for i, t in enumerate(texts):
        want, low = plain(t)
        assert counted[i].tolist() == want, t
        assert sorted(count[text == i].tolist()) == sorted(low.count(w) for w in set(low))
    assert len(set(zip(text.tolist(), bucket.tolist()))) == len(text)
    index, value, offsets = features(column(texts), [np.arange(len(texts), dtype=float)])
    words = np.bincount(text, minlength=len(texts))
    assert (np.diff(offsets) == words + len(quality.STATISTICS) + 1).all() and (index < (1 << quality.BITS) + 13 * BINS).all()


def test_metadata_bins():
    got = metadata_bins(np.array([np.nan, -1, np.inf, 0, 1, 3, 1e30]))
    assert got.tolist() == [0, 0, 0, 1, 2, 3, BINS - 1]


def test_learns_pairs():
    """A label that no single feature tells, but two together do."""
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (1500, 2))
    index = np.stack((bits[:, 0], 2 + bits[:, 1]), axis=1).reshape(-1)
    label = (bits[:, 0] == bits[:, 1]).astype(int)
    offsets = np.arange(0, 3001, 2)
    machine = fit(index, np.ones(len(index), np.float32), offsets, label, 4, epochs=60, step=0.1)
    assert ((machine.scores(index, np.ones(len(index), np.float32), offsets) >= 0.5) == label).mean() == 1


def test_odd_rows(spark):
    good, bad = sample_texts(1, 80, ["abba.", "bac", "Cab"], 30), sample_texts(2, 80, ["##", "X|", "@@"], 30)
    rows = [(100 + i, t) for i, t in enumerate(good + bad)]
    labels = [(100 + i, int(i < 80)) for i in range(160)] + [(100, None), (None, 1), (101, 1), (101, 0), (99999, 0)]
    docs = documents(spark, rows + rows[:5] + ODD)
    machine = train(docs, labels_table(spark, labels))
    got = score(documents(spark, [*ODD, (20, "abba. bac Cab abba."), (21, "## X| @@ ## X|")]), machine).collect()
    assert len(got) == len(ODD) + 2 and all(0 < r.score < 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())  # equal rows, equal scores
    assert by[20].pop() > 0.8 and by[21].pop() < 0.2
    again = train(docs.repartition(7), labels_table(spark, labels))
    assert again.bias == machine.bias and (again.factors == machine.factors).all()
    # of one kind only, and none at all
    assert score(docs, train(docs, labels_table(spark, [(100, 1), (102, 1)]))).filter("score < 0.5").count() == 0
    assert train(docs, labels_table(spark, [])) is None and train(documents(spark, []), labels_table(spark, labels)) is None
    assert {r.score for r in score(docs, None).collect()} == {0.5}
    assert score(documents(spark, []), machine).collect() == []


def test_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.lit(1).alias("n_chars"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    machine = train(docs, labels, sample_rows=200, least_steps=1, epochs=1)
    assert isinstance(machine, Machine)
    words = (machine.factors[:1 << quality.BITS] != 0).any(axis=1).sum()
    assert 100 < words <= 202  # a number for each row, and two words more
    few = train(docs, labels, sample_bytes=300, least_steps=1, epochs=1)
    assert (few.factors[:1 << quality.BITS] != 0).any(axis=1).sum() < 30
