"""Operator 10: targets against a plain version, totals against targets."""

import math
from collections import defaultdict

import pytest

from tracewright.llm.queries import QUERIES
from tracewright.llm import source_mixing
from tracewright.llm.source_mixing import mix_sources

from .helpers import ODD, bag, documents, sample_texts, words


def targets_of(rows, weights=(3, 1, 2)):
    size = defaultdict(int)
    for _, text, _, source in rows:
        size[source] += len(words(text))
    names = sorted((s for s in size if s is not None), key=str.encode) + ([None] if None in size else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = 1.5 * sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        share = {s: (left - sum(capped.values())) * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * size[s]]
        if not above:
            return {**share, **capped}, size
        capped |= {s: 2 * size[s] for s in above}


def check(rows, got, slack):
    want, size = targets_of(rows)
    assert bag((r.doc_id, r.source, r.size) for r in got) == bag((d, s, len(words(t))) for d, t, _, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= slack, s


def test_mix(spark):
    texts = sample_texts(5, 240, ["a", "bb", "ccc"], 120)
    names = ["b", "a", "é", "B", "", None]
    rows = [(i, t, "en", names[min(i % 13, 5)]) for i, t in enumerate(texts)]
    docs = documents(spark, rows)
    got = mix_sources(docs).collect()
    check(rows, got, 3)
    again = mix_sources(docs.repartition(7)).collect()
    assert bag((r.doc_id, r.taken) for r in got) == bag((r.doc_id, r.taken) for r in again)
    # an exponential tilt: of two documents of a source the longer has the further rate
    for source in names:
        rates = sorted((r.size, r.rate) for r in got if r.source == source)
        steps = [b[1] - a[1] for a, b in zip(rates, rates[1:])]
        assert all(x >= -1e-12 for x in steps) or all(x <= 1e-12 for x in steps)


def test_many_equal_rows_in_blocks(spark, monkeypatch):
    from tracewright.llm import source_mixing
    monkeypatch.setattr(source_mixing, "BLOCK_ROWS", 10)
    rows = [(i, "x y z", "en", "a") for i in range(200)] + [(i, "q r", "en", "b") for i in range(50)]
    check(rows, mix_sources(documents(spark, rows)).collect(), 3)


def test_odd_rows(spark):
    rows = [(d, t, "en", None if i % 2 else "s") for i, (d, t) in enumerate(ODD)]
    check(rows, mix_sources(documents(spark, rows)).collect(), 60_000)
    rows = [(1, None, None, None), (2, "", None, "a"), (2, "", None, "a")]
    got = mix_sources(documents(spark, rows)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 3
    assert mix_sources(documents(spark, [])).collect() == []


def test_query(spark):
    got = QUERIES["op10_source_mixing"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text, None, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want, _ = targets_of(rows)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 20 for s in want)


def test_rates_agree_to_the_last_bit(spark):
    """Whatever the partitions: the sizes of a source are added up in their order."""
    texts = sample_texts(11, 300, ["a", "bb", "ccc"], 200)
    docs = documents(spark, [(i, t, "en", "ab"[i % 3 > 1]) for i, t in enumerate(texts)])
    rates, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (1, 5, 13):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rates.append(bag((r.doc_id, r.rate, r.copies) for r in mix_sources(docs.repartition(partitions)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rates[0] == rates[1] == rates[2] and len(rates[0]) == 300


def test_newton_steps_start_no_jobs(spark, monkeypatch):
    """Jobs of each step (57 shuffles in the pipeline's check) took the driver's memory; now it is one plan."""
    targets = spark.createDataFrame([("=a", 40, 10, 30.0), ("=b", 10, 5, 20.0)],
                                    "key string, source_size long, documents long, target double")
    counts = spark.createDataFrame([("=a", 4, 5), ("=a", 5, 4), ("=a", 0, 1), ("=b", 2, 5)], "key string, size long, n long")
    monkeypatch.setattr(source_mixing, "checkpointed", None)
    tilt = {r.key: r.tilt for r in source_mixing.tilts(counts, targets).collect()}
    words = sum(n * size * min(2, math.exp(tilt["=a"] * size / 4)) for size, n in ((4, 5), (5, 4)))
    assert words == pytest.approx(30, rel=1e-8) and tilt["=b"] is None
