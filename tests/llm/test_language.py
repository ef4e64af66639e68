"""Operator 4: held-out accuracy, odd rows, and the models themselves."""

import numpy as np
import pyarrow as pa

from tracewright.llm.language_id import Level, _quantiles, held_out, identify, normalised, train
from tracewright.llm.queries import QUERIES, table

from .helpers import ODD, documents, sample_texts

SF = "/root/testdata/sf0.01"


def test_accuracy_on_rows_held_out(spark):
    found = QUERIES["op4_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    rest = found[found.held_out]
    assert len(found) == 1000 and len(rest) > 250
    assert (rest.lang == rest.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all() and not found.rejected.any()


def test_held_out_rows_teach_nothing(spark):
    docs = documents(spark, [(i, "xx yy zz", "one", "s") for i in range(40)])
    outside = docs.filter(held_out("doc_id"))
    assert 0 < outside.count() < 40
    assert train(outside, teach=~held_out("doc_id")) is None


def texts(n):
    low, high = sample_texts(1, n, ["abba", "bac", "cab"], 30), sample_texts(2, n, ["хлеб", "дом", "вода"], 30)
    return [(i, t, "low", None) for i, t in enumerate(low)] + [(1000 + i, t, "high", None) for i, t in enumerate(high)]


def test_odd_rows(spark):
    models = train(documents(spark, texts(60)))
    got = identify(documents(spark, [*ODD, (20, "ABBA, bac!"), (21, "ДОМ"), (22, "123 ?"), (23, "qqwwxxzzjjkkvvff" * 20)]), models).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) + 4
    for doc in (8, 9, 10, 14, 22):
        assert by[doc].lang_pred == "und" and by[doc].score == 0 and by[doc].rejected
    assert by[20].lang_pred == "low" and not by[20].rejected and by[21].lang_pred == "high" and not by[21].rejected
    assert by[23].rejected  # nothing like either language
    assert all(0 <= r.score <= 1 for r in got)


def test_long_and_repeated_texts_teach(spark):
    """A language of few long texts, and one whose most frequent text would fill the sample."""
    rows = texts(40)
    rows += [(2000 + i, f"zyx{chr(97 + i % 26)}wv qrs " * 4000, "long", None) for i in range(26)]
    rows += [(3000 + i, "same old words again " * 20, "copied", None) for i in range(400)]
    rows += [(4000 + i, t, "copied", None) for i, t in enumerate(sample_texts(5, 40, ["uno", "dos", "tres", "gato"], 30))]
    rows += [(5000, "only one text of this one", "single", None), (5001, "12 345 " * 9000, "single", None)]
    models = train(documents(spark, rows), train_chars=5_000)
    assert models.langs == ["copied", "high", "long", "low", "single"] and np.isfinite(models.limits).all()
    got = identify(documents(spark, [(1, "gato dos tres uno dos"), (2, "zyxcwv qrs zyxhwv qrs")]), models).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "copied", 2: "long"}


def test_limits_come_from_all_rows_that_do_not_teach(spark):
    """So the largest value of all as the limit rejects no labelled text."""
    low = [t for t in sample_texts(3, 300, ["abba", "bac", "cab", "acb"], 30) if t]
    rows = [(i, t, "low", None) for i, t in enumerate(low + [f"qw{chr(97 + i)}zk xvj " * 6 for i in range(5)])]
    docs = documents(spark, rows)
    models = train(docs, train_chars=600, quantile=1.0, margin=1e-6)
    assert identify(docs, models).filter("rejected").count() == 0
    assert identify(documents(spark, [(1, "ööö üüü ßßß " * 20)]), models).first().rejected


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(lang, float(x)) for lang, n in (("a", 1), ("b", 2), ("c", 3000)) for x in np.round(rng.normal(2, 1, n), 3)]
    found = _quantiles(spark.createDataFrame(rows, "lang string, nats double"), 0.99)
    want = {k: np.quantile([x for lang, x in rows if lang == k], 0.99) for k in "abc"}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert _quantiles(spark.createDataFrame([], "lang string, nats double"), 0.99) == {}


def test_labels_may_be_missing(spark):
    docs = documents(spark, [(1, "some text"), (2, None, "x", None)])
    assert train(docs) is None and train(documents(spark, [])) is None
    got = identify(docs, None).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in got} == {("und", 0.0, True)}
    assert identify(documents(spark, []), None).collect() == []


def test_probabilities_sum_to_one(spark):
    models = train(documents(spark, texts(40)), order=3)
    counts = [len(x.grams) for x in models.levels]
    assert counts[0] < counts[1] < counts[2]
    k = models.langs.index("low")
    chars = "abc "
    for context in ("ab", "ca", "a "):
        total = sum(np.exp(-(models.entropies(pa.array([(context + c).encode()], pa.binary()))[0][0, k] * (len(context) + 1)
                             - models.entropies(pa.array([context.encode()], pa.binary()))[0][0, k] * len(context)))
                    for c in "abcд")
        assert total < 1.0001  # of a few characters; the space cannot be asked at a text's end
    assert chars


def test_normalised_text():
    chars, offsets, letters = normalised(pa.array([b"A1b", None, b"  ", "É\x00x".encode(), b"\xff\xfeq"], pa.binary()))
    joined = "".join(map(chr, chars))
    assert [joined[a:b] for a, b in zip(offsets[:-1], offsets[1:])] == [" a b", " ", " ", " é x", " q"]
    assert letters.tolist() == [2, 0, 0, 2, 1]


def test_lookup_in_sorted_hashes():
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(1))
    level = Level(grams, 1)
    assert (level.find(grams) == np.arange(len(grams))).all() and (level.find(grams + np.uint64(1)) == -1).all()
    assert (Level(grams[:0], 1).find(grams) == -1).all()
