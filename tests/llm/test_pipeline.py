"""The pipeline: each stage against a plain version of its decisions."""

from collections import Counter

import pytest

import corpus_pipeline
from tracewright.llm import queries

from .helpers import ODD, documents, words
from .test_decontamination import tokens
from .test_near import shingles

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    out, docs = {"documents": spark.read.parquet(f"{SF}/documents.parquet")}, None
    for name, stage in corpus_pipeline.STAGES:
        docs = list(out.values())[-1]
        stage(spark, docs, SF).write.parquet(str(folder / name.replace(" ", "-")))
        out[name] = spark.read.parquet(str(folder / name.replace(" ", "-")))
    return {name: (df.columns, {r.doc_id: r for r in df.collect()}) for name, df in out.items()}


def test_stages_are_named_and_ordered(stages):
    assert list(stages)[1:] == ["language", "lines", "near duplicates", "decontamination", "mix"]
    for name in list(stages)[:-1]:
        assert stages[name][0] == COLUMNS
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_keeps_clean_documents(stages):
    assert stages["language"][1] == stages["documents"][1]


def test_lines(stages):
    before, after = stages["language"][1], stages["lines"][1]
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").lower()
    held = Counter(k for r in before.values() for k in {key(x) for x in r.text.split("\n")})
    assert before.keys() == after.keys()
    for doc, r in before.items():
        kept = [x for x in r.text.split("\n") if not key(x) or held[key(x)] < 10]
        assert after[doc].text == "\n".join(kept)
        assert after[doc].n_chars == (len(after[doc].text) if after[doc].text != r.text else r.n_chars)


def test_one_of_each_group_stays(stages):
    before, after = stages["lines"][1], stages["near duplicates"][1]
    sets = {d: shingles(r.text) for d, r in before.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(after) == {d for d in sets if find(d) == d} and 0 < len(after) < len(before)
    assert all(after[d] == before[d] for d in after)


def test_documents_with_benchmark_passages_go(spark, stages):
    before, after = stages["near duplicates"][1], stages["decontamination"][1]
    items = [tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + min(10, len(w))]) for w in items for i in range(max(1, len(w) - 9)) if w}
    dirty = {d for d, r in before.items() for n in {len(x) for x in windows}
             if any(tuple(tokens(r.text)[i:i + n]) in windows for i in range(len(tokens(r.text)) - n + 1))}
    assert set(after) == set(before) - dirty and dirty


def test_mix(stages):
    before, after = stages["decontamination"][1], stages["mix"][1]
    assert set(before) == set(after)
    total = sum(len(words(r.text)) for r in before.values())
    assert sum(r.taken for r in after.values()) == pytest.approx(1.5 * total, rel=0.02)
    assert all(r.size == len(words(before[d].text)) and 0 <= r.taken <= 2 * r.size for d, r in after.items())


def test_run_gives_the_rows_of_the_stages(spark, stages):
    import __spark_entry__ as entry

    assert {r.doc_id: r for r in entry.queries()["pipeline"](spark, SF).collect()} == stages["mix"][1]


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns pass through all stages."""
    docs = documents(spark, [(d, t, None if i % 3 else "en", None if i % 2 else "s") for i, (d, t) in enumerate(ODD)])
    taught = docs.unionByName(documents(spark, [(1000 + i, f"plain words of one kind {i}", "en", "s") for i in range(30)]))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, taught, SF)
        rows = out.collect()
        if name == "mix":
            break
        assert out.columns == docs.columns
        taught = spark.createDataFrame(rows, taught.schema)
    kept = [r.doc_id for r in rows]
    assert kept.count(7) <= 1 and 8 not in kept and 10 not in kept


def test_null_text_stays_null_in_the_line_stage(spark):
    rows = corpus_pipeline.lines(spark, documents(spark, [(1, None), (2, "x")]), SF).collect()
    assert {r.doc_id: r.text for r in rows} == {1: None, 2: "x"}


def test_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_every_operator_is_registered():
    names = sorted(queries.QUERIES, key=lambda x: int(x[2:].split("_")[0]))
    assert [int(x[2:].split("_")[0]) for x in names] == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
