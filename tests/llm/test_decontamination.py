"""Operator 2 against brute force."""

import random
import re

import pytest

from tracewright.llm import decontamination
from tracewright.llm.decontamination import decontaminate
from tracewright.llm.exchange import checkpointed

from .helpers import ODD, bag, documents, sample_texts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(rows, items, window):
    out = []
    for doc, text in rows:
        w = tokens(text)
        hit, names = [False] * len(w), set()
        for item, body in items:
            x = tokens(body)
            n = min(window, len(x))
            own = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in own:
                    hit[i:i + n] = [True] * n
                    names.add("" if item is None else str(item))
        out.append((doc, len(w), sum(hit), sorted(names)))
    return bag(out)


def items_table(spark, items):
    return spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, items string")


ITEMS = [(1, "A b, c d e f"), (2, None), (3, ""), (4, "..."), (5, "one"), (5, "é ü"), (None, "nul byte"), (10, "word word word word"), (9, "zz")]


@pytest.mark.parametrize("window, gram", [(4, 2), (10, 5)])
def test_odd_rows(spark, window, gram):
    got = decontaminate(documents(spark, ODD), items_table(spark, ITEMS), window=window, gram=gram).collect()
    assert bag((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == brute(ODD, ITEMS, window)


def test_shared_passages(spark):
    texts = sample_texts(3, 90, "abcdefghijklmnop", 50, shared=0.5)
    rng = random.Random(4)
    items = [(i, t[:rng.randrange(10, 60)]) for i, t in enumerate(texts[::7])]
    rows = list(enumerate(texts))
    got = decontaminate(documents(spark, rows), items_table(spark, items), window=10, with_text=True).collect()
    assert bag((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == brute(rows, items, 10)
    assert {r.doc_id: r.text for r in got} == dict(rows)
    assert all(sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_hit for r in got)


def test_a_gram_of_all_items(spark):
    """A gram that all documents and items hold makes no pairs of them; a shared window lists all its items."""
    rng = random.Random(5)
    gram, passage = "which of the following is", "one two three four five six seven eight nine ten"

    def tail(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    items = [(i, f"{gram} {tail(12)}") for i in range(2_000)] + [(2_000 + i, f"{passage} eleven {tail(3)}") for i in range(40)]
    rows = [(i, f"{tail(5)} {gram} {tail(20)} {passage if i % 10 == 0 else ''} {items[i * 7][1] if i % 3 == 0 else ''}") for i in range(200)]
    seen = {}

    def watched(df):
        out = checkpointed(df)
        seen[tuple(out.columns)] = out.count()
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontamination, "checkpointed", watched)
        got = decontaminate(documents(spark, rows), items_table(spark, items)).collect()
    assert bag((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == brute(rows, items, 10)
    # 67 documents hold the 8 windows of an item, 20 the one of the passage
    assert sum(v for k, v in seen.items() if "like" in k) == 67 * 8 + 20


def test_empty_tables(spark):
    assert decontaminate(documents(spark, []), items_table(spark, ITEMS)).collect() == []
    got = decontaminate(documents(spark, ODD), items_table(spark, [])).collect()
    assert len(got) == len(ODD) and not any(r.n_hit for r in got)
