"""Small tables for the operators: odd rows, and columns whose names the operators use inside."""

import hashlib
import random
import re

CLASHING = ["id", "row", "chunk", "range", "answer", "row_key", "class", "key", "size", "order", "kept", "n", "label",
            "component", "bucket", "items", "copies", "host", "rank"]
SPACES = r"[^\x20\x09-\x0D]+"


def documents(spark, rows):
    """(doc_id, text, lang, source) rows as a table of documents with clashing columns."""
    rows = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    full = [(*r, None if r[1] is None else len(r[1]), *(f"x{i}" if i % 2 else None for i in range(len(CLASHING)))) for r in rows]
    return spark.createDataFrame(full, kind).repartition(3)


ODD = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None), (9, ""), (10, " \t\n\r\x0b\x0c "),
       (11, "one"), (12, "é ü  x"), (13, "nul\x00byte a b c d e f"), (14, "\n\n"), (15, "word " * 60_000)]


def sample_texts(seed, n, words, longest, shared=0.3):
    """Texts over a few words, some of which hold passages of others."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(longest))]
        if out and rng.random() < shared:
            other = rng.choice(out)
            i = rng.randrange(len(other) + 1)
            text[len(text) // 2:len(text) // 2] = other[i:i + rng.randrange(longest)]
        out.append(text)
    return [rng.choice([" ", "  ", "\n", "\t "]).join(t) for t in out]


def words(text):
    return re.findall(SPACES, text or "")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def bag(rows):
    return sorted(map(repr, rows))
