"""Operator 12: spelling variants, by tries of letter-group counts.

Words are near if they differ by exactly one inserted, deleted or replaced code point.
A word's form is its most frequent near word, if that is ``factor`` times as frequent;
following forms leads to the word's root.

A word is the path of its length and its counts of ``groups`` groups of letters (chosen from
the letters of all words, so that groups weigh the same).  One edit adds at most one to
one count and takes at most one from one count.  So a search walks down a trie of
these counts with a budget of one surplus and one deficit; words at the leaves it reaches
are verified.  A leaf keeps its words sorted by their first and by their second half,
one of which an edit leaves as it is, so equal letters do not make all pairs of a leaf.

The upper levels of the trie (length and ``depth`` counts) are keys: a word is stored under
its own, and asks under those that the budget reaches.  ``depth`` is the smallest at which no key
has more than ``cell_words`` words (3 at most); a key that still has more is dealt into shards,
each of which the key's questions visit.  A task holds one shard's trie, answers a batch
of questions at a time, and returns one row for each word that has near words there.

The words of a text are its maximal runs of ``letters``; only A-Z are lower-cased.  Null
texts have none; a null id counts as ''.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U, mix
from .exchange import checkpointed

LETTERS = r"A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15 | 1
#: questions that walk down a trie at once
_BATCH = 1 << 13


def corpus_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, least_chars: int = 5,
                 least_count: int = 3, misspell_one_in: int | None = None) -> DataFrame:
    """(word, n): all words of ``least_chars`` code points and ``least_count`` occurrences.

    With ``misspell_one_in`` every run whose CRC-32 (with its document's id before it) is a
    multiple of that loses one code point, the one that the same number picks."""
    # a deletion makes no word longer, so shorter runs never count
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(f"[{letters}]{{{least_chars},}}"), F.lit(0))
    prefix = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    word = df.select(prefix.alias("prefix"), F.explode(runs).alias("run")).select(
        "prefix", F.translate("run", _UPPER, _LOWER).alias("run"))
    if misspell_one_in:
        word = word.select("run", F.crc32(F.concat("prefix", "run").cast("binary")).alias("h"))
        at = F.pmod("h", F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = word.select(F.when(F.col("h") % misspell_one_in == 0, cut).otherwise(F.col("run")).alias("run"))
    counts = word.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") >= least_count) & (F.length("word") >= least_chars))


def letter_groups(words: DataFrame, groups: int = 12) -> list[str]:
    """All letters of the words, in groups of about the same weight: each letter, in falling order
    of its number of occurrences, joins the lightest group."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().filter("letter <> ''").collect()
    out = [[0, ""] for _ in range(min(groups, max(len(letters), 1)))]
    for r in sorted(letters, key=lambda r: (-r["count"], r.letter)):
        lightest = min(out, key=lambda g: g[0])
        lightest[0] += r["count"]
        lightest[1] += r.letter
    return [g for _, g in out]


def count_of(word: Column, letters: str) -> Column:
    if not letters:
        return F.lit(0)
    return F.length(word) - F.length(F.translate(word, letters, ""))


class Words:
    """Words as a matrix of code points, with hashes of their halves."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.width = int(self.length.max(initial=1)) + 1
        self.chars = np.zeros((len(words), self.width), np.uint32)
        inside = np.arange(self.width) < self.length[:, None]
        self.chars[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)

    def counts(self, group_of: np.ndarray, groups: int) -> np.ndarray:
        out = np.zeros((len(self.length), groups), np.int64)
        rows = np.arange(len(self.length))
        for at in range(self.width):
            inside = self.length > at
            np.add.at(out, (rows[inside], group_of[np.minimum(self.chars[inside, at], len(group_of) - 1)]), 1)
        return out

    def half(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of the code points low:high of each word."""
        out = np.zeros(len(self.length), U)
        factor = np.ones(len(self.length), U)
        for at in range(self.width):
            inside = (at >= low) & (at < high)
            out[inside] += (self.chars[inside, at].astype(U) + U(1)) * factor[inside]
            factor[inside] *= U(_BASE)
        return mix(out)


class Trie:
    """Levels of counts.  Level k has the nodes of the first k counts, numbered in order; a node of
    level k + 1 is found by its parent and its count."""

    def __init__(self, counts: np.ndarray):
        self.span = int(counts.max(initial=0)) + 2  # so that one more than any count is no other key
        order = np.lexsort(counts.T[::-1]) if counts.shape[1] else np.arange(len(counts))
        node = np.zeros(len(counts), np.int64)
        self.levels = []
        for k in range(counts.shape[1]):
            key = node * self.span + counts[order, k]
            names, node = np.unique(key, return_inverse=True)
            self.levels.append(names)
        self.leaf = np.empty(len(counts), np.int64)
        self.leaf[order] = node

    def down(self, level: int, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The child of each node for a count, or -1."""
        names = self.levels[level]
        key = node * self.span + count
        at = np.minimum(np.searchsorted(names, key), len(names) - 1)
        return np.where((names[at] == key) & (count >= 0) & (count < self.span), at, -1)

    def search(self, counts: np.ndarray, surplus: int, deficit: int) -> tuple[np.ndarray, np.ndarray]:
        """(question, leaf): leaves whose counts exceed the question's by one in ``surplus`` groups
        and fall short of it by one in ``deficit`` groups; with one of each also equal counts."""
        asks, node = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        more, less = np.full(len(counts), surplus), np.full(len(counts), deficit)
        for level in range(len(self.levels)):
            steps = []
            for step in (-1, 0, 1):
                may = np.arange(len(asks)) if step == 0 else np.flatnonzero((more if step > 0 else less) > 0)
                child = self.down(level, node[may], counts[asks[may], level] + step)
                may, child = may[child >= 0], child[child >= 0]
                steps.append((asks[may], child, more[may] - (step > 0), less[may] - (step < 0)))
            asks, node, more, less = (np.concatenate(x) for x in zip(*steps))
        done = more == less  # all of the budget, or none of it
        if surplus != deficit:
            done = (more == 0) & (less == 0)
        return asks[done], node[done]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of wanted, place in the sorted keys) of all equal keys."""
    low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
    size = high - low
    which = np.repeat(np.arange(len(wanted)), size)
    start = np.cumsum(size) - size
    return which, np.arange(size.sum()) + np.repeat(low - start, size)


class Leaves:
    """Words of each leaf, sorted by the halves that words of a given length share with them."""

    def __init__(self, words: Words, leaf: np.ndarray):
        self.words = words
        none, half = np.zeros(len(leaf), np.int64), words.length // 2
        short = (words.length - 1) // 2  # where a word of one letter less is halved
        self.sorted = {}
        for name, low, high in (("first", none, half), ("second", half, words.length),
                                ("first of less", none, short), ("second of less", short + 1, words.length)):
            key = self.key(leaf, words.half(low, high))
            order = np.argsort(key, kind="stable")
            self.sorted[name] = key[order], order

    @staticmethod
    def key(leaf: np.ndarray, half: np.ndarray) -> np.ndarray:
        return half ^ mix(leaf.astype(U) + U(1))

    def candidates(self, asking: Words, of: np.ndarray, leaf: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(question, word): pairs that share a half; a pair may come twice.  ``of``: whose question visits a leaf."""
        half = asking.length // 2
        found = []
        for name, hashes in (("first", asking.half(np.zeros_like(half), half)), ("second", asking.half(half, asking.length))):
            keys, order = self.sorted[name + " of less" * longer]
            which, place = _found(keys, self.key(leaf, hashes[of]))
            found.append((of[which], order[place]))
        return tuple(np.concatenate(x) for x in zip(*found))


def replaced(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows that differ in exactly one place."""
    return (short != long).sum(axis=1) == 1


def inserted(short: np.ndarray, long: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of ``long`` that are the row of ``short`` (of that length) with one more code point."""
    place = np.arange(short.shape[1])
    inside = place < length[:, None]
    differs = (short != long[:, :short.shape[1]]) & inside
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    shifted = np.zeros_like(short)
    shifted[:, :] = long[:, 1:short.shape[1] + 1]
    return ~((short != shifted) & inside & (place >= first[:, None])).any(axis=1)


def near_pairs(stored: list[str], asking: list[str], group_of: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asking, stored, longer): all near pairs in which the stored word is as long as the asking word, or
    longer by one."""
    words = Words(stored)
    trie = Trie(words.counts(group_of, groups))
    leaves = Leaves(words, trie.leaf)
    lengths = np.unique(words.length)
    out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)]
    for begin in range(0, len(asking), _BATCH):
        some = Words(asking[begin:begin + _BATCH])
        counts = some.counts(group_of, groups)
        for longer in (False, True):
            rows = np.flatnonzero(np.isin(some.length + longer, lengths))
            of, leaf = trie.search(counts[rows], 1, 0 if longer else 1)
            ask, word = leaves.candidates(some, rows[of], leaf, longer)
            same = words.length[word] == some.length[ask] + longer
            pair = np.unique(ask[same] * len(stored) + word[same])
            for i in range(0, len(pair), 1 << 16):
                ask, word = np.divmod(pair[i:i + (1 << 16)], len(stored))
                short = np.zeros((len(ask), max(some.width, words.width)), np.uint32)
                short[:, :some.width] = some.chars[ask]
                long = np.zeros((len(ask), short.shape[1] + 1), np.uint32)
                long[:, :words.width] = words.chars[word]
                near = inserted(short, long, some.length[ask]) if longer else replaced(short, long[:, :-1])
                out.append((ask[near] + begin, word[near], np.full(near.sum(), longer)))
    return tuple(np.concatenate(x) for x in zip(*out))


_PART = "word string, n_near long, neg_n long, form string"


def _best(words: np.ndarray, of: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.Table:
    """One row for each word that has near words: how many, and the most frequent (the smallest of equals)."""
    keys = np.array([w.encode("utf-8", "surrogatepass") for w in words], object)
    rank = np.empty(len(keys), np.int64)
    rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    order = np.lexsort((rank[other], -n[other], of))
    first, count = np.unique(of[order], return_index=True, return_counts=True)[1:] if len(of) else (of, of)
    at = order[first]
    return pa.table({"word": pa.array(words[of[at]].tolist(), pa.string()), "n_near": pa.array(count, pa.int64()),
                     "neg_n": pa.array(-n[other[at]], pa.int64()), "form": pa.array(words[other[at]].tolist(), pa.string())})


def near_words(words: DataFrame, groups: int = 12, cell_words: int = 1 << 15) -> DataFrame:
    """(word, n_near, form_n, form): the number of near words of each word that has any, and the most
    frequent of them.  ``words`` has distinct words and their n, and is read several times."""
    letters = letter_groups(words, groups)
    counts = words.select("word", "n", F.length("word").alias("length"), *(
        count_of(F.col("word"), x).alias(f"c{i}") for i, x in enumerate(letters[:3])))
    levels = [f"c{i}" for i in range(len(letters[:3]))]
    sizes = counts.rollup("length", *levels).agg(F.count(F.lit(1)).alias("size"), F.grouping_id().alias("left")).groupBy("left").agg(
        F.max("size").alias("size")).collect()
    # grouping_id sets a bit for each level rolled up: all ones for the deepest kept level 0
    most = {len(levels) - bin(r.left).count("1"): r.size for r in sizes}
    depth = next((d for d in range(len(levels) + 1) if most.get(d, 0) <= cell_words), len(levels))
    cell = ["length", *levels[:depth]]
    key = F.concat_ws(",", *cell)

    def reached(longer: int) -> list[Column]:
        """Keys that the budget of one surplus and one deficit reaches from the word's own."""
        zero = [0] * depth
        steps = {tuple(zero)}
        plus = [tuple(int(i == j) for i in range(depth)) for j in range(depth)]
        steps |= set(plus)
        if not longer:
            minus = [tuple(-x for x in p) for p in plus]
            steps |= set(minus) | {tuple(a + b for a, b in zip(p, m)) for p in plus for m in minus}
        return [F.concat_ws(",", F.col("length") + longer, *(F.col(c) + s for c, s in zip(levels, step))) for step in sorted(steps)]

    stored = counts.select(key.alias("cell"), "word", "n")
    asking = counts.select(F.explode(F.array(*reached(0), *reached(1))).alias("cell"), "word", "n")
    large = stored.groupBy("cell").count().filter(F.col("count") > cell_words).select(
        "cell", F.ceil(F.col("count") / cell_words).cast("int").alias("shards"))
    one = F.coalesce("shards", F.lit(1))
    stored = stored.join(large, "cell", "left").withColumn("shard", F.pmod(F.xxhash64("word"), one).cast("int"))
    asking = asking.join(large, "cell", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), one - 1)))
    columns = ("cell", "shard", "word", "n")
    stored, asking = stored.select(*columns), asking.select(*(F.col(x).alias(x) for x in columns))
    number = {ord(c): i for i, g in enumerate(letters) for c in g}
    table = np.zeros(max(number, default=0) + 2, np.int64)
    for c, i in number.items():
        table[c] = i
    width = len(letters)

    def answer(mine: pa.Table, questions: pa.Table) -> pa.Table:
        own, asked = mine["word"].to_pylist(), questions["word"].to_pylist()
        ask, word, longer = near_pairs(own, asked, table, width) if own and asked else (np.zeros(0, int),) * 2 + (np.zeros(0, bool),)
        all_words = np.array([*own, *asked, ""], object)
        n = np.concatenate((mine["n"].to_numpy(), questions["n"].to_numpy(), [0])).astype(np.int64)
        ask = ask + len(own)
        # a longer word does not ask, so both sides of such a pair get it
        return _best(all_words, np.concatenate((ask, word[longer])), np.concatenate((word, ask[longer])), n)

    parts = stored.groupBy("cell", "shard").cogroup(asking.groupBy("cell", "shard")).applyInArrow(answer, _PART)
    best = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("neg_n", "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.neg_n")).alias("form_n"), "best.form")


def spelling_variants(words: DataFrame, factor: int = 2, groups: int = 12, cell_words: int = 1 << 15) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words: see the module's text."""
    words = checkpointed(words.select("word", "n"))
    near = near_words(words, groups, cell_words)
    takes = F.col("form_n") >= factor * F.col("n")
    found = checkpointed(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("form")).alias("form"),
        F.when(takes, F.col("form_n")).alias("form_n")))
    # a form is at least ``factor`` times as frequent, so chains end; each round doubles the step
    step = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = checkpointed(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                      F.col("next").isNotNull().alias("moved")))
        step = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            break
    return found.join(step, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
