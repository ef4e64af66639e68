"""Operator 4: language identification by interpolated Kneser-Ney character models.

One model per language is trained on a bounded sample of labelled rows (distinct whole texts,
in the order of a text hash, up to ``train_chars`` characters over all languages and one
text more for each), so the models have a bounded size and are broadcast.  A model is a sorted
array of n-gram hashes with log probabilities and back-off weights; the arrays of all
languages share one index.  A text gets the language of the lowest cross-entropy per
character.  It is rejected when that exceeds what all labelled rows of the language outside
the training sample show (a quantile plus a margin that shrinks with the length); a
language without such a row gets the quantile over those of all others.

Texts are read as letters in lower case, with one space for anything else.  A null text,
or one without a letter, gets ``und``, score 0, and is rejected.  Without any labelled
row every text gets ``und``.  Labels that are null teach nothing.  Equal rows get equal
results; ties go to the first language by code point.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import U, flat, parts, window_hashes

UNKNOWN = "und"
_SPACE = 0x20
_PREFIX_BITS = 16
#: one of so many sampled texts helps to set the limit of rejection instead of teaching
CALIBRATING = 5


@cache
def _letters() -> np.ndarray:
    """Code point -> its small letter, or a space."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def normalised(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, each text after one space; offsets; letters per text."""
    data, offsets = flat(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    cuts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    if cuts[-1] != len(points):  # bytes that are not UTF-8: decode text by text
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        cuts = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    low = _letters()[points]
    low = np.insert(low, cuts[:-1], _SPACE)
    cuts = cuts + np.arange(len(cuts))
    space = low == _SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[cuts[:-1]] = True
    letters = np.concatenate(([0], np.cumsum(~space)))
    kept = np.concatenate(([0], np.cumsum(keep)))
    return low[keep], kept[cuts], letters[cuts[1:]] - letters[cuts[:-1]]


def _grams(chars: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters up to each position; positions too near their text's
    start hold hashes that no caller reads."""
    out = np.zeros(len(chars), U)
    if len(chars) >= n:
        out[n - 1:] = window_hashes(chars.astype(U) + U(1), n)
    return out


MODEL = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("n", T.IntegerType()),
    *(T.StructField(x, T.BinaryType()) for x in ("gram", "context", "suffix", "count"))])


def _count(order: int):
    def count(table: pa.Table) -> pa.Table:
        chars, offsets, _ = normalised(table["text"])
        depth = np.arange(len(chars)) - np.repeat(offsets[:-1], np.diff(offsets)) + 1
        rows, shorter = [], None
        for n in range(1, order + 1):
            own = _grams(chars, offsets, n)
            at = np.flatnonzero((depth >= n) & (depth > 1))  # the space before a text is given
            gram, first, count = np.unique(own[at], return_index=True, return_counts=True)
            where = at[first]
            context = shorter[where - 1] if n > 1 else np.zeros(len(gram), U)
            suffix = shorter[where] if n > 1 else np.zeros(len(gram), U)
            rows.append({"lang": table["lang"][0].as_py(), "n": n, "gram": gram.tobytes(), "context": context.tobytes(),
                         "suffix": suffix.tobytes(), "count": count.astype(np.int64).tobytes()})
            shorter = own
        return pa.Table.from_pylist(rows, schema=pa.schema([
            ("lang", pa.string()), ("n", pa.int32()), ("gram", pa.binary()), ("context", pa.binary()),
            ("suffix", pa.binary()), ("count", pa.binary())]))
    return count


class Level:
    """N-grams of one order over all languages: sorted hashes, a directory on their upper
    bits, log probabilities, and back-off weights of the n-grams as contexts."""

    def __init__(self, grams: np.ndarray, n_langs: int):
        self.grams = grams
        self.logp = np.zeros((len(grams), n_langs), np.float32)
        self.backoff = np.zeros((len(grams), n_langs), np.float32)
        self.directory = np.searchsorted(grams, np.arange(1 << _PREFIX_BITS, dtype=U) << U(64 - _PREFIX_BITS)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.grams):
            return out
        at = self.directory[(hashes >> U(64 - _PREFIX_BITS)).astype(np.int64)].astype(np.int64)
        open_, wanted = np.arange(len(hashes)), hashes
        while len(open_):
            inside = at < len(self.grams)
            seen = self.grams[np.minimum(at, len(self.grams) - 1)]
            hit = inside & (seen == wanted)
            out[open_[hit]] = at[hit]
            more = inside & (seen < wanted)
            open_, wanted, at = open_[more], wanted[more], at[more] + 1
        return out


class Models:
    def __init__(self, rows: list, order: int):
        self.langs = sorted({r["lang"] for r in rows}, key=str.encode)
        self.order, self.limits = order, np.full(len(self.langs), np.inf)
        known = {(r["lang"], r["n"]): [np.frombuffer(r[x], U) for x in ("gram", "context", "suffix")]
                 + [np.frombuffer(r["count"], np.int64)] for r in rows}
        self.levels: list[Level] = []
        union = [np.unique(np.concatenate([known[lang, n][0] for lang in self.langs])) for n in range(1, order + 1)]
        size = len(union[0]) + 1  # characters, and one for all others
        self.unseen = np.zeros(len(self.langs), np.float32)
        for n in range(1, order + 1):
            level = Level(union[n - 1], len(self.langs))
            context, suffix = np.zeros(len(level.grams), U), np.zeros(len(level.grams), U)
            for lang in self.langs:
                at = level.find(known[lang, n][0])
                context[at], suffix[at] = known[lang, n][1], known[lang, n][2]
            for k, lang in enumerate(self.langs):
                gram, own_context, _, count = known[lang, n]
                if n < order:  # continuation counts: different characters seen before it
                    before, count = np.unique(known[lang, n + 1][2], return_counts=True)
                    place = np.searchsorted(gram, before)
                    full = np.zeros(len(gram), np.int64)
                    full[place] = count
                    count = np.maximum(full, 1)
                ones, twos = int((count == 1).sum()), int((count == 2).sum())
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                at = level.find(gram)
                if n == 1:
                    total = count.sum()
                    rest = discount * len(gram) / total / size
                    p = np.full(len(level.grams), rest)
                    p[at] += (count - discount) / total
                    self.unseen[k] = np.log(rest)
                else:
                    below = self.levels[-1]
                    names, which, kinds = np.unique(own_context, return_inverse=True, return_counts=True)
                    totals = np.bincount(which, weights=count)
                    below.backoff[below.find(names), k] = np.log(discount * kinds / totals)
                    lower = below.find(suffix)
                    p = np.exp(below.backoff[below.find(context), k] + below.logp[lower, k], dtype=np.float64)
                    p[at] += (count - discount) / totals[which]
                level.logp[:, k] = np.log(p)
            self.levels.append(level)

    def entropies(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text under each language, and letters of each text."""
        chars, offsets, letters = normalised(column)
        depth = np.minimum(np.arange(len(chars)) - np.repeat(offsets[:-1], np.diff(offsets)) + 1, self.order)
        grams = [_grams(chars, offsets, n) for n in range(1, self.order + 1)]
        value = np.zeros((len(chars), len(self.langs)), np.float32)
        open_ = np.flatnonzero(depth > 1)
        for n in range(self.order, 0, -1):
            mine = open_[depth[open_] >= n]
            at = self.levels[n - 1].find(grams[n - 1][mine])
            hit = at >= 0
            value[mine[hit]] += self.levels[n - 1].logp[at[hit]]
            missed = mine[~hit]
            if n == 1:
                value[missed] += self.unseen
            else:
                context = self.levels[n - 2].find(grams[n - 2][missed - 1])
                known = context >= 0
                value[missed[known]] += self.levels[n - 2].backoff[context[known]]
            open_ = np.concatenate([open_[depth[open_] < n], missed])
        sums = np.add.reduceat(value, offsets[:-1], axis=0, dtype=np.float64) if len(offsets) > 1 else value[:0]
        return -sums / np.maximum(np.diff(offsets) - 1, 1)[:, None], letters


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that teach nothing: crc32 of the id as text, modulo 3, is 1 (null as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _labelled(df: DataFrame, text_col: str, lang_col: str, teach: Column) -> DataFrame:
    """(lang, text, order) of the labelled rows that hold a letter; order is random, equal for
    equal texts."""
    text = F.col(text_col).cast("string")
    return df.filter(teach & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("order"))


def _taught(rows: DataFrame, train_chars: int, order: int) -> Column:
    """Which of the labelled rows teach: those of the first distinct texts of each language in
    their order, up to its share of ``train_chars`` and one text more, without one in
    ``CALIBRATING``.  The first text that holds an n-gram always teaches, the first other
    one never does.  The condition needs a few numbers per language only."""
    from .exchange import checkpointed

    # a letter and as many more characters, after one space, as an n-gram needs
    whole = F.col("text").rlike(r"\p{L}(?:\p{L}|\P{L}++){%d}" % max(order - 2, 0))
    unit = F.greatest(F.col("order") / F.lit(float(1 << 64)) + 0.5, F.lit(2.0 ** -60))
    # distinct texts by their hashes; a level holds the first 2**level of all hashes
    texts = checkpointed(rows.select("lang", "order", F.length("text").alias("n"), whole.alias("whole")).groupBy("lang", "order").agg(
        F.max("n").alias("n"), F.max("whole").alias("whole")).withColumn("level", F.ceil(F.log2(unit)).cast("int")))
    levels: dict[str, list] = {}
    for r in texts.groupBy("lang", "level").agg(
            F.sum("n").alias("n"), F.min("order").alias("least"), F.min(F.when(F.col("whole"), F.col("order"))).alias("whole")).collect():
        levels.setdefault(r.lang, []).append(r)
    if not levels:
        return F.lit(False)
    bound = train_chars / len(levels)
    reach, first = {}, {}
    for lang, found in levels.items():
        found.sort(key=lambda r: r.level)
        chars = 0
        for r in found:
            reach[lang], chars = r.level, chars + r.n
            if chars >= bound:
                break
        first[lang] = min((r.whole for r in found if r.whole is not None), default=min(r.least for r in found))

    def of(values: dict) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("lang"))

    # about twice the bound is ranked
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
    near = texts.filter(F.col("level") <= of(reach)).withColumn("before", F.coalesce(before, F.lit(0)))
    last, second = {}, {}
    for r in near.filter(F.col("before") < F.lit(bound)).groupBy("lang").agg(
            F.max("order").alias("last"), F.min(F.when(F.col("order") != of(first), F.col("order"))).alias("second")).collect():
        last[r.lang], second[r.lang] = r.last, first[r.lang] if r.second is None else r.second
    sampled = (F.col("order") <= of(last)) & (F.col("order") != of(second)) & (F.pmod("order", F.lit(CALIBRATING)) > 0)
    return (F.col("order") == of(first)) | F.coalesce(sampled, F.lit(False))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", teach: Column | None = None, order: int = 5,
          train_chars: int = 4_000_000, quantile: float = 0.999, margin: float = 1.0) -> Models | None:
    """Models of all labels that the rows chosen by ``teach`` hold; None without any."""
    from .exchange import checkpointed

    labelled = _labelled(df, text_col, lang_col, F.lit(True) if teach is None else teach)
    taught = _taught(labelled, train_chars, order)
    sample = labelled.filter(taught).groupBy("lang", "order").agg(F.min("text").alias("text"))
    rows = sample.select("lang", F.col("text").cast("binary").alias("text")).groupBy("lang").applyInArrow(
        _count(order), MODEL).toArrow().to_pylist()
    rows = [r for r in rows if r["n"] <= order]
    usable = {r["lang"] for r in rows if r["n"] == order and r["gram"]}
    rows = [r for r in rows if r["lang"] in usable]
    if not rows:
        return None
    models = Models(rows, order)
    shared = df.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = {x: i for i, x in enumerate(shared.value.langs)}
        for batch in batches:
            for part in parts(batch, "text", 1 << 18):
                nats, letters = shared.value.entropies(part.column("text"))
                own = np.array([langs.get(x, -1) for x in part.column("lang").to_pylist()])
                ok = (own >= 0) & (letters > 0)
                at = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(pa.array(at)), pa.array(nats[at, own[at]] - margin_of(letters[at]))], ["lang", "nats"])

    seen = checkpointed(labelled.filter(~taught).select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(
        measure, "lang string, nats double"))
    limits = _quantiles(seen, quantile)
    if limits:  # a language that shows nothing gets the limit of all the others together
        pooled = limits if len(limits) == len(models.langs) else _quantiles(seen.withColumn("lang", F.lit("")), quantile)
        models.limits = np.array([limits.get(x, pooled.get("")) for x in models.langs], float) + margin
    return models


def _quantiles(seen: DataFrame, quantile: float) -> dict[str, float]:
    """Exact quantile of ``nats`` for each ``lang``, as ``percentile`` gives it, from all rows: their
    counts in narrow bins show in which bins it lies, and only the values there are ranked."""
    binned = seen.withColumn("bin", F.floor(F.col("nats") * 256))
    counts: dict[str, list] = {}
    for r in binned.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.lang, []).append((r.bin, r.n))
    wanted, places = [], {}
    for lang, bins in counts.items():
        bins.sort()
        names, ends = np.array([x for x, _ in bins]), np.cumsum([n for _, n in bins])
        place = quantile * (int(ends[-1]) - 1)
        low, high = int(np.floor(place)), int(np.ceil(place))
        a, b = np.searchsorted(ends, [low, high], "right")
        before = int(ends[a - 1]) if a else 0
        places[lang] = low - before, high - before, place - low
        wanted.append((F.col("lang") == lang) & F.col("bin").isin(int(names[a]), int(names[b])))
    if not wanted:
        return {}
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("nats").rowsBetween(Window.unboundedPreceding, 0))
    ranked = binned.filter(_any(wanted)).groupBy("lang", "nats").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    at = [(F.col("lang") == lang) & ((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)) for lang, p in places.items() for k in p[:2]]
    values: dict[str, list] = {}
    for r in ranked.filter(_any(at)).select("lang", "nats").collect():
        values.setdefault(r.lang, []).append(r.nats)
    return {lang: min(v) + places[lang][2] * (max(v) - min(v)) for lang, v in values.items()}


def _any(conditions: list[Column]) -> Column:
    """Balanced, so that many conditions make no deep tree."""
    while len(conditions) > 1:
        conditions = [a | b for a, b in zip(conditions[::2], conditions[1::2])] + conditions[len(conditions) // 2 * 2:]
    return conditions[0]


def margin_of(letters: np.ndarray) -> np.ndarray:
    """Nats that short texts may exceed a limit by."""
    return 4.0 / np.sqrt(np.maximum(letters, 1))


def identify(df: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text",
             with_text: bool = False) -> DataFrame:
    """(id, lang_pred, score, nats, rejected[, text]): score is the share of the chosen language
    among all, for the average of up to 20 characters."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    out = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("nats", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()), *[T.StructField(text_col, T.BinaryType())] * with_text])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for part in parts(batch, "text", 1 << 18):
                if models is None:
                    n = part.num_rows
                    pred, score, best, bad = [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
                    none = np.ones(n, bool)
                else:
                    nats, letters = models.entropies(part.column("text"))
                    choice = nats.argmin(axis=1)
                    best = nats[np.arange(len(nats)), choice]
                    weight = np.exp((best[:, None] - nats) * np.minimum(letters, 20)[:, None])
                    none = letters == 0
                    bad = none | (best > models.limits[choice] + margin_of(letters))
                    score = np.where(none, 0.0, 1 / weight.sum(axis=1))
                    pred = [UNKNOWN if x else models.langs[i] for x, i in zip(none.tolist(), choice.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                     pa.array(best, pa.float64(), mask=none), pa.array(bad), *[part.column("text")] * with_text],
                    names=[f.name for f in out.fields])

    found = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(predict, out)
    return found.withColumn(text_col, F.col(text_col).cast("string")) if with_text else found
