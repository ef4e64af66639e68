"""Which names a text mentions, without comparing every text with every name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_identifier, identifiers

c = F.col


def candidate_mentions(texts: DataFrame, names: DataFrame, key: list[str], text: str, name: str, on: list[str],
                       prefix: str = "") -> DataFrame:
    """Texts joined with the names they may mention.

    A name that occurs as a whole word starts with a whole identifier of the text, so
    the join key is that identifier (lower case) instead of a pattern.  Words travel with
    the text's ``key`` only; a text is fetched once for each name found.  Names must start
    with an identifier.  ``prefix``: lower-case start all names share, if any.
    """
    words = F.array_distinct(F.transform(identifiers(text), F.lower))
    if prefix:
        words = F.filter(words, lambda w: w.startswith(prefix))
    keyed = names.withColumn("_word", F.lower(first_identifier(name)))
    found = texts.select(*on, *key, F.explode(words).alias("_word")).join(keyed, [*on, "_word"]).drop("_word")
    return texts.join(found, [*on, *key])


_WORD = "[a-z0-9_]+"


def _keys(parts):
    """Identifiers of a text and pairs of neighbours with what stands between, lower case.

    ``parts`` are identifiers and separators in turn, and begin with an identifier.
    """
    pair = F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: F.concat(a, b))
    pair = F.zip_with(pair, F.slice(parts, F.lit(3), F.size(parts)), lambda a, b: F.concat(a, b))
    word = lambda x: x.rlike(f"^{_WORD}")
    return F.array_distinct(F.filter(F.concat(parts, pair), lambda x: x.isNotNull() & word(x)))


_TOKEN = f"{_WORD}|[^a-z0-9_]+"


def mentions(texts: DataFrame, names: DataFrame, key: list[str], text: str, name: str, on: list[str]) -> DataFrame:
    """(key, on, name) where the text mentions the name: case ignored, word boundaries,
    backticks allowed.  ``key`` identifies a text, and names are distinct and not empty.

    A text is cut into words and what stands between them once, and these travel without it,
    so a long text does not multiply itself.  Names of one or two identifiers are decided by one
    join.  Any other name is found by its tokens (``_by_tokens``), whatever it begins or ends
    with; no text is fetched or searched again.
    """
    # exploding a list of one keeps the optimizer from cutting the text anew for each use
    cut = texts.select(*key, *on, F.explode(F.array(F.regexp_extract_all(
        F.lower(c(text)), F.lit(f"{_WORD}|(?<=[a-z0-9_])[^a-z0-9_]+"), 0))).alias("_parts"))
    words = cut.select(*key, *on, F.explode(_keys(c("_parts"))).alias("_word"))
    low = F.lower(c(name))
    start = F.regexp_extract(low, f"^{_WORD}(?:[^a-z0-9_]+{_WORD})?", 0)
    keyed = names.select(*on, name, start.alias("_word"), (start == low).alias("_whole"))
    pairs = words.join(keyed.where("_whole").drop("_whole"), [*on, "_word"]).select(*key, *on, name)
    other = keyed.where("NOT _whole").select(*on, name)
    if other.isEmpty():
        return pairs
    return pairs.unionByName(_by_tokens(texts, other, key, text, name, on))


def _by_tokens(texts: DataFrame, names: DataFrame, key: list[str], text: str, name: str, on: list[str]) -> DataFrame:
    """Names of any form, found as sequences of tokens (identifiers, and what stands between them).

    A name is the tokens from its first to its last identifier, and what it begins and ends with besides.
    These tokens must be tokens of the text; a beginning must end the token before them, an end
    must begin the one after, and neither may touch another identifier.  An identifier of the text meets the names
    that start with it first (a row for each such identifier, with the lengths of its names), and
    only then gets the longer sequences that these names have.
    """
    word = lambda x: x.rlike(f"^{_WORD}")
    tokens = names.select(*on, name, F.regexp_extract_all(F.lower(c(name)), F.lit(_TOKEN), 0).alias("_t"))
    lead = F.when(~word(F.get("_t", F.lit(0))), F.get("_t", F.lit(0))).otherwise("")
    trail = F.when(~word(F.element_at("_t", -1)) & (F.size("_t") > 1), F.element_at("_t", -1)).otherwise("")
    shaped = tokens.withColumns({"_lead": lead, "_trail": trail}).withColumn(
        "_core", F.slice("_t", F.when(c("_lead") == "", 1).otherwise(2),
                         F.size("_t") - F.when(c("_lead") == "", 0).otherwise(1) - F.when(c("_trail") == "", 0).otherwise(1)))
    shaped = shaped.withColumn("_n", F.size("_core")).drop("_t")
    # the tokens of a text with their number of successors that the longest name needs
    longest = shaped.agg(F.max("_n").alias("n")).first().n
    cut = texts.select(*key, *on, F.explode(F.array(F.regexp_extract_all(F.lower(c(text)), F.lit(_TOKEN), 0))).alias("_p"))
    place = F.sequence(F.lit(1), F.size("_p"))

    def window(i):
        return F.struct(
            F.element_at("_p", i).alias("word"), F.slice("_p", i, longest + 2).alias("from_here"),
            F.when(i > 1, F.get("_p", i - 2)).otherwise("").alias("before"), (i <= 2).alias("first"))

    found = []
    with_core = shaped.where("_n > 0")
    windows = F.filter(F.transform(place, window), lambda w: word(w["word"]))
    heads = with_core.groupBy(*on, c("_core")[0].alias("_word")).agg(F.collect_set("_n").alias("_lengths"))  # numbers up to the longest
    here = cut.where(F.size("_p") > 0).select(*key, *on, F.explode(F.array_distinct(windows)).alias("_w")).select(
        *key, *on, "_w", c("_w.word").alias("_word"))
    there = here.join(heads, [*on, "_word"]).select(*key, *on, "_w", F.explode("_lengths").alias("_n")).where(
        F.size("_w.from_here") >= c("_n")).withColumn("_path", F.array_join(F.slice("_w.from_here", F.lit(1), c("_n")), ""))
    named = with_core.select(*on, name, "_lead", "_trail", "_n", F.array_join("_core", "").alias("_path"))
    after = F.coalesce(F.get("_w.from_here", c("_n")), F.lit(""))
    ends = F.size("_w.from_here") <= c("_n") + 1
    fits = lambda side, own, at_edge, touches: (own == "") | touches & ((F.length(side) > F.length(own)) | at_edge)
    hit = there.join(named, [*on, "_n", "_path"]).where(
        fits(c("_w.before"), c("_lead"), c("_w.first"), c("_w.before").endswith(c("_lead")))
        & fits(after, c("_trail"), ends, after.startswith(c("_trail"))))
    found.append(hit.select(*key, *on, name).distinct())
    # names without an identifier: within what stands between two identifiers
    bare = shaped.where("_n = 0").select(*on, name, c("_lead").alias("_bare"))
    if not bare.isEmpty():
        most = bare.agg(F.max(F.length("_bare")).alias("n")).first().n
        between = F.filter(F.transform(place, lambda i: F.struct(F.element_at("_p", i).alias("t"), (i == 1).alias("first"), (i == F.size("_p")).alias("last"))),
                           lambda x: ~word(x["t"]))
        rows = cut.where(F.size("_p") > 0).select(*key, *on, F.explode(F.array_distinct(between)).alias("_x"))
        low, high = F.when(c("_x.first"), 1).otherwise(2), F.length("_x.t") - F.when(c("_x.last"), 0).otherwise(1)
        starts = rows.select(*key, *on, "_x", high.alias("_high"), F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array())).alias("_i"))
        pieces = starts.select(*key, *on, F.explode(F.transform(
            F.sequence(F.lit(1), F.least(F.lit(most), c("_high") - c("_i") + 1)), lambda n: F.substring(c("_x.t"), c("_i"), n))).alias("_bare"))
        found.append(pieces.distinct().join(bare, [*on, "_bare"]).select(*key, *on, name))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def exact_mentions(texts: DataFrame, names: DataFrame, key: list[str], text: str, name: str, on: list[str]) -> DataFrame:
    """(key, on, name) where the name is one whole identifier of the text, same case."""
    words = texts.select(*key, *on, F.explode(identifiers(text)).alias(name))
    return words.join(names.select(*on, name), [*on, name], "left_semi")
