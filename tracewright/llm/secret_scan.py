"""Operator 8: secrets in texts, told apart by how widely they are copied.

Patterns find candidates with their places.  The hashes of the candidates' values are counted
over the corpus by distinct repositories and owners.  A value that several owners hold is an
example that was copied; a value that one owner holds and that looks random is a live
credential.  Besides the base kinds (``assign``, ``access``, ``hex``) there is ``owned``: tokens
of capital and small letters and digits, as keys have them, which overlap no base span,
look random, and stay with one owner.

Everything is DataFrame operations.  A text's matches of a kind come from one regular
expression that also takes the text before each match, so running sums of lengths give the places;
``\\G`` makes each match start where the last one ended, so a text is read once.

Null or empty text: no spans.  Places are code points, ends exclusive.  A null repository
or owner counts as one more.  Equal rows are documents of their own, of one owner.  Ids may
be null or equal.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import checkpointed

# ---- fixed values: the base patterns, the group that holds the value, its least length ----
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"([0-9a-f]+)", 24),
)
# ---- end of fixed values -------------------------------------------------------------------
#: found faster, and by every text in which the kind occurs
HINTS = {"assign": r"(?i:passw(?:or)?d|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}",
         "owned": "[A-Za-z0-9_-]{24}"}
#: the same matches but for those whose value is too short: both are maximal runs of a class of
#: characters from their first possible start, so a short one hides no other
RUNS = {"access": "(AKIA[A-Z0-9]{16,})", "hex": "([0-9a-f]{24,})"}
OWNED = ("owned", r"([A-Za-z0-9_-]{24,})", 24)
KINDS = [k for k, *_ in BASE] + ["owned"]


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<before, found, value>>: of each match the code points since the match before it,
    its own, and its value."""
    whole = F.lit(r"(?s)\G(.*?)(" + RUNS.get(kind, pattern) + ")")
    before, found, value = (F.regexp_extract_all(text, whole, F.lit(i)) for i in (1, 2, 3))
    rows = F.transform(F.arrays_zip(before.alias("before"), found.alias("found"), value.alias("value")), lambda x: F.struct(
        F.length(x["before"]).alias("before"), F.length(x["found"]).alias("found"), x["value"].alias("value")))
    none = F.array().cast("array<struct<before:int,found:int,value:string>>")
    return F.when(text.rlike(HINTS[kind]), rows).otherwise(none)


def _random_looking(value: Column) -> Column:
    """Capital and small letters and digits, at least a third of the characters distinct."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]") & (distinct * 3 >= F.length(value))


def find_matches(df: DataFrame, id_col: str, text_col: str, repository: Column, owner: Column) -> DataFrame:
    """(row, id, repository, owner, matches): matches of all kinds in the order of kind and place."""
    read = df.select(F.col(id_col).alias("id"), repository.cast("string").alias("repository"),
                     owner.cast("string").alias("owner"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def tagged(nr: int, kind: str, pattern: str, least: int) -> Column:
        return F.transform(_matches(F.col("text"), kind, pattern), lambda x, i: F.struct(
            F.lit(nr).alias("nr"), i.alias("at"), x["before"].alias("before"), x["found"].alias("found"),
            (F.length(x["value"]) >= least).alias("fits"), F.xxhash64(x["value"]).alias("hash"),
            _random_looking(x["value"]).alias("random")))

    return read.select(F.monotonically_increasing_id().alias("row"), "id", "repository", "owner",
                       F.concat(*(tagged(i, *kind) for i, kind in enumerate((*BASE, OWNED)))).alias("matches"))


def place_candidates(found: DataFrame) -> DataFrame:
    """(row, repository, owner, nr, start, end, hash, random), a row per candidate.

    Running sums and extremes over a text's matches, each in one sort: a text of many matches
    takes time by their number, not by its square."""
    by_kind = Window.partitionBy("row", "nr").orderBy("at")
    up = Window.partitionBy("row").orderBy("start", "nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("nr")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.col("nr") < len(BASE)
    # one shuffle by text serves all three windows
    placed = (found.select("row", "repository", "owner", F.inline("matches")).repartition("row")
              .withColumn("end", F.sum(F.col("before") + F.col("found")).over(by_kind).cast("int"))
              .withColumn("start", F.col("end") - F.col("found")).filter("fits"))
    # base spans that begin at or before a token (of equal starts base spans come first), and after it
    judged = placed.withColumns({"last_end": F.max(F.when(base, F.col("end"))).over(up),
                                 "next_start": F.min(F.when(base, F.col("start"))).over(down)})
    overlap = F.coalesce(F.col("last_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next_start") < F.col("end"), F.lit(False))
    shaped = F.array(*(F.lit(kind in ("access", "hex")) for kind in KINDS))[F.col("nr")]
    return judged.filter(base | (~overlap & F.col("random"))).select(
        "row", "repository", "owner", "nr", "start", "end", "hash", (F.col("random") | shaped).alias("random"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, repositories, owners): counted in two steps, so that a value that all hold
    is one row per repository before it meets itself."""
    each = candidates.groupBy("hash", "repository", "owner").agg(F.lit(1).alias("one"))
    return each.groupBy("hash").agg(
        (F.count_distinct("repository") + F.max(F.col("repository").isNull().cast("int"))).alias("repositories"),
        (F.count_distinct("owner") + F.max(F.col("owner").isNull().cast("int"))).alias("owners"))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None,
                 owner: Column | None = None, max_owners: int = 1, max_repositories: int | None = None) -> DataFrame:
    """(id, spans): spans are structs of kind, start, end, repositories, owners and
    verdict (``live``, ``example`` or ``plain``), by start, then kind.

    ``live``: at most ``max_owners`` owners and ``max_repositories`` repositories (None: any number, as
    one owner may use one credential in all of its own), and random to look at; ``example``: more."""
    found = checkpointed(find_matches(
        df, id_col, text_col, F.lit(None) if repository is None else repository, F.lit(None) if owner is None else owner))
    candidates = checkpointed(place_candidates(found))
    widely = F.col("owners") > max_owners
    if max_repositories is not None:
        widely |= F.col("repositories") > max_repositories
    verdict = F.when(widely, "example").when(F.col("random"), "live").otherwise("plain")
    kind = F.array(*map(F.lit, KINDS))[F.col("nr")]
    judged = candidates.join(ownership(candidates), "hash").withColumn("verdict", verdict).filter(
        (F.col("nr") < len(BASE)) | (F.col("verdict") == "live"))
    ordered = F.array_sort(F.collect_list(F.struct(
        "start", "nr", kind.alias("kind"), "end", "repositories", "owners", "verdict")))
    spans = judged.groupBy("row").agg(F.transform(ordered, lambda x: F.struct(
        *(x[c].alias(c) for c in ("kind", "start", "end", "repositories", "owners", "verdict")))).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return found.select("row", "id").join(spans, "row", "left").select(
        F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))
