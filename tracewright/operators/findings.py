"""From candidates to findings: ids, de-duplication, scoring, known-finding filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import severity
from ..functions.text import col, matches_any_glob, stable_hash

c = F.col


def finding_id(repo="repo", rule="rule_id", file="file", function="function", location="code_location_hash",
               taxonomy="taxonomy_id") -> Column:
    """Identity of a finding: stable when lines move, different per file."""
    identity = F.concat_ws(":", col(repo), col(rule), col(file), col(function), col(location))
    return F.concat_ws("-", col(taxonomy), stable_hash(identity))


def fingerprint(rule="rule_id", file="file", function="function", location="code_location_hash") -> Column:
    return stable_hash(F.concat_ws("|", col(rule), col(file), col(function), col(location)), 32)


def keep_last(df: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (without one, the greatest row).

    An aggregation rather than a window: rows of one key are combined before the
    shuffle, so many copies of one key never meet in a single task.
    """
    return _keep(df, key, order, F.max)


def keep_first(df: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    return _keep(df, key, order, F.min)


def _keep(df, key, order, pick):
    rest = [name for name in df.columns if name not in key]
    if not rest:
        return df.distinct()
    # a struct is never NULL, so rows with a NULL order take part; of equal orders the
    # rest of the row decides, so that the choice never depends on the order of arrival
    ranked = [c(order).alias("_order")] if order is not None else []
    kept = df.groupBy(*key).agg(pick(F.struct(*ranked, *rest)).alias("_row"))
    return kept.select(*key, "_row.*").select(*df.columns)


def deduplicate(candidates: DataFrame) -> DataFrame:
    return keep_last(candidates, ["repo", "rule_id", "file", "line", "code_location_hash"], "emit_ord")


def display_order() -> list[Column]:
    return [c("rule_id"), c("file"), c("line"), c("function")]


def by_severity() -> list[Column]:
    """Highest score first; ties stay in display order."""
    return [c("severity.score").desc(), *display_order()]


def score(candidates: DataFrame, guests: DataFrame, proof_tiers: DataFrame | None = None) -> DataFrame:
    """Add ``severity``.  ``guests``: (repo, function) of guest endpoints - matched by
    name, in any file; ``proof_tiers``: (rule_id, code_location_hash, tier) overrides."""
    named = guests.select("repo", "function").distinct().withColumn("_guest", F.lit(True))
    scored = candidates.join(named, ["repo", "function"], "left")
    tier = c("proof_tier")
    if proof_tiers is not None:
        scored = scored.join(
            keep_first(proof_tiers, ["rule_id", "code_location_hash"], "tier"),
            ["rule_id", "code_location_hash"], "left",
        )
        tier = F.coalesce("tier", "proof_tier")
    scored = scored.withColumn(
        "severity", severity("rule_id", "fix_confidence", F.coalesce("_guest", F.lit(False)), tier)
    )
    return scored.select(*candidates.columns, "severity")


# ---- known findings ---------------------------------------------------------------
FP_KEY = ["rule_id", "rule_version", "repo", "file", "function", "code_location_hash"]


def drop_false_positives(candidates: DataFrame, false_positives: DataFrame) -> DataFrame:
    return candidates.join(false_positives, FP_KEY, "left_anti")


def suppressed_ids(candidates: DataFrame, false_positives: DataFrame) -> DataFrame:
    """Ids of the log entries that suppress a candidate (one row per candidate)."""
    log = keep_last(false_positives.select(*FP_KEY, "finding_id"), FP_KEY, "finding_id")
    return candidates.select(*FP_KEY).join(log, FP_KEY).select("finding_id")


def drop_known(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """``baseline``: (fingerprint)."""
    return (
        candidates.withColumn("fingerprint", fingerprint())
        .join(baseline.select("fingerprint"), ["fingerprint"], "left_anti").drop("fingerprint")
    )


def only_changed(candidates: DataFrame, changed: DataFrame) -> DataFrame:
    """Candidates whose file is, or ends with, a changed path.

    ``changed``: (path), or (repo, path) where each repository has changes of its own.  Of
    a candidate's file only the suffixes as long as some changed path are listed (the
    lengths are few), which makes the suffix test an equi-join; no change, no row.
    """
    own = ["repo"] if "repo" in changed.columns else []
    lengths = sorted(r.n for r in changed.select(F.length("path").alias("n")).distinct().where("n IS NOT NULL").collect())
    possible = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("file"))
    suffixes = F.transform(possible, lambda n: F.right(c("file"), n))
    files = candidates.select(*own, "file").where("file <> ''").distinct().select(*own, "file", F.explode(suffixes).alias("path"))
    hit = files.join(changed.select(*own, "path").distinct(), [*own, "path"], "left_semi").select(*own, "file").distinct()
    return candidates.join(hit, [*own, "file"], "left_semi")


def exclude_paths(candidates: DataFrame, globs: list[str]) -> DataFrame:
    return candidates.where(~matches_any_glob("file", globs))


# ---- comments that silence a finding ------------------------------------------------
DIRECTIVE = "tracewright"


def silenced_on_line(candidates: DataFrame, lines: DataFrame, directive: str = DIRECTIVE) -> DataFrame:
    """Drop candidates whose own line says ``# <directive>:ignore [rules]``.

    ``lines``: (repo, file, line, text).  A listed rule matches as a substring of
    the rest of the line; nothing listed silences every rule.
    """
    marker = f"# {directive}:ignore"
    start = F.instr("text", marker)
    marked = lines.where(start > 0).select(
        "repo", "file", "line",
        F.regexp_replace(F.substr("text", start + F.lit(len(marker))), r"^\s+|\s+$", "").alias("_listed"),
    )
    joined = candidates.join(marked, ["repo", "file", "line"], "left")
    silent = (c("_listed") == "") | F.contains("_listed", "rule_id") | F.contains("_listed", "taxonomy_id")
    return joined.where(~F.coalesce(silent, F.lit(False))).select(*candidates.columns)


def directive_rules(text, directive: str = DIRECTIVE) -> Column:
    """Rule ids the comments of a line silence: NULL without a comment, [] for all."""
    # fixed values: the form of the comment
    pattern = rf"(?i)#\s*{directive}\s*:\s*ignore(?:\s+([A-Z0-9 ,\-]+))?"
    lists = F.regexp_extract_all(col(text), F.lit(pattern), 1)
    ids = F.flatten(F.transform(lists, lambda l: F.split(l, r"[\s,]+")))
    return (
        F.when(F.size(lists) == 0, F.lit(None))
        .when(F.exists(lists, lambda l: l == ""), F.array().cast("array<string>"))
        .otherwise(F.array_distinct(F.filter(ids, lambda r: r != "")))
    )


def silenced_nearby(candidates: DataFrame, lines: DataFrame, directive: str = DIRECTIVE) -> DataFrame:
    """Drop candidates silenced on their own or the preceding line (exact rule ids).

    Each commented line is joined under both line numbers it can silence, so the
    range condition is an equi-join.
    """
    marked = (
        lines.withColumn("_rules", directive_rules("text", directive)).where(c("_rules").isNotNull())
        .select("repo", "file", "_rules", F.explode(F.array(c("line"), c("line") + 1)).alias("line"))
    )
    per_line = marked.groupBy("repo", "file", "line").agg(
        F.max(F.size("_rules") == 0).alias("_all"), F.array_distinct(F.flatten(F.collect_set("_rules"))).alias("_ids")
    )
    joined = candidates.join(per_line, ["repo", "file", "line"], "left")
    silent = c("_all") | F.array_contains("_ids", c("rule_id")) | F.array_contains("_ids", c("taxonomy_id"))
    return joined.where(~F.coalesce(silent, F.lit(False))).select(*candidates.columns)
