"""What a findings list shows: search, filters, order, pages, selection, snippets."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import band
from ..functions.text import contains_text, line_number, python_lines
from ..session import materialise
from .findings import keep_first, keep_last

c = F.col
PAGE_SIZE = 25


def filtered(findings: DataFrame, *, text: str = "", status: str = "", severity: str = "", score="score") -> DataFrame:
    shown = findings
    if text:
        shown = shown.where(contains_text(text, "rule_id", "file", "function", "evidence"))
    if status:
        shown = shown.where(c("status") == status)
    if severity:
        shown = shown.where(band(score, zero_is_low=True) == severity)
    return shown


def sort_keys(by: str = "severity", descending: bool = True, score="score") -> list[Column]:
    """Order of the list; a location sorts by file and zero-padded line."""
    keys = {
        "severity": F.coalesce(c(score), F.lit(-1.0)),
        "location": F.concat_ws(":", "file", F.lpad(c("line").cast("string"), 10, "0")),
    }
    key = keys.get(by, F.coalesce(c(by).cast("string"), F.lit(""))) if by in keys else F.coalesce(
        c(by).cast("string"), F.lit(""))
    return [key.desc() if descending else key.asc()]


def top(findings: DataFrame, order: list[Column], k: int = 0) -> DataFrame:
    """The first ``k`` rows (0: all of them)."""
    ordered = findings.orderBy(*order)
    return ordered.limit(k) if k else ordered


def page(findings: DataFrame, order: list[Column], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page, 1-based; a number out of range is moved to the nearest page.  ``order`` must be total.

    For more than one page of a list keep what ``paged`` returns."""
    return paged(findings, order).page(number, size)


def paged(findings: DataFrame, order: list[Column]) -> Pages:
    """The list put in order once, for any number of pages.  ``order`` must be total."""
    return Pages(_in_ranges(findings, order))


@dataclass(frozen=True)
class Pages:
    """An ordered list, written in ranges, with the sizes of the ranges as its index: a page reads the
    range or ranges it lies in (Spark skips the files of the others) and sorts nothing but itself."""

    ranges: _Ranges

    @property
    def total(self) -> int:
        return self.ranges.total

    def count(self, size: int = PAGE_SIZE) -> int:
        return max(1, math.ceil(self.total / size))

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        first = (min(max(1, number), self.count(size)) - 1) * size
        before, wanted = 0, F.lit(False)
        for part, n in self.ranges.sizes:
            low, high = max(first - before, 0), min(first + size - before, n)  # places within this range
            if low < high:
                wanted = wanted | ((c("_part") == part) & c("_in").between(low + 1, high))
            before += n
        # a page is small: one task puts its rows in order
        return self.ranges.rows.where(wanted).coalesce(1).sortWithinPartitions("_part", "_in").drop("_part", "_in")


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Global 1-based row numbers without sorting everything in one task.

    Rows are range-partitioned and sorted, numbered within their range as they pass,
    and written; the number of rows in the ranges before is added on reading.  One
    shuffle, as many ranges as the session's shuffles have.  ``order`` must be total.
    """
    return _in_ranges(df, order).with_numbers(name)


@dataclass(frozen=True)
class _Ranges:
    rows: DataFrame
    sizes: list  # (range, rows), as many as there are ranges

    @property
    def total(self) -> int:
        return sum(n for _, n in self.sizes)

    def with_numbers(self, name: str) -> DataFrame:
        before, starts = 0, []
        for part, n in self.sizes:
            starts += [F.lit(part), F.lit(before)]
            before += n
        start = F.element_at(F.create_map(*starts), c("_part")) if starts else F.lit(0)
        return self.rows.withColumn(name, c("_in") + start).drop("_part", "_in")


def _in_ranges(df: DataFrame, order: list[Column]) -> _Ranges:
    # the id holds the range in its upper and the place within it in its lower 33 bits
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = materialise(placed.withColumns({
        "_part": F.shiftright("_id", 33), "_in": c("_id").bitwiseAND((1 << 33) - 1) + 1}).drop("_id"), "numbered")
    sizes = rows.groupBy("_part").agg(F.max("_in").alias("n")).collect()
    return _Ranges(rows, sorted((r["_part"], r.n) for r in sizes))


LOCATOR = ["file", "line", "rule_id", "function"]


def select(findings: DataFrame, ids: DataFrame | None = None, locators: DataFrame | None = None,
           order: str = "id") -> DataFrame:
    """Findings named by id or by location, each once (by id, else by location)."""
    text = {k: F.coalesce(c(k).cast("string"), F.lit("")) for k in LOCATOR}
    hits = []
    if ids is not None:
        wanted = ids.select("id").where("id IS NOT NULL AND id <> ''").distinct()
        hits.append(findings.join(wanted, ["id"], "left_semi"))
    if locators is not None:
        keyed = findings.withColumn("_locator", F.struct(*[v.alias(k) for k, v in text.items()]))
        spots = locators.select(F.struct(*[v.alias(k) for k, v in text.items()]).alias("_locator")).distinct()
        hits.append(keyed.join(spots, ["_locator"], "left_semi").drop("_locator"))
    chosen = hits[0].select(*findings.columns)
    for more in hits[1:]:
        chosen = chosen.unionByName(more.select(*findings.columns))
    own = F.when(F.coalesce("id", F.lit("")) != "", c("id")).otherwise(
        F.concat_ws("\u0001", F.lit("at"), *text.values()))
    return keep_first(chosen.withColumn("_key", own), ["_key"], order).drop("_key")


def source_lines(files: DataFrame, text="text") -> DataFrame:
    """(repo, file, line, text) of all lines of the files."""
    return files.select("repo", "file", F.posexplode(python_lines(text)).alias("_pos", "text")).select(
        "repo", "file", (c("_pos") + 1).alias("line"), "text")


def snippets(requests: DataFrame, files: DataFrame, before: int = 2, after: int = 3) -> DataFrame:
    """Lines around requested locations, the location itself flagged.

    ``requests``: (repo, file, line); ``files``: (repo, file, text).  A request wants a
    bounded list of line numbers, so it is an equi-join on the line; only requested
    files are split into lines.
    """
    before, after = max(0, before), max(0, after)
    target = line_number("line")
    wanted = (
        requests.select("repo", "file", target.alias("target")).where(c("target").isNotNull()).distinct()
        .withColumn("line", F.explode(F.sequence(F.greatest(F.lit(1), c("target") - before), c("target") + after)))
    )
    named = requests.select("repo", "file").distinct()
    lines = source_lines(files.join(named, ["repo", "file"], "left_semi"))
    return wanted.join(lines, ["repo", "file", "line"]).select(
        "repo", "file", "target", c("line").alias("num"), c("text").alias("code"), (c("line") == c("target")).alias("is_error"))


def proof_details(findings: DataFrame, proofs: DataFrame, order: str | None = None) -> DataFrame:
    """Each finding with its proof result, or a default when it was never run.

    Of several results of a finding the one with the greatest ``order`` counts.

    ``findings``: (finding_id, status, proof_status, proof_tier);
    ``proofs``: (finding_id, proof_status, proof_tier, exit_code, stdout, error_message).
    """
    p = keep_last(proofs, ["finding_id"], order).select(
        "finding_id", c("proof_status").alias("p_status"), c("proof_tier").alias("p_tier"), "exit_code", "stdout",
        "error_message", F.lit(True).alias("has_proof"))
    joined = findings.select(
        "finding_id", F.coalesce("proof_status", "status", F.lit("candidate")).alias("f_status"),
        F.coalesce("proof_tier", F.lit(0)).alias("f_tier")).join(p, ["finding_id"], "left")
    ran = F.coalesce("has_proof", F.lit(False))
    skipped = ran & (F.coalesce(c("p_status") == "skipped", F.lit(False)) | (
        c("exit_code").isNull() & (F.coalesce("stdout", F.lit("")) == "")))
    message = F.coalesce("error_message", F.lit(""))
    reason = (
        F.when(~ran & (c("f_status") == "candidate"), "not run")
        .when(skipped & F.contains(F.lower(message), F.lit("no bench configured")), "no server configured")
        .when(skipped & F.contains(F.lower(message), F.lit("no reproducer")), "no strategy for this rule")
        .when(skipped, F.when(message == "", "skipped").otherwise(message))
    )
    return joined.select(
        "finding_id", F.when(ran, c("p_status")).otherwise(c("f_status")).alias("proof_status"),
        F.when(ran, c("p_tier")).otherwise(c("f_tier")).alias("proof_tier"), "exit_code",
        F.coalesce("stdout", F.lit("")).alias("stdout"), reason.alias("skip_reason"))
