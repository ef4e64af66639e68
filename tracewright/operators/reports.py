"""Report aggregations over the ledger, scans and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import IMPACT, band
from ..functions.text import rule_family
from ..session import materialise
from .ledger import CONFIRMED, STATUSES

c = F.col

# --- fixed values: families shown in the coverage report, in this order ---------
FAMILIES = {
    "FR-PERM": "Who may do what",
    "FR-SQLI": "Hand-written SQL",
    "FR-HOOK": "Event handlers",
    "FR-WKFL": "Document states",
    "FR-DATA": "Data consistency",
    "FR-INJ": "Injected input",
    "FR-CSRF": "Forged requests of a user",
    "FR-SSRF": "Forged requests of the server",
    "FR-PERF": "Slow patterns",
    "FR-I18N": "Translation",
}
REVIEW_MIN_ATTEMPTS, REVIEW_RATE = 5, 0.5
IMPACT_ORDER = tuple(IMPACT)


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def dimension(df: DataFrame, values, name: str, *more: str) -> DataFrame:
    """A fixed list of values as a table, with its order."""
    rows = [(i, v, *(m[i] for m in more)) for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, f"position int, {name} string")


def _confirmed():
    return F.count_if(c("status").isin(*CONFIRMED))


def _refuted():
    return F.count_if(c("status") == "false_positive")


def precision_by_rule(ledger: DataFrame) -> DataFrame:
    counted = (
        ledger.where(c("rule_id").isNotNull() & c("rule_version").isNotNull() & c("status").isNotNull())
        .groupBy("rule_id", "rule_version")
        .agg(_confirmed().alias("proven"), _refuted().alias("false_positives"))
    )
    return counted.withColumn("precision", ratio(c("proven"), c("proven") + c("false_positives")))


def fp_rates(ledger: DataFrame) -> DataFrame:
    """Share of refuted findings per rule and version, with the rules to be reviewed."""
    counted = (
        ledger.where(c("rule_id").isNotNull() & c("status").isNotNull())
        .groupBy("rule_id", F.coalesce("rule_version", F.lit("unknown")).alias("rule_version"))
        .agg((_confirmed() + _refuted()).alias("attempts"), _refuted().alias("refuted"))
        .where("attempts > 0")
    )
    rate = ratio(c("refuted"), c("attempts"))
    return counted.select(
        "rule_id", "rule_version", "attempts", rate.alias("fp_rate_exact"), F.bround(rate, 2).alias("fp_rate"),
        ((c("attempts") >= REVIEW_MIN_ATTEMPTS) & (rate > REVIEW_RATE)).alias("needs_logic_review"),
    )


def status_counts(ledger: DataFrame) -> DataFrame:
    counts = ledger.groupBy("status").agg(F.count("*").alias("n"))
    return dimension(ledger, STATUSES, "status").join(counts, ["status"], "left").select(
        "position", "status", F.coalesce("n", F.lit(0)).alias("n")
    )


def family_coverage(ledger: DataFrame) -> DataFrame:
    """Findings per family; a family counts every family name it is a prefix of."""
    return _covered(ledger.sparkSession, ledger.where(c("taxonomy_id").isNotNull()).groupBy(rule_family("taxonomy_id").alias("found")).agg(
        F.count("*").alias("n")))


def _covered(spark, counts: DataFrame) -> DataFrame:
    """(position, family, title, n) of all families; ``counts``: (found, n)."""
    families = spark.createDataFrame(
        [(i, k, v) for i, (k, v) in enumerate(FAMILIES.items())], "position int, family string, title string")
    # both sides are per-family totals (tens of rows); prefixes are exploded to keep an equi-join
    prefixes = counts.select("n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("found")), lambda k: F.left(c("found"), k))).alias("family"))
    return families.join(prefixes, ["family"], "left").groupBy("position", "family", "title").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def by_repo(ledger: DataFrame) -> DataFrame:
    """Candidates, proven, merged and refuted findings per repository."""
    return ledger.where(c("repo").isNotNull()).groupBy("repo").agg(
        *[F.count_if(c("status") == s).alias(s) for s in ("candidate", "proven", "merged", "false_positive")]
    )


def impact_distribution(ledger: DataFrame) -> DataFrame:
    counts = ledger.groupBy("impact_class").agg(F.count("*").alias("n"))
    return dimension(ledger, IMPACT_ORDER, "impact_class").join(counts, ["impact_class"])


def merged_upstream(ledger: DataFrame) -> DataFrame:
    return ledger.where((c("status") == "merged") & c("upstream_pr").isNotNull()).select("id", "upstream_pr")


def scan_list(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Every scan with its counts (0 for a scan without findings).

    Findings are counted per scan before the join, so a scan that holds most of the
    findings is combined map-side.
    """
    states = ("proven", "refuted", "skipped", "candidate")
    counts = findings.groupBy("scan_id").agg(
        F.count("*").alias("finding_count"), *[F.count_if(c("status") == s).alias(f"{s}_count") for s in states])
    names = ["finding_count", *[f"{s}_count" for s in states]]
    return scans.join(counts, ["scan_id"], "left").na.fill(0, names)


def scan_stats(findings: DataFrame, scan_id=None) -> DataFrame:
    rows = findings if scan_id is None else findings.where(c("scan_id") == scan_id)
    keys = ["scan_id"] if scan_id is None else []
    states = {"proven": "proven", "refuted": "refuted", "skipped": "skipped", "candidate": "candidate", "errors": "error"}
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"), *[F.count_if(c("status") == v).alias(k) for k, v in states.items()])


def latest_scan(scans: DataFrame) -> DataFrame:
    """The scan finished last, or the one started last when none is finished."""
    done = F.when(c("status") == "done", c("finished_at"))
    return scans.agg(
        F.max_by("scan_id", F.struct(done.alias("f"), "scan_id")).alias("by_finish"), F.max(done).alias("finished"),
        F.max_by("scan_id", F.struct("started_at", "scan_id")).alias("by_start"),
    ).select(F.when(c("finished").isNotNull(), c("by_finish")).otherwise(c("by_start")).alias("scan_id"))


def band_histogram(findings: DataFrame, score="score") -> DataFrame:
    return findings.groupBy(band(score).alias("band")).agg(F.count("*").alias("n"))


def proof_summary(findings: DataFrame) -> DataFrame:
    counts = findings.agg(
        F.count("*").alias("total"), *[F.count_if(c("status") == s).alias(n) for n, s in
                                       (("proven", "proven"), ("refuted", "refuted"), ("skipped", "skipped"), ("errors", "error"))])
    return counts.withColumn("proven_pct", F.coalesce(ratio(c("proven") * 100, c("total")), F.lit(0.0)))


CUBE = ("status", "rule", "family", "repo", "impact_class")
_COUNTED = ("candidate", "proven", "merged", "false_positive")


def report_cube(ledger: DataFrame) -> DataFrame:
    """All totals of the track record in one pass: (dimension, status, rule_id, rule_version, family, repo,
    impact_class, n, n_judged, confirmed, and a count for each of ``_COUNTED``).

    Grouping sets: every row is counted once for each dimension, and combined before the shuffle.
    """
    sets = (("status",), ("rule_id", "rule_version"), ("family",), ("repo",), ("impact_class",))
    columns = [x for names in sets for x in names]
    rows = ledger.select("status", "rule_id", "rule_version", rule_family("taxonomy_id").alias("family"), "repo", "impact_class", c("status").alias("_s"))
    # grouping_id has a bit for each column that a row is not grouped by
    full = (1 << len(columns)) - 1
    of = {full - sum(1 << (len(columns) - 1 - columns.index(x)) for x in names): name for names, name in zip(sets, CUBE)}
    dimension_of = F.lit(None)
    for number, name in of.items():
        dimension_of = F.when(c("_g") == number, name).otherwise(dimension_of)
    return rows.groupingSets([[c(x) for x in names] for names in sets], *[c(x) for x in columns]).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.count("_s").alias("n_judged"),
        F.count_if(c("_s").isin(*CONFIRMED)).alias("confirmed"), *[F.count_if(c("_s") == x).alias(x) for x in _COUNTED],
    ).select(dimension_of.alias("dimension"), *columns, "n", "n_judged", "confirmed", *_COUNTED)


def track_record(ledger: DataFrame) -> DataFrame:
    """The track record as lines of Markdown: (section, position, line), to be read in
    that order.  The ledger is read once for all totals, and once for the list of merged
    findings, which stays distributed until written."""
    spark = ledger.sparkSession
    cube = materialise(report_cube(ledger), "report-cube")
    of = lambda name: cube.where(c("dimension") == name)
    parts: list[DataFrame] = []

    def fixed(section: int, *lines: str) -> None:
        rows = [(section, f"{n:06d}", line) for n, line in enumerate(lines)]
        parts.append(spark.createDataFrame(rows, "section int, position string, line string"))

    def table(section: int, title: str, columns: list[str], rows: DataFrame, position: Column, *cells: Column) -> None:
        fixed(section, "", f"## {title}", "")
        rule = ["---", *["---:"] * (len(columns) - 1)]
        fixed(section + 1, f"| {' | '.join(columns)} |", f"| {' | '.join(rule)} |")
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell.cast("string") for cell in cells]), F.lit(" |"))
        parts.append(rows.select(F.lit(section + 2).alias("section"), position.cast("string").alias("position"), line.alias("line")))

    place = F.lpad(c("position").cast("string"), 3, "0")
    fixed(0, "# Track Record")
    states = dimension(ledger, STATUSES, "status").join(of("status").select("status", "n"), ["status"], "left").na.fill(0, ["n"])
    table(10, "Evidence Status", ["Status", "Count"], states, place, c("status"), c("n"))
    rules = of("rule").where("rule_id IS NOT NULL AND rule_version IS NOT NULL AND n_judged > 0")
    rate = ratio(c("confirmed"), c("confirmed") + c("false_positive"))
    precision = F.when(rate.isNull(), "N/A").otherwise(F.concat(F.bround(rate * 100).cast("int"), F.lit("%")))
    table(20, "Rule Precision", ["Rule", "Proven", "False Positives", "Precision"], rules,
          F.concat_ws("\u0001", "rule_id", "rule_version"), F.concat(c("rule_id"), F.lit(" v"), c("rule_version")), c("confirmed"), c("false_positive"), precision)
    table(30, "Rule Coverage", ["Family", "Category", "Findings"], _covered(spark, of("family").where("family IS NOT NULL").select(
        c("family").alias("found"), "n")), place, c("family"), c("title"), c("n"))
    repos = of("repo").where("repo IS NOT NULL")
    if repos.limit(2).count() > 1:
        table(40, "Per-Repo Breakdown", ["Repo", "Candidates", "Proven", "Merged", "FP"], repos, c("repo"),
              c("repo"), c("candidate"), c("proven"), c("merged"), c("false_positive"))
    impacts = dimension(ledger, IMPACT_ORDER, "impact_class").join(of("impact_class").select("impact_class", "n"), ["impact_class"])
    if not impacts.isEmpty():
        table(50, "Severity Distribution", ["Impact Class", "Count"], impacts, place, c("impact_class"), c("n"))
    fixed(60, "", "## Upstream History", "")
    merged = merged_upstream(ledger)
    if merged.isEmpty():
        fixed(61, "- No merged upstream records.")
    else:
        parts.append(merged.select(F.lit(61).alias("section"), c("id").alias("position"), F.concat(
            F.lit("- "), c("id"), F.lit(": merged upstream at "), c("upstream_pr")).alias("line")))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def in_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy("section", "position")
