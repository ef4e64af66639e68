"""The findings ledger: inserts, proof results, constraints, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import keep_first, keep_last

c = F.col

# --- fixed values: ledger vocabulary -------------------------------------------
STATUSES = ("candidate", "proven", "merged", "patched", "false_positive", "regressed")
CONFIRMED = ("proven", "merged", "patched", "regressed")
REQUIRED = ("id", "taxonomy_id", "rule_id", "rule_version", "repo", "file", "function",
            "status", "proof_tier", "code_location_hash", "discovered")
RESULT_STATUS = {"passed": "proven", "failed": "false_positive"}


def ledger_rows(findings: DataFrame, today: str) -> DataFrame:
    """New ledger rows of scored findings."""
    dims = c("severity.dims")
    history = F.array().cast("array<struct<date:string,status:string,proof_tier:int,reproducer_hash:string>>")
    return findings.select(
        "id", "taxonomy_id", "rule_id", "rule_version", "repo", "file", "function",
        F.lit("candidate").alias("status"), F.lit(0).alias("proof_tier"),
        F.coalesce(dims["privilege_required"], F.lit("unknown")).alias("privilege_required"),
        F.coalesce(dims["allow_guest"], F.lit(False)).alias("allow_guest"),
        F.coalesce(dims["impact_class"], F.lit("unknown")).alias("impact_class"),
        F.coalesce(dims["blast_radius"], F.lit("unknown")).alias("blast_radius"),
        "code_location_hash", F.lit(today).alias("discovered"), F.lit(None).cast("string").alias("proven"),
        F.concat(c("evidence"), F.lit(" Proof recipe: "), c("proof_recipe")).alias("notes"),
        F.lit(None).cast("string").alias("reproducer_hash"), F.lit(None).cast("string").alias("upstream_pr"),
        history.alias("status_history"),
    )


def insert_absent(ledger: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """The ledger plus the rows whose id it does not have; existing rows stay untouched.

    Of several new rows of an id the one with the smallest ``order`` comes in.
    """
    return ledger.unionByName(keep_first(new, ["id"], order).join(ledger.select("id"), ["id"], "left_anti"))


def apply_results(ledger: DataFrame, results: DataFrame, today: str, order: str | None = None) -> DataFrame:
    """Record one proof result per finding.

    ``results``: (finding_id, status, proof_tier, reproducer_hash).  passed -> proven,
    failed -> false_positive, dry_run changes nothing, any other status is only
    recorded in the history.  Rows are matched by finding id, and the tier counts
    only for a passed proof.  Of several results of a finding the one with the greatest
    ``order`` counts; dry runs are left out before.
    """
    real = keep_last(results.where(c("status") != "dry_run"), ["finding_id"], order).select(
        c("finding_id").alias("id"), c("status").alias("r_status"), c("proof_tier").alias("r_tier"),
        c("reproducer_hash").alias("r_hash"),
    )
    new_status = c("status")
    for outcome, status in RESULT_STATUS.items():
        new_status = F.when(c("r_status") == outcome, status).otherwise(new_status)
    new_tier = F.when(c("r_status") == "passed", F.coalesce("r_tier", "proof_tier")).otherwise(c("proof_tier"))
    entry = F.struct(
        F.lit(today).alias("date"), new_status.alias("status"), new_tier.cast("int").alias("proof_tier"),
        c("r_hash").alias("reproducer_hash"),
    )
    has = c("r_status").isNotNull()
    joined = ledger.join(real, ["id"], "left")
    changed = {
        "status": new_status, "proof_tier": F.when(has, new_tier).otherwise(c("proof_tier")).cast("int"),
        "status_history": F.when(has, F.array_append(F.coalesce(
            "status_history", F.array().cast("array<struct<date:string,status:string,proof_tier:int,reproducer_hash:string>>")
        ), entry)).otherwise(c("status_history")),
        "reproducer_hash": F.when(has, c("r_hash")).otherwise(c("reproducer_hash")),
        "proven": F.when(has & (new_status == "proven"), F.lit(today)).otherwise(c("proven")),
    }
    return joined.select(*[changed.get(name, c(name)).alias(name) for name in ledger.columns])


def violations(ledger: DataFrame) -> DataFrame:
    """(id, problem): one row per broken constraint."""
    missing = [name for name in REQUIRED if name not in ledger.columns]
    absent = F.concat(
        F.array(*[F.lit(m) for m in missing]).cast("array<string>"),
        *[F.when(c(name).isNull(), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
          for name in REQUIRED if name in ledger.columns],
    )
    tier = c("proof_tier").try_cast("int")
    found = F.array(
        F.when(F.size(absent) > 0, F.concat(F.lit("missing required fields: "), F.array_join(F.array_sort(absent), ", "))),
        F.when(~c("status").isin(*STATUSES), F.concat(F.lit("invalid status: "), c("status"))),
        F.when(c("proof_tier").isNotNull() & ~F.coalesce(tier.between(0, 3), F.lit(False)), "proof_tier must be an int 0-3"),
        F.when((c("status") == "proven") & (F.coalesce("proven", F.lit("")) == ""), "proven without a date"),
    )
    return ledger.select("id", F.explode(F.array_compact(found)).alias("problem"))


def integrity(ledger: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(id, problem) of rows whose recorded artifact is gone or has changed.

    ``artifacts``: (id, current_hash).
    """
    recorded = ledger.where(F.coalesce("reproducer_hash", F.lit("")) != "").select("id", "reproducer_hash")
    return (
        recorded.join(artifacts.select("id", "current_hash"), ["id"], "left")
        .withColumn("problem", F.when(c("current_hash").isNull(), "missing").when(
            c("current_hash") != c("reproducer_hash"), "changed"))
        .where(c("problem").isNotNull()).select("id", "problem")
    )


def eligible(ledger: DataFrame, min_tier: int = 2, finding_id: str | None = None) -> DataFrame:
    """Rows a fix may be proposed for."""
    chosen = ledger.where((c("status") == "proven") & (F.coalesce("proof_tier", F.lit(0)) >= min_tier))
    return chosen if finding_id is None else chosen.where(c("id") == finding_id)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``old`` replaced or extended by ``new``; of several new rows of a key the one
    with the greatest ``order`` wins."""
    last = keep_last(new, key, order)
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def outcome(status) -> Column:
    """Finding status of a proof outcome."""
    text = F.upper(c(status) if isinstance(status, str) else status)
    return F.when(text == "PASSED", "proven").when(text == "FAILED", "refuted").when(text == "SKIPPED", "skipped").otherwise("error")


def update_status(findings: DataFrame, results: DataFrame, order: str | None = None) -> DataFrame:
    """Findings with the status of their proof result (of several, the greatest ``order``).

    ``results``: (finding_id, proof_status).
    """
    r = keep_last(results, ["finding_id"], order).select("finding_id", c("proof_status").alias("_ps"))
    joined = findings.join(r, ["finding_id"], "left")
    return joined.withColumn("status", F.when(c("_ps").isNotNull(), outcome("_ps")).otherwise(c("status"))).drop("_ps")


def taxonomy_drift(rules: DataFrame, registry: DataFrame) -> DataFrame:
    """Rule ids that the registry knows neither by family nor as an extension.

    ``rules``: (taxonomy_id); ``registry``: (entry) with family prefixes and full ids.
    """
    from ..functions.text import rule_family

    known = registry.select("entry").distinct()
    return (
        rules.select("taxonomy_id").distinct().withColumn("entry", F.explode(F.array_distinct(
            F.array(rule_family("taxonomy_id"), c("taxonomy_id")))))
        .join(known.withColumn("_known", F.lit(1)), ["entry"], "left")
        .groupBy("taxonomy_id").agg(F.count("_known").alias("n")).where("n = 0").select("taxonomy_id")
    )


def keep_newest(artifacts: DataFrame, order: str, n: int = 1000) -> DataFrame:
    """The ``n`` newest artifacts (what pruning leaves)."""
    return artifacts.orderBy(c(order).desc()).limit(n)
