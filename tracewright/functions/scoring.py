"""Severity as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, rule_family

# --- fixed values: weights and defaults of the scoring model ------------------
PRIVILEGE = {"guest": 5, "authenticated": 4, "operational_role": 3, "elevated_role": 2, "system_manager": 1}
IMPACT = {"rce": 5, "privilege_escalation": 4, "data_corruption": 3, "data_exposure": 2, "availability": 2}
BLAST = {"cross_site": 5, "framework_wide": 4, "cross_doctype": 3, "single_doctype": 2, "single_record": 1}
TIER = {0: 0, 1: 1, 2: 3, 3: 5}
GUEST_FACTOR = 1.5

RULE_IMPACT = {
    "FR-SQLI-001": "rce", "FR-SQLI-002": "data_exposure", "FR-SQLI-003": "data_corruption", "FR-SQLI-004": "rce",
    "FR-PERM-001": "privilege_escalation", "FR-PERM-002": "privilege_escalation",
    "FR-PERM-003": "privilege_escalation", "FR-PERM-004": "data_exposure", "FR-PERM-005": "data_exposure",
    "FR-PERM-006": "data_corruption",
    "FR-HOOK-001": "data_corruption", "FR-HOOK-002": "data_corruption", "FR-HOOK-003": "data_corruption",
    "FR-HOOK-004": "data_corruption", "FR-HOOK-005": "data_corruption",
    "FR-WKFL-001": "data_corruption", "FR-WKFL-002": "privilege_escalation", "FR-WKFL-003": "data_corruption",
    "FR-WKFL-004": "data_corruption",
    "FR-INJ-001": "privilege_escalation", "FR-INJ-002": "rce", "FR-INJ-005": "data_exposure",
    "FR-CSRF-001": "privilege_escalation", "FR-SSRF-001": "data_exposure", "FR-PATH-001": "data_exposure",
}
FAMILY_BLAST = {
    "FR-SQLI": "cross_doctype", "FR-PERM": "single_doctype", "FR-HOOK": "single_doctype",
    "FR-WKFL": "single_doctype", "FR-INJ": "framework_wide", "FR-PATH": "framework_wide",
}
RULE_BLAST = {
    "FR-INJ-005": "cross_site", "FR-CSRF-001": "cross_site",
    "FR-SSRF-001": "framework_wide", "FR-PATH-001": "framework_wide",
}
# rules and families that are scored by a constant instead of the security model
RULE_BASE = {"FR-HOOK-006": ("correctness", 7.0), "FR-HOOK-007": ("correctness", 5.0)}
FAMILY_BASE = {"FR-PERF": ("performance", 4.0), "FR-DATA": ("data_integrity", 7.0), "FR-I18N": ("i18n", 2.0)}
READ_ONLY_ENDPOINT_RULE = "FR-PERM-001"


def lookup(value: Column, table: dict, default=None) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.create_map(*pairs)[value]
    return found if default is None else F.coalesce(found, F.lit(default))


def severity(rule_id, fix_confidence, guest, tier) -> Column:
    """``struct(score, dims)`` of a candidate."""
    rule, guest, tier = col(rule_id), col(guest), col(tier)
    family = rule_family(rule)
    impact = F.when(
        (rule == READ_ONLY_ENDPOINT_RULE) & (col(fix_confidence) == "low"), "data_exposure"
    ).otherwise(lookup(rule, RULE_IMPACT, "data_exposure"))
    blast = F.coalesce(lookup(rule, RULE_BLAST), lookup(family, FAMILY_BLAST), F.lit("single_record"))
    privilege = F.when(guest, "guest").otherwise("authenticated")
    weight = lookup(tier, TIER, 0)
    security = (
        lookup(privilege, PRIVILEGE) * 3 + lookup(impact, IMPACT) * 4 + lookup(blast, BLAST) * 2 + weight
    ).cast("double") * F.when(guest, GUEST_FACTOR).otherwise(1.0)

    category = F.coalesce(
        lookup(rule, {k: v[0] for k, v in RULE_BASE.items()}),
        lookup(family, {k: v[0] for k, v in FAMILY_BASE.items()}),
    )
    base = F.coalesce(
        lookup(rule, {k: v[1] for k, v in RULE_BASE.items()}),
        lookup(family, {k: v[1] for k, v in FAMILY_BASE.items()}),
    )
    constant = base + F.when(category == "i18n", 0).otherwise(weight)
    is_security = category.isNull()
    only = lambda value: F.when(is_security, value)
    return F.struct(
        F.when(is_security, security).otherwise(constant).alias("score"),
        F.struct(
            category.alias("category"),
            only(privilege).alias("privilege_required"), only(guest).alias("allow_guest"),
            only(impact).alias("impact_class"), only(blast).alias("blast_radius"),
            F.when(is_security | (category != "i18n"), tier).alias("proof_tier"),
        ).alias("dims"),
    )


def band(score, *, zero_is_low: bool = False) -> Column:
    """Severity band; the list view shows scores of zero or none as LOW."""
    value = col(score)
    lowest = F.lit("LOW") if zero_is_low else F.when(value > 0, "LOW").otherwise("—")
    return F.when(value >= 60, "CRITICAL").when(value >= 40, "HIGH").when(value >= 20, "MEDIUM").otherwise(lowest)


def report_level(score) -> Column:
    value = F.coalesce(col(score), F.lit(0.0))
    return F.when(value >= 60, "error").when(value >= 20, "warning").otherwise("note")
