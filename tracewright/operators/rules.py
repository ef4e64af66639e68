"""Rules and their taxonomy as dimension tables.

The taxonomy is read from a registry file: families by tier with the numbers given out, and
ids outside of these.  Rules are versioned: what a finding says about its rule holds for the
rule's version at that time, so findings meet the dimension as of their ``rule_version``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import rule_family

c = F.col
RULES = "rule_id string, rule_version string, view string, enabled boolean, recipe string"
TAXONOMY = """entry string, tier string, name string, first int, last int, maps_to string, status string,
    added string, precision string, is_open boolean"""
TIERS = ("core", "documented", "additional", "extensions")
REGISTRY = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "taxonomy.yaml")
# --- fixed values: words that show that an entry was never filled in ---
UNFILLED = ("FILL IN", "TBD")
# --- end of fixed values ---


def rule_table(spark: SparkSession) -> DataFrame:
    """(rule_id, rule_version, view, enabled, recipe, family): one row per detector."""
    from ..plans.detectors import DETECTORS

    rows = [(d.rule_id, d.version, d.view, d.enabled, d.recipe) for d in DETECTORS]
    return spark.createDataFrame(rows, RULES).withColumn("family", rule_family("rule_id"))


def by_rule(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Every rule with the number of its findings and of the files they are in, also 0."""
    counts = findings.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n_findings"), F.count_distinct("repo", "file").alias("n_files"))
    return rules.join(counts, ["rule_id"], "left").na.fill(0, ["n_findings", "n_files"])


# ---- taxonomy ------------------------------------------------------------------------------
def taxonomy(spark: SparkSession, path: str = REGISTRY) -> DataFrame:
    """The registry file as rows (``TAXONOMY``): a row for each family and each extension.

    ``is_open``: an additional entry that still holds a placeholder."""
    return spark.createDataFrame(_entries(path), TAXONOMY)


def registry_ranges(path: str = REGISTRY) -> list[tuple]:
    """(entry, tier, first, last) of the registry file."""
    return [(e[0], e[1], e[3], e[4]) for e in _entries(path)]


def _entries(path: str) -> list[tuple]:
    import yaml

    with open(path, encoding="utf-8") as handle:
        document = yaml.safe_load(handle) or {}
    return [_entry(tier, name, of or {}) for tier in TIERS for name, of in (document.get(tier) or {}).items()]


def _entry(tier: str, name: str, of: dict) -> tuple:
    first, _, last = str(of.get("range") or "").partition("-")
    text = " ".join(str(v) for v in of.values())
    return (name, tier, of.get("name"), int(first) if first.isdigit() else None, int(last) if last.isdigit() else None, of.get("maps_to"),
            of.get("status"), of.get("added"), of.get("precision"), tier == "additional" and any(word in text for word in UNFILLED))


def placed(ids: DataFrame, registry: DataFrame, column: str = "taxonomy_id") -> DataFrame:
    """Distinct ids with their entry and tier, and what is wrong: ``unknown`` (neither a family nor an extension
    of that name) or ``number`` (beyond the numbers its family has given out).

    An extension of just that id comes before its family."""
    number = F.regexp_extract(column, "-([0-9]+)$", 1).try_cast("int")
    entries = registry.select("entry", "tier", "name", "first", "last")
    wanted = ids.select(column).distinct().withColumn("number", number).withColumn("entry", F.explode(F.array_distinct(F.array(
        c(column), rule_family(column)))))
    found = wanted.join(entries, ["entry"], "left").groupBy(column, "number").agg(F.max_by(
        F.struct("entry", "tier", "name", "first", "last"), F.when(c("tier").isNotNull(), F.length("entry"))).alias("of"))
    beyond = (c("of.tier") != "extensions") & ~c("number").between(c("of.first"), c("of.last"))
    problem = F.when(c("of").isNull(), "unknown").when(beyond, "number")
    return found.select(column, F.when(c("of").isNotNull(), c("of.entry")).alias("entry"), c("of.tier").alias("tier"),
                        c("of.name").alias("name"), problem.alias("problem"))


def coverage(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """Every family of the registry with the number of its findings (also 0), and how many of its rules have some."""
    counts = findings.groupBy("taxonomy_id").agg(F.count(F.lit(1)).alias("n")).groupBy(rule_family("taxonomy_id").alias("entry")).agg(
        F.sum("n").alias("n_findings"), F.count(F.lit(1)).alias("n_rules"))
    families = registry.where(c("tier") != "extensions").select("entry", "tier", "name", (c("last") - c("first") + 1).alias("n_given"))
    return families.join(counts, ["entry"], "left").na.fill(0, ["n_findings", "n_rules"])


# ---- versions -------------------------------------------------------------------------------
def version_key(version) -> Column:
    """Versions in their order: 1.10.0 after 1.9.2.  Parts that are no number count as 0."""
    column = c(version) if isinstance(version, str) else version
    return F.transform(F.split(column, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def with_intervals(rules: DataFrame) -> DataFrame:
    """Versions of each rule with ``since`` and ``until``, the next one's ``since`` (null for the newest).

    Versions of one rule are few; equal ones count as one."""
    known = rules.withColumn("since", version_key("rule_version"))
    rest = [x for x in rules.columns if x != "rule_id"]
    once = known.groupBy("rule_id", "since").agg(F.min_by(F.struct(*rest), "rule_version").alias("of"))
    following = F.lead("since").over(Window.partitionBy("rule_id").orderBy("since"))
    return once.withColumn("until", following).select("rule_id", "since", "until", "of.*")


def as_of(findings: DataFrame, rules: DataFrame, *columns: str) -> DataFrame:
    """Findings with ``columns`` of their rule, as of their ``rule_version``: of the greatest version that is not
    newer; ``dimension_version`` names it.  Null where the rule is unknown or only newer versions are.

    Rules and versions that findings name are few, so the dimension is joined with the distinct pairs, and
    the findings meet one row for each pair: no range join over findings."""
    asked = findings.select("rule_id", "rule_version").distinct().withColumn("_key", version_key("rule_version"))
    dimension = with_intervals(rules).select("rule_id", "since", "until", c("rule_version").alias("dimension_version"), *columns)
    holds = (c("since") <= c("_key")) & (c("until").isNull() | (c("_key") < c("until")))
    found = asked.join(dimension, ["rule_id"]).where(holds).select("rule_id", "rule_version", "dimension_version", *columns)
    return findings.join(found, ["rule_id", "rule_version"], "left")
