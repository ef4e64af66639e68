"""One row per function: everything the detectors ask about a function.

Computed once with joins on (repo, symbol_id); detectors then need one join with
this relation instead of one graph traversal each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .facts import Facts
from .graph import CallGraph, one_hop_targets, reach, within_one_hop

c = F.col
ENTRY_HOPS = 3
FLAGS = ("is_endpoint", "is_guest", "is_report", "has_check", "has_mutation", "writes_docstatus", "sets_value")


def symbol_flags(facts: Facts) -> DataFrame:
    """Flags of each function's own body (one aggregation, combined before the shuffle)."""
    yes = lambda condition: F.coalesce(F.max(condition), F.lit(False))
    own_rows = facts.rows.where(c("symbol_id").isNotNull())
    return own_rows.groupBy("repo", "symbol_id").agg(
        yes(c("is_endpoint")).alias("is_endpoint"),
        yes(c("is_endpoint") & c("allow_guest")).alias("is_guest"),
        yes(c("is_report_entry")).alias("is_report"),
        yes(c("is_permission_check")).alias("has_check"),
        yes(c("is_mutation")).alias("has_mutation"),
        yes(c("is_set_value") & F.coalesce(c("set_value_field") == "docstatus", F.lit(False))).alias("writes_docstatus"),
        yes(c("is_set_value")).alias("sets_value"),
    )


def symbols(facts: Facts, graph: CallGraph) -> DataFrame:
    """Own flags plus: ``reachable`` (3 hops from an entry point), ``guarded`` and
    ``mutates`` (endpoint or direct callee), ``exposed`` (is, or is directly called
    by, an endpoint without a permission check)."""
    flags = materialise(symbol_flags(facts), "symbol-flags")
    endpoints = flags.where("is_endpoint").select("repo", "symbol_id")
    entries = flags.where("is_endpoint OR is_report").select("repo", "symbol_id")
    near = within_one_hop(graph, endpoints, flags, ("has_check", "has_mutation")).select(
        "repo", "symbol_id", c("has_check").alias("guarded"), c("has_mutation").alias("mutates")
    )
    unguarded = near.where("NOT guarded").select("repo", "symbol_id")
    yes = F.lit(True)
    reachable = reach(graph, entries, ENTRY_HOPS).withColumn("reachable", yes)
    exposed = one_hop_targets(graph, unguarded).withColumn("exposed", yes)
    return (
        flags.join(near, ["repo", "symbol_id"], "left")
        .join(reachable, ["repo", "symbol_id"], "left")
        .join(exposed, ["repo", "symbol_id"], "left")
        .na.fill(False, ["guarded", "mutates", "reachable", "exposed"])
    )
