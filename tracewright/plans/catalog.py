"""Registered queries: every operator over the driver's tables, with its SQL.

Two kinds:

* detector queries scan the application derived from ``part`` (``derived_app``) and
  return what one detector, or the whole scan, finds;
* operator queries feed an operator with relations adapted from the tables (orders
  as calls, customers as endpoints, document lines as source lines, ...).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived_app, detector_oracle
from .detectors import DETECTORS
from .scan import build_index, findings

c = F.col
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return register


# ---- detectors over the derived application ---------------------------------------------
def derived_index(spark: SparkSession, sf_dir: str):
    """The index of the derived application, built by each query for itself."""
    return build_index(derived_app.derived_sources(spark, sf_dir))


FINDING = ("repo", "rule_id", "file", "line", "function", "code_location_hash", "fix_confidence")


def _detector_query(rule_id: str) -> Query:
    def run(spark, sf_dir):
        return findings(derived_index(spark, sf_dir), rules=[rule_id]).select(*FINDING, c("severity.score").alias("score"))
    return run


for _d in DETECTORS:
    if _d.enabled:
        query("detect_" + _d.rule_id[3:].lower().replace("-", "_"),
              detector_oracle.with_base(detector_oracle.union_sql([_d.rule_id])))(_detector_query(_d.rule_id))
_ENABLED = [d.rule_id for d in DETECTORS if d.enabled]


@query("scan_findings", detector_oracle.with_base(
    f"""SELECT repo, rule_id, file, line, "function", code_location_hash, fix_confidence, score,
        rule_id || '-' || substr(sha256(concat_ws(':', repo, rule_id, file, "function", code_location_hash)), 1, 16) AS id,
        CASE WHEN score >= 60 THEN 'CRITICAL' WHEN score >= 40 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS band
        FROM ({detector_oracle.union_sql(_ENABLED)})"""))
def scan_findings(spark, sf_dir):
    """The whole scan, from source text to scored findings (nothing shared)."""
    from ..functions.scoring import band

    found = findings(build_index(derived_app.derived_sources(spark, sf_dir)))
    return found.select(*FINDING, c("severity.score").alias("score"), "id", band("severity.score").alias("band"))


from . import fact_queries, supplier_app, table_queries  # noqa: E402,F401  (they register their queries)
