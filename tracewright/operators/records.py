"""Scans, findings and proof results as tables: what a list of past scans is read from.

A scan is started, its findings recorded, and it is finished; proofs are recorded with
the status they give their findings.  Each of these is one change of one or two tables
and rewrites only the parts that hold the keys it names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import FINDING_RECORDS, PROOF_RECORDS, SCAN_RECORDS
from ..tables import Table
from .findings import keep_last
from .ledger import outcome

c = F.col


@dataclass(frozen=True)
class Records:
    scans: Table
    findings: Table
    proofs: Table


def open_records(spark: SparkSession, folder: str, parts: int = 64) -> Records:
    """The three tables below a folder that all executors share; they need not exist yet."""
    folder = folder.rstrip("/")
    return Records(
        Table(spark, f"{folder}/scans", SCAN_RECORDS, ["scan_id"], parts=min(parts, 8)),
        Table(spark, f"{folder}/findings", FINDING_RECORDS, ["finding_id"], parts),
        Table(spark, f"{folder}/proof_results", PROOF_RECORDS, ["finding_id"], parts))


def finding_rows(findings: DataFrame, scan_id, created_at) -> DataFrame:
    """Scored findings as rows of the findings table (columns that a finding lacks are null)."""
    as_column = lambda v: v if not isinstance(v, (str, int, float)) else F.lit(v)
    have = set(findings.columns)
    made = {
        "finding_id": F.coalesce(c("id"), F.lit("")), "scan_id": as_column(scan_id), "created_at": as_column(created_at),
        "rule_id": F.coalesce(c("rule_id"), F.lit("")), "status": F.coalesce(c("status"), F.lit("candidate")) if "status" in have else F.lit("candidate"),
    }
    if "severity" in have:
        made |= {"severity_score": c("severity.score"), "severity_json": F.to_json("severity")}
    fields = StructType.fromDDL(FINDING_RECORDS)
    return findings.select(*((made.get(f.name, c(f.name) if f.name in have else F.lit(None))).cast(f.dataType).alias(f.name) for f in fields))


def start_scans(records: Records, scans: DataFrame) -> int:
    """``scans``: (scan_id, repo_path, started_at); a scan that is there already starts anew."""
    return records.scans.upsert(scans.select(
        "scan_id", "repo_path", c("started_at").cast("double").alias("started_at"), F.lit(None).cast("double").alias("finished_at"),
        F.lit("running").alias("status")), "started_at")


def finish_scans(records: Records, ended: DataFrame) -> int:
    """``ended``: (scan_id, finished_at, status); scans that are not there are left out."""
    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        last = keep_last(new, ["scan_id"], "finished_at").select("scan_id", c("finished_at").alias("_at"), c("status").alias("_status"))
        return old.join(last, ["scan_id"], "left").select(
            "scan_id", "repo_path", "started_at", F.coalesce("_at", "finished_at").alias("finished_at"),
            F.coalesce("_status", "status").alias("status"))

    return records.scans.merge(ended, change)


def record_findings(records: Records, rows: DataFrame) -> int:
    """``rows``: as ``finding_rows`` makes them.  A finding belongs to the scan that reported it last."""
    return records.findings.upsert(rows, "created_at")


def record_proofs(records: Records, results: DataFrame) -> tuple[int, int]:
    """Proof results (``PROOF_RECORDS``), and the status, proof status and tier they give their findings.

    Of several results of a finding the one of the greatest ``proved_at`` counts.  Results of
    findings that no scan has reported are kept, as a later scan may report them."""
    version = records.proofs.upsert(results, "proved_at")

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        last = keep_last(new, ["finding_id"], "proved_at").select(
            "finding_id", outcome("proof_status").alias("_status"), c("proof_status").alias("_proof"), c("proof_tier").alias("_tier"),
            F.lit(True).alias("_proved"))
        new_value = {"status": "_status", "proof_status": "_proof", "proof_tier": "_tier"}
        joined = old.join(last, ["finding_id"], "left")
        return joined.select(*(F.when(c("_proved"), c(new_value[n])).otherwise(c(n)).alias(n) if n in new_value else c(n) for n in old.columns))

    return version, records.findings.merge(results, change)
