"""Continuous scanning of arriving source files (file source, micro-batches).

A table of packed files ``(repo, path, content)`` is read as a stream.  What has arrived is
kept: the newest content of every file (``Sources``), and parsed modules by content.  A
micro-batch replaces its files, parses only contents that are new, and derives the findings
of the repositories it touches from all their files, old and new; no call, type or hook
leads from one repository to another, so those of all others stay.  So a guard that one
batch takes out of a helper brings back what calls it in files of earlier batches.

Findings are a table in versions (``tables``): a reader sees a batch as a whole.  A batch that
runs again after a failure replaces the same files and the same findings.
Progress is observable through Spark's own ``StreamingQueryListener``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.parsed import ParsedModules
from ..tables import Table

c = F.col
PACKED = "repo string, path string, content binary"
FOUND = """
    repo string, rule_id string, rule_version string, taxonomy_id string, file string, line int, function string,
    code_location_hash string, evidence string, proof_recipe string, proof_tier int, status string,
    fix_confidence string, target_arg string, id string, score double, severity string
"""


class Sources:
    """The newest content of every file, and what was parsed of them, below one folder."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64):
        folder = folder.rstrip("/")
        # by repository: a batch reads and writes those it touches
        self.files = Table(spark, f"{folder}/files", PACKED, ["repo"], parts)
        self.modules = ParsedModules(spark, f"{folder}/modules", parts)

    def put(self, batch: DataFrame) -> None:
        """Replace the files of a batch; of several of one path in it the one of the greatest content stays."""
        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            newest = new.groupBy("repo", "path").agg(F.max("content").alias("content"))
            return old.join(newest.select("repo", "path"), ["repo", "path"], "left_anti").unionByName(newest)

        self.files.merge(batch.select("repo", "path", "content"), change)

    def of_repos(self, repos: DataFrame) -> DataFrame:
        return self.files.of_keys(repos)


def findings_table(spark: SparkSession, path: str, parts: int = 64) -> Table:
    return Table(spark, path, StructType.fromDDL(FOUND), ["repo"], parts)


def scan_batch(spark: SparkSession, batch: DataFrame, sources: Sources, found: Table, **options) -> None:
    """Take in the files of a batch and replace the findings of the repositories it touches."""
    from ..plans.scan import ScanInput, build_index, findings
    from ..session import materialise
    from ..sources.files import from_table

    repos = materialise(batch.select("repo").distinct(), "touched")
    sources.put(batch)
    files = from_table(sources.of_repos(repos))
    index = build_index(ScanInput.of_files(files), modules=sources.modules)
    rows = findings(index, **options).withColumns({"score": c("severity.score"), "severity": F.to_json("severity")})
    rows = materialise(rows.select(*StructType.fromDDL(FOUND).fieldNames()), "stream-findings")
    found.merge(repos, lambda old, touched: old.join(touched, ["repo"], "left_anti").unionByName(rows))


def scan_stream(spark: SparkSession, incoming: str, findings_path: str, checkpoint: str, *,
                available_now: bool = True, every: str = "1 minute", max_files_per_batch: int = 1000, parts: int = 64,
                **options) -> StreamingQuery:
    """``every``: time between micro-batches unless all that is there is read at once.  Sources and findings
    are kept below ``findings_path``."""
    from ..session import work_tables

    stream = spark.readStream.schema(PACKED).option("maxFilesPerTrigger", max_files_per_batch).parquet(incoming)
    sources, found = Sources(spark, f"{findings_path}/sources", parts), findings_table(spark, f"{findings_path}/findings", parts)

    def run(batch: DataFrame, number: int) -> None:
        with work_tables(spark):
            scan_batch(spark, batch, sources, found, **options)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def latest_findings(spark: SparkSession, findings_path: str) -> DataFrame:
    """The findings of all repositories as the newest complete batch left them."""
    return findings_table(spark, f"{findings_path}/findings").read()
