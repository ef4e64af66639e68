"""Parsed modules by content: what was parsed once is not parsed again.

Syntax rows follow from a file's text alone, but for the path in their names.  So they are
kept once for each content (SHA-256), and a scan joins its files with them: a second scan
parses the contents that no earlier one has seen, and copies of a file, in whatever
repository, share one parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from ..schemas import SYNTAX_ROWS
from ..session import materialise
from ..tables import StaleVersion, Table
from .python_source import syntax_rows

c = F.col
#: kind of the row that every parsed content has, also an empty one
SEEN = "seen"
#: contents that one task parses, and whose rows it sorts by part
TASK_CONTENTS = 5_000


def content_hash(content="content"):
    """Of the bytes; null for a file without content."""
    return F.sha2(c(content), 256)


class ParsedModules:
    """``folder``: of the table, which all executors share; it need not exist yet."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64):
        rows = StructType.fromDDL(SYNTAX_ROWS)
        fields = [StructField("content_hash", StringType()), *(f for f in rows if f.name not in ("repo", "path"))]
        self.table = Table(spark, folder, StructType(fields), ["content_hash"], parts)

    def add(self, files: DataFrame, attempts: int = 5, known: DataFrame | None = None) -> int:
        """Parse the contents that are not there yet; how many.  ``files``: (repo, path, content, ...); ``known``: their
        hashes (content_hash), if they are written already."""
        hashed = files.where("content IS NOT NULL").withColumn("content_hash", content_hash())
        for attempt in range(attempts):
            base = self.table.version()
            new = hashed if not self.table.folders(base) else self._unseen(hashed, hashed if known is None else known, base)
            if new is None:
                return 0
            # one file of each content; only new contents are shuffled
            wanted = new.groupBy("content_hash").agg(F.min_by("content", "path").alias("content"))
            wanted = materialise(wanted, "new-contents")
            count = wanted.count()
            if count == 0:
                return 0
            # contents are dealt to the parts, not their rows, which are several times as large
            parallelism = self.table.spark.sparkContext.defaultParallelism
            dealt = self.table.dealt(wanted, base, min(count, max(parallelism * 2, count // TASK_CONTENTS)))
            parsed = syntax_rows(dealt.select(c("content_hash").alias("repo"), F.lit("").alias("path"), "content"), mark=SEEN)
            try:
                self.table.append(parsed.drop("path").withColumnRenamed("repo", "content_hash"), base, are_dealt=True)
                return count
            except StaleVersion:
                if attempt == attempts - 1:
                    raise
        return 0

    def _unseen(self, hashed: DataFrame, known: DataFrame, base: int) -> DataFrame | None:
        """Files whose content the version ``base`` does not have, None if there are none.  They are told by their
        hashes alone: contents are read again only if some are new."""
        hashes = materialise(known.select("content_hash").distinct(), "hashes")
        seen = self.table.of_keys(hashes, base).where(c("kind") == SEEN).select("content_hash")
        unseen = materialise(hashes.join(seen, ["content_hash"], "left_anti"), "unseen")
        return None if unseen.isEmpty() else hashed.join(unseen, ["content_hash"], "left_semi")

    def rows(self, files: DataFrame) -> DataFrame:
        """Syntax rows of files that ``add`` has seen: (repo, path, content_hash).

        Files without content (a null hash) have no row here."""
        stored = self.table.read().where(c("kind") != SEEN)
        joined = files.where("content_hash IS NOT NULL").select("repo", "path", "content_hash").join(stored, ["content_hash"])
        names = StructType.fromDDL(SYNTAX_ROWS).fieldNames()
        # the two places that name the file: functions, and the message of a syntax error
        message = F.replace("name", F.lit("(, line "), F.concat(F.lit("("), F.substring_index("path", "/", -1), F.lit(", line ")))
        return joined.withColumns({
            "symbol_id": F.concat("path", "symbol_id"), "name": F.when(c("kind") == "error", message).otherwise(c("name"))}).select(*names)


def parsed_rows(files: DataFrame, modules: ParsedModules) -> DataFrame:
    """Syntax rows of files, of which only new contents are parsed."""
    known = materialise(files.where("content IS NOT NULL").select("repo", "path", content_hash().alias("content_hash")), "known")
    modules.add(files, known=known)
    # a file that cannot be read is one error row
    return modules.rows(known).unionByName(syntax_rows(files.where("content IS NULL")))
