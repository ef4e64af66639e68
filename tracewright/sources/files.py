"""Source files as a DataFrame ``(repo, path, abs_path, content)``.

Two feeders:

* ``from_table`` - files already packed in a table (the form a very large corpus
  has; columns are pruned and files of any size share read splits);
* ``from_folders`` - repositories checked out on storage every executor mounts.
  Spark's own file listing hides names that start with ``_`` (so also
  ``__init__.py``); therefore tasks walk the folders themselves: a first stage
  lists names only, the names are spread evenly, a second stage reads contents.
"""

from __future__ import annotations

import fnmatch
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.framework import SKIPPED_DIRS, SKIPPED_SCHEMA_DIRS
from ..session import ship_package
from ..schemas import SOURCE_FILES, arrow_schema

LISTING = "repo string, path string, abs_path string, problem string"
START = "repo string, root string, start string, problem string"
# folders no selection of a scan wants; they are not entered at all
PRUNED = tuple(sorted(set(SKIPPED_DIRS) & set(SKIPPED_SCHEMA_DIRS)))


def from_table(table: DataFrame, *, repo="repo", path="path", content="content") -> DataFrame:
    """Use a packed table; text content is taken as UTF-8."""
    as_column = lambda v: F.col(v) if isinstance(v, str) else v
    body = as_column(content).cast("binary")
    kind = ["kind"] if "kind" in table.columns else []
    return table.select(
        as_column(repo).alias("repo"), as_column(path).alias("path"),
        F.concat_ws("/", as_column(repo), as_column(path)).alias("abs_path"), body.alias("content"), *kind,
    )


def pack(files: DataFrame, target: str) -> None:
    """Write files as a table partitioned by what the scan does with them, so that
    each of its three readers touches only its own part."""
    name = F.substring_index("path", "/", -1)
    kind = F.when(name == "hooks.py", "hooks").when(name.endswith(".py"), "python").when(
        name.endswith(".json"), "schema").otherwise("other")
    files.withColumn("kind", kind).write.partitionBy("kind").mode("errorifexists").parquet(target)


def list_entries(spark: SparkSession, repos: dict[str, str], pattern: str = "*", pruned=PRUNED) -> DataFrame:
    """(repo, path, abs_path, problem) of all files below the given roots, walked inside tasks.

    A folder that cannot be listed, and a link that leads nowhere, is a row with a problem.  Links to
    folders are not followed (a root may be one).  The folders of the first two levels are dealt
    out again before they are walked, so a repository with one large folder is not walked by one task.
    """
    starts = [item for repo, root in repos.items() for item in _first_level(repo, os.path.abspath(root), pruned)]
    listing, start_schema = arrow_schema(LISTING), arrow_schema(START)
    ship_package(spark)
    tasks = spark.sparkContext.defaultParallelism * 4

    def deeper(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                found = [(row["start"], row["problem"])] if row["problem"] or not _is_folder(row["start"]) else _entries(row["start"], pruned)
                rows += [{**row, "start": path, "problem": problem} for path, problem in found]
            yield pa.RecordBatch.from_pylist(rows, schema=start_schema)

    def walk(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = []
                for path, problem in [(row["start"], row["problem"])] if row["problem"] else _walk(row["start"], pruned):
                    if problem or fnmatch.fnmatchcase(os.path.basename(path), pattern):
                        relative = os.path.relpath(path, row["root"]).replace(os.sep, "/")
                        block.append({"repo": row["repo"], "path": relative, "abs_path": path, "problem": problem})
                    if len(block) >= 10000:
                        yield pa.RecordBatch.from_pylist(block, schema=listing)
                        block = []
                if block:
                    yield pa.RecordBatch.from_pylist(block, schema=listing)

    entries = spark.createDataFrame(starts or [("", "", "", None)], START).where("start <> ''")
    for _ in range(2):
        entries = entries.repartition(max(1, min(tasks, len(starts) * 16))).mapInArrow(deeper, START)
    return entries.repartition(tasks, "start").mapInArrow(walk, LISTING)


def list_files(spark: SparkSession, repos: dict[str, str], pattern: str = "*", pruned=PRUNED) -> DataFrame:
    """(repo, path, abs_path) of the files that ``list_entries`` finds."""
    return list_entries(spark, repos, pattern, pruned).where("problem IS NULL").drop("problem")


def _first_level(repo, root, pruned):
    if not _is_folder(root):
        return [(repo, os.path.dirname(root), root, None)] if os.path.isfile(root) else []
    return [(repo, root, path, problem) for path, problem in _entries(root, pruned)]


def _is_folder(path):
    return os.path.isdir(path)


def _entries(folder, pruned):
    """(path, problem) of what a folder holds, without links to folders."""
    try:
        with os.scandir(folder) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError as problem:
        return [(folder, f"folder cannot be listed: {problem.strerror or type(problem).__name__}")]
    out = []
    for entry in entries:
        try:
            if entry.is_dir():
                if entry.name not in pruned and not entry.is_symlink():
                    out.append((entry.path, None))
            elif entry.is_file():
                out.append((entry.path, None))
            elif entry.is_symlink():
                out.append((entry.path, "link leads nowhere"))
        except OSError as problem:
            out.append((entry.path, f"cannot be looked at: {problem.strerror or type(problem).__name__}"))
    return out


def _walk(start, pruned):
    """(path, problem) of all files below a folder, or of a file itself."""
    if not _is_folder(start):
        yield start, None
        return
    waiting = [start]
    while waiting:
        for path, problem in _entries(waiting.pop(), pruned):
            if problem is None and _is_folder(path):
                waiting.append(path)
            else:
                yield path, problem


def without_folders(files: DataFrame, skipped=SKIPPED_DIRS) -> DataFrame:
    """Drop files with a skipped folder among the parts of their path."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    return files.where(~F.coalesce(F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skipped])), F.lit(False)))


def read_contents(files: DataFrame, spread: bool = True) -> DataFrame:
    """Add ``content``; names are first spread over the cluster, then read.

    A file that cannot be read (rights, a path an executor does not mount) keeps its row
    with a null content, which the parsers report.
    """
    schema = arrow_schema(SOURCE_FILES)
    ship_package(files.sparkSession)

    def read(batches):
        for batch in batches:
            block, size = [], 0
            for row in batch.to_pylist():
                try:
                    with open(row["abs_path"], "rb") as handle:
                        row["content"] = handle.read()
                except OSError:
                    row["content"] = None
                block.append(row)
                size += len(row["content"] or b"")
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(block, schema=schema)
                    block, size = [], 0
            if block:
                yield pa.RecordBatch.from_pylist(block, schema=schema)

    # an explicit count: adaptive execution would merge the (tiny) name partitions again
    workers = files.sparkSession.sparkContext.defaultParallelism * 4
    names = files.select("repo", "path", "abs_path")
    return (names.repartition(workers, "repo", "path") if spread else names).mapInArrow(read, SOURCE_FILES)


def from_folders(spark: SparkSession, repos: dict[str, str], pattern: str = "*") -> DataFrame:
    return read_contents(list_files(spark, repos, pattern))


# ---- the three selections a scan makes of the files ------------------------------
def _of_kind(files: DataFrame, *kinds: str) -> DataFrame:
    return files.where(F.col("kind").isin(*kinds)) if "kind" in files.columns else files


def python_files(files: DataFrame) -> DataFrame:
    return without_folders(_of_kind(files, "python", "hooks").where(F.col("path").endswith(".py")))


def hook_files(files: DataFrame) -> DataFrame:
    return without_folders(_of_kind(files, "hooks").where(F.substring_index("path", "/", -1) == "hooks.py"))


def doctype_files(files: DataFrame) -> DataFrame:
    """``<name>/<name>.json`` outside skipped folders."""
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")
    parent = F.coalesce(
        F.get(parts, F.size(parts) - 2), F.element_at(F.split("abs_path", "/"), -2)
    )
    selected = _of_kind(files, "schema").where(F.col("path").endswith(".json") & (parent == stem))
    return without_folders(selected, SKIPPED_SCHEMA_DIRS)
