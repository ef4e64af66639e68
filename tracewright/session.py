"""Session factory and the durable work area used to cut lineage."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a scan benefits from; anything the cluster already sets is kept.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no Python stack capture for every column built (detectors build thousands)
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def spark_session(app_name: str = "tracewright", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_folders: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder all executors share: the cluster's checkpoint folder.

    Only a local session that names none (a test) falls back to a folder of its own; on
    a cluster each executor would write to its own disk, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="tracewright-")
    return _own_folders[application]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a columnar table and read it back.

    Unlike a cached block the table survives the loss of executors, cuts the
    lineage, and lets later readers prune columns and row groups.
    """
    spark = df.sparkSession
    path = os.path.join(work_dir(spark), "tracewright", f"{name}-{uuid.uuid4().hex}")
    if _open_scopes:
        _open_scopes[-1].append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_open_scopes: list[list[str]] = []


@contextlib.contextmanager
def work_tables(spark: SparkSession):
    """Removes the work tables written within, once the block ends.

    For callers who write their results themselves (the command line, a micro-batch); what
    is read lazily from the work tables must be done by then.
    """
    _open_scopes.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _open_scopes.pop():
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in tasks (needed by the file-reading stages)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):  # already shipped when imported from an archive
        target = os.path.join(tempfile.mkdtemp(prefix="tracewright-"), "tracewright")
        context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package)))
    _shipped.add(context.applicationId)
