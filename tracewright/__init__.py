"""Source code as data: fact tables, call graph, detectors and reports on Spark."""

from __future__ import annotations

from .session import spark_session

__all__ = ["scan", "scan_multi", "scan_table", "spark_session"]


def scan(spark, path: str, *, repo: str = "local", fp_log: str | None = None, **options):
    """Scored findings of one repository folder, as a DataFrame."""
    return scan_multi(spark, {repo: path}, fp_log=fp_log, **options)


def scan_multi(spark, repos: dict[str, str], *, fp_log: str | None = None, **options):
    """Scored findings of several repositories; each is analysed for itself."""
    import os

    from .config import load_false_positives
    from .plans.scan import scan_folders

    if fp_log and os.path.isfile(fp_log):
        options["false_positives"] = load_false_positives(spark, fp_log)
    return scan_folders(spark, repos, **options)


def scan_table(files, **options):
    """Scored findings of packed source files ``(repo, path, content)``."""
    from .plans.scan import scan_files
    from .sources.files import from_table

    return scan_files(from_table(files), **options)
