"""The scan: source files -> index -> candidates -> scored findings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as fd
from ..operators.classes import document_classes
from ..operators.facts import Facts, fact_table
from ..operators.graph import CallGraph, build_call_graph, stored
from ..operators.symbols import symbols
from ..session import materialise
from ..sources import doctypes as dt
from ..sources import files as src
from ..sources import hooks as hk
from ..sources.parsed import ParsedModules, parsed_rows
from ..sources.python_source import syntax_rows
from .detectors import Index, candidates

c = F.col


@dataclass(frozen=True)
class ScanInput:
    """The three kinds of files a scan reads; contents are read per kind."""

    python: DataFrame
    schema: DataFrame
    hooks: DataFrame

    @staticmethod
    def of_files(files: DataFrame) -> ScanInput:
        return ScanInput(src.python_files(files), src.doctype_files(files), src.hook_files(files))

    @staticmethod
    def of_folders(spark: SparkSession, repos: dict[str, str]) -> ScanInput:
        """Names are listed once, into a table; only the wanted files are opened.  Folders that could not be
        listed and links that lead nowhere become rows of the Python files, without content, so that
        they show among the parse errors."""
        entries = materialise(src.list_entries(spark, repos), "listing")
        names = entries.where("problem IS NULL").drop("problem")
        missing = entries.where("problem IS NOT NULL").select("repo", "path", "abs_path", F.lit(None).cast("binary").alias("content"))
        given = ScanInput(*(src.read_contents(pick(names)) for pick in (src.python_files, src.doctype_files, src.hook_files)))
        return replace(given, python=given.python.unionByName(missing))


def build_index(given: ScanInput, *, app_order: list[str] | None = None, strict_schema: bool = False,
                modules: ParsedModules | None = None) -> Index:
    """Parse once, write the relations the detectors share, derive the function flags.

    With ``modules`` only contents that these do not have yet are parsed (and added to them).

    Parsing is the expensive stage and feeds every detector, so its rows are written as
    a table.  Each task sorts its rows by kind, which lets readers skip the pages of
    other kinds without a shuffle and without a file per task and kind.
    """
    rows = fact_table(syntax_rows(given.python) if modules is None else parsed_rows(given.python, modules))
    facts = Facts(materialise(rows.sortWithinPartitions("kind"), "facts"))
    types = materialise(dt.doctypes(given.schema, strict=strict_schema), "doctypes")
    leaves = materialise(hk.hook_leaves(given.hooks), "hooks")
    graph = stored(build_call_graph(facts))
    return Index(
        facts=facts,
        symbols=materialise(symbols(facts, graph), "symbols"),
        doctypes=types,
        handlers=hk.hook_handlers(leaves, app_order),
        permission_hooks=hk.permission_hooks(leaves),
        document_classes=document_classes(facts.rows),
    )


def call_graph(ix: Index, *, with_hooks: bool = False) -> CallGraph:
    return build_call_graph(ix.facts, ix.handlers if with_hooks else None)


def comment_lines(ix: Index) -> DataFrame:
    """(repo, file, line, text) of lines that may silence a finding."""
    return ix.facts.rows.where(c("kind") == "line").select(
        "repo", c("path").alias("file"), c("line_start").alias("line"), c("name").alias("text")
    )


def findings(ix: Index, *, rules: list[str] | None = None, directive: str = fd.DIRECTIVE,
             false_positives: DataFrame | None = None, baseline: DataFrame | None = None,
             nearby_comments: bool = False, changed: DataFrame | None = None,
             proof_tiers: DataFrame | None = None, exclude: list[str] | None = None, log=None) -> DataFrame:
    """Scored findings: silenced, duplicate and known candidates removed.

    Order them for display with ``operators.findings.by_severity()``.
    """
    found = candidates(ix, rules, log)
    lines = comment_lines(ix)
    found = fd.silenced_on_line(found, lines, directive)
    if nearby_comments:
        found = fd.silenced_nearby(found, lines, directive)
    found = fd.deduplicate(found)
    if exclude:
        found = fd.exclude_paths(found, exclude)
    if false_positives is not None:
        found = fd.drop_false_positives(found, false_positives)
    if baseline is not None:
        found = fd.drop_known(found, baseline)
    guests = ix.facts.endpoints.where("allow_guest").select("repo", c("func").alias("function"))
    scored = fd.score(found, guests, proof_tiers).withColumn("id", fd.finding_id())
    return fd.only_changed(scored, changed) if changed is not None else scored


def scan_folders(spark: SparkSession, repos: dict[str, str], modules: ParsedModules | None = None, **options) -> DataFrame:
    return findings(build_index(ScanInput.of_folders(spark, repos), modules=modules), **options)


def scan_files(files: DataFrame, modules: ParsedModules | None = None, **options) -> DataFrame:
    """Scan files given as a table ``(repo, path, abs_path, content)``."""
    return findings(build_index(ScanInput.of_files(files), modules=modules), **options)
