"""Hook declarations (``hooks.py``) as rows."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_order
from ..session import ship_package
from ..schemas import HOOK_LEAVES, arrow_schema

c = F.col
SECTIONS = ("doc_events", "permission_query_conditions", "has_permission")


def _leaves(value, keys=()):
    """String leaves of nested dicts, with the keys leading there."""
    if isinstance(value, str):
        yield keys, value, None
    elif isinstance(value, list):
        for item, text in enumerate(value):
            if isinstance(text, str):
                yield keys, text, item
    elif isinstance(value, dict):
        for key, child in value.items():
            if isinstance(key, str):
                yield from _leaves(child, keys + (key,))


def hook_rows(content: bytes | None) -> list[dict]:
    """Leaves of one file; a file that cannot be read or parsed is one problem."""
    try:
        return _hook_rows(content)
    except (SyntaxError, ValueError, AttributeError, RecursionError, MemoryError):
        return [{"problem": "parse_error", "pos": 0}]


def _hook_rows(content):
    tree = ast.parse(content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"))
    assigned, rows = {}, []
    for node in tree.body:
        for target in node.targets if isinstance(node, ast.Assign) else ():
            if isinstance(target, ast.Name):
                try:
                    assigned[target.id] = ast.literal_eval(node.value)
                except (ValueError, TypeError, RecursionError, MemoryError):
                    rows.append({"problem": target.id})
    for section in SECTIONS:
        if isinstance(assigned.get(section), dict):
            rows += [{"section": section, "keys": list(keys), "value": value, "item": item}
                     for keys, value, item in _leaves(assigned[section])]
    for position, row in enumerate(rows):
        row["pos"] = position
    return rows


def hook_leaves(hook_files: DataFrame) -> DataFrame:
    """Every literal string of the hook sections, plus one row per problem."""
    schema = arrow_schema(HOOK_LEAVES)
    ship_package(hook_files.sparkSession)
    parts = F.split("path", "/")
    app = F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(
        F.coalesce(F.get(F.split("abs_path", "/"), F.size(F.split("abs_path", "/")) - 2), F.lit(""))
    )

    def parse(batches):
        for batch in batches:
            rows = []
            for source in batch.to_pylist():
                content = source.pop("content")
                rows += [{**source, **row} for row in hook_rows(content)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return hook_files.select("repo", "path", "abs_path", app.alias("app"), "content").mapInArrow(parse, HOOK_LEAVES)


def hook_handlers(leaves: DataFrame, app_order: list[str] | None = None) -> DataFrame:
    """(repo, app, doctype, event, handler, ord): ``ord`` sorts in declaration order.

    ``app_order`` puts the handlers of the listed apps first, in that order.
    """
    rank = F.lit(0)
    if app_order:
        rank = F.lit(len(app_order))
        for position, app in enumerate(app_order):
            rank = F.when(c("app") == app, position).otherwise(rank)
    return leaves.where((c("section") == "doc_events") & (F.size("keys") == 2)).select(
        "repo", "app", c("keys")[0].alias("doctype"), c("keys")[1].alias("event"), c("value").alias("handler"),
        F.struct(rank.alias("rank"), path_order("path").alias("file"), c("pos").alias("pos")).alias("ord"),
        "path", "abs_path",
    )


def permission_hooks(leaves: DataFrame) -> DataFrame:
    """(repo, section, doctype, handler): the last file that names a doctype wins."""
    declared = leaves.where(
        c("section").isin("permission_query_conditions", "has_permission")
        & (F.size("keys") == 1) & c("item").isNull()
    )
    return declared.groupBy("repo", "section", c("keys")[0].alias("doctype")).agg(
        F.max_by("value", F.struct(path_order("path"), c("pos"))).alias("handler")
    )


def handlers_for(handlers: DataFrame, doctype: str, event: str) -> DataFrame:
    return handlers.where((c("doctype") == doctype) & (c("event") == event))


def permission_hooks_for(hooks: DataFrame, doctype: str) -> DataFrame:
    return hooks.where(c("doctype") == doctype)


def unresolved_hooks(leaves: DataFrame) -> DataFrame:
    return leaves.where(c("problem").isNotNull()).select(
        "repo", F.concat_ws(":", "abs_path", "problem").alias("unresolved")
    )


def collisions(handlers: DataFrame) -> DataFrame:
    """(doctype, event) pairs hooked by more than one app."""
    return (
        handlers.groupBy("repo", "doctype", "event")
        .agg(
            F.count_distinct("app").alias("n_apps"), F.count("*").alias("n_handlers"),
            F.min_by("abs_path", "ord").alias("first_path"),
            # handlers of one event are few; in declaration order
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "app", "handler"))), lambda h: F.struct(
                h["app"].alias("app"), h["handler"].alias("handler"))).alias("handlers"),
        )
        .where("n_apps > 1")
    )
