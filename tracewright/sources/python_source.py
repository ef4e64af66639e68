"""Python files as syntax rows: one narrow, embarrassingly parallel stage."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import framework as fw
from ..session import ship_package
from ..schemas import SYNTAX_ROWS, arrow_schema
from .syntax import Watch, module_rows

ROWS_PER_BATCH = 4096

FRAMEWORK_WATCH = Watch(
    calls=frozenset(fw.WATCHED_CALLS),
    methods=frozenset(fw.WATCHED_METHODS),
    attributes=frozenset(fw.WATCHED_ATTRIBUTES),
    test_suffixes=fw.WATCHED_TEST_SUFFIXES,
    loop_sources=frozenset(fw.LIST_QUERY_CALLS),
    line_marker="ignore",
)


def syntax_rows(source_files: DataFrame, watch: Watch = FRAMEWORK_WATCH, mark: str | None = None) -> DataFrame:
    """``(repo, path, content)`` -> syntax rows.

    Files are parsed where they are read; ``content`` does not leave the stage.
    Rows are handed over in bounded batches, so a huge file costs no more memory
    than its own syntax tree.  With ``mark`` every file has a row of that kind as well.
    """
    schema = arrow_schema(SYNTAX_ROWS)
    ship_package(source_files.sparkSession)

    def parse(batches):
        # syntax trees hold no reference cycles, so the cycle collector only costs time
        gc.disable()
        try:
            yield from rows_of(batches)
        finally:
            gc.enable()

    def rows_of(batches):
        pending: list[dict] = []
        for batch in batches:
            for repo, path, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                marks = [{"kind": mark, "path": path}] if mark else []
                for row in module_rows(path, content, watch) + marks:
                    row["repo"] = repo
                    pending.append(row)
                    if len(pending) >= ROWS_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(pending, schema=schema)
                        pending = []
        if pending:
            yield pa.RecordBatch.from_pylist(pending, schema=schema)

    return source_files.select("repo", "path", "content").mapInArrow(parse, SYNTAX_ROWS)
