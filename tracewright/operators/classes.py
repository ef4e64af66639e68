"""Which classes are document controllers (inheritance across files)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_order, spaced_class_name
from ..session import materialise

c = F.col


def document_classes(rows: DataFrame) -> DataFrame:
    """(repo, path, cls, name, doctype) of every document controller class.

    Files are taken in path order.  A class counts when a base is called
    ``*Document``, when an unqualified base names any class seen earlier, or when
    a qualified base (``module.Base``) names an earlier controller.  Only the last
    case is recursive; it is closed by joining the newly found controllers until
    none is added.
    """
    classes = rows.where(c("kind") == "class").select(
        "repo", "path", "cls", "name", "bases",
        F.struct(path_order("path").alias("file"), c("cls").alias("cls")).alias("pos"),
    )
    bases = classes.select("repo", "path", "cls", "name", "pos", F.explode("bases").alias("b")).select(
        "repo", "path", "cls", "name", "pos", c("b.name").alias("base"), c("b.qualified").alias("qualified")
    )
    first_seen = classes.groupBy("repo", c("name").alias("base")).agg(F.min("pos").alias("first_pos"))
    key = ["repo", "path", "cls", "name", "pos"]
    # the usual base is decided by its name alone and stays out of the join
    named = c("base").endswith("Document")
    seen = bases.where(~c("qualified") & ~named).join(first_seen, ["repo", "base"]).where(c("first_pos") < c("pos"))
    direct = bases.where(named).select(*key).unionByName(seen.select(*key))
    found = direct.distinct()
    open_bases = bases.where(c("qualified") & ~c("base").endswith("Document"))
    if not open_bases.isEmpty():
        found = _close(found, open_bases, key)
    return found.select("repo", "path", "cls", "name", spaced_class_name("name").alias("doctype"))


def _close(found: DataFrame, open_bases: DataFrame, key: list[str]) -> DataFrame:
    found = materialise(found, "document-classes")
    frontier, parts = found, [found]
    while True:
        earliest = frontier.groupBy("repo", c("name").alias("base")).agg(F.min("pos").alias("first_pos"))
        known = parts[0]
        for part in parts[1:]:
            known = known.unionByName(part)
        new = (
            open_bases.join(earliest, ["repo", "base"])
            .where(c("first_pos") < c("pos"))
            .select(*key).distinct()
            .join(known.select("repo", "path", "cls"), ["repo", "path", "cls"], "left_anti")
        )
        new = materialise(new, "document-classes")
        if new.isEmpty():
            return known
        parts.append(new)
        frontier = new
