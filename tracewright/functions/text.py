"""Scalar building blocks as Spark columns: hashes, paths, tokens, patterns."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def stable_hash(text, length: int = 16) -> Column:
    """First hex digits of SHA-256 (16 for locations and ids, 32 for baselines)."""
    return F.substring(F.sha2(col(text), 256), 1, length)


# ---- paths -------------------------------------------------------------------
def path_parts(path) -> Column:
    return F.split(F.lower(F.replace(col(path), F.lit("\\"), F.lit("/"))), "/")


def path_order(path) -> Column:
    """Sort key that orders paths part by part ('a/b' before 'a-b/c')."""
    return F.translate(col(path), "/", "\u0001")


def is_non_runtime_path(path) -> Column:
    parts = path_parts(path)
    file_name = F.element_at(parts, -1)
    return (
        F.arrays_overlap(parts, F.array(F.lit("patches"), F.lit("tests")))
        | file_name.startswith("test_")
        | file_name.isin("setup.py", "install.py")
    )


def is_workflow_path(path) -> Column:
    return F.arrays_overlap(path_parts(path), F.array(F.lit("workflow"), F.lit("workflow_action")))


def is_report_path(path) -> Column:
    return F.exists(path_parts(path), lambda p: (p == "report") | p.endswith("_report"))


def path_suffixes(path) -> Column:
    """Every suffix of a path that starts at a part boundary, the path itself included."""
    parts = F.split(col(path), "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "/"))


def module_keys(path) -> Column:
    """Module paths (``a/b``) under which a file can be imported."""
    suffixes = path_suffixes(path)
    plain = F.transform(F.filter(suffixes, lambda s: s.endswith(".py")), lambda s: F.regexp_replace(s, r"\.py$", ""))
    package = F.transform(
        F.filter(suffixes, lambda s: s.endswith("/__init__.py")),
        lambda s: F.regexp_replace(s, r"/__init__\.py$", ""),
    )
    return F.array_distinct(F.concat(plain, package))


def module_path(path) -> Column:
    """A file's own module path: its path without ``.py`` or ``/__init__.py``."""
    return F.regexp_replace(col(path), r"(/__init__)?\.py$", "")


# ---- names -------------------------------------------------------------------
def last_segment(name) -> Column:
    return F.substring_index(col(name), ".", -1)


def rule_family(rule_id) -> Column:
    return F.regexp_replace(col(rule_id), "-[^-]*$", "")


def symbol_function(symbol_id) -> Column:
    return F.substring_index(col(symbol_id), ":", -1)


def spaced_class_name(name) -> Column:
    """``POSInvoice`` -> ``POS Invoice``: a run of capitals stays one word."""
    # before a capital: after a small letter or digit, or where a run of capitals ends in a word
    return F.regexp_replace(col(name), "(?=[A-Z])(?<=[a-z0-9])|(?=[A-Z][a-z])(?<=[A-Z])", " ")


# ---- tokens and mentions -----------------------------------------------------
def identifiers(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit("([A-Za-z0-9_]+)"), 1))


def first_identifier(text) -> Column:
    return F.regexp_extract(col(text), "([A-Za-z0-9_]+)", 1)


def mentions_name(text, name) -> Column:
    """``name`` occurs in ``text`` as a whole (case ignored, optional backticks)."""
    quoted = F.regexp_replace(col(name), r"([^A-Za-z0-9_ ])", r"\\$1")
    # fixed values: what stands around a name in a text that mentions it
    pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9_])`?"), quoted, F.lit("`?(?![A-Za-z0-9_])"))
    return F.regexp_like(col(text), pattern)


def glob_pattern(glob: str) -> str:
    """Anchored Java regular expression of a shell glob (``*`` also crosses ``/``)."""
    body = fnmatch.translate(glob)
    body = re.sub(r"\\[zZ]$", "", body)
    return f"^(?:{body})$"


def matches_any_glob(path, globs) -> Column:
    """A glob matches the whole path or its last part."""
    base = F.substring_index(col(path), "/", -1)
    hit = F.lit(False)
    for glob in globs:
        pattern = glob_pattern(glob)
        hit = hit | col(path).rlike(pattern) | base.rlike(pattern)
    return hit


def contains_text(query: str, *columns) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *[col(c) for c in columns])), F.lit(query.lower()))


def has_line_break(text) -> Column:
    return col(text).rlike(r"[\r\n]")


def python_lines(text) -> Column:
    """Lines as ``str.splitlines`` cuts them (all its boundaries, no empty tail)."""
    cut = F.split(col(text), "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]")
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


# ---- small value helpers -----------------------------------------------------
def any_starts_with(names, prefixes) -> Column:
    test = lambda n: _any(n.startswith(p) for p in prefixes)
    return F.coalesce(F.exists(names, test), F.lit(False))


def any_in(names, values) -> Column:
    return F.coalesce(F.arrays_overlap(names, F.array(*[F.lit(v) for v in values])), F.lit(False))


def _any(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


any_of = _any


def line_number(value) -> Column:
    """Line as given by a user: blank -> 1, not a number -> NULL, below 1 -> 1."""
    text = col(value).cast("string")
    number = text.try_cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(1)).otherwise(
        F.when(number.isNotNull(), F.greatest(number, F.lit(1)))
    )


def plain_status(value) -> Column:
    text = F.lower(col(value))
    return (
        F.when(text.isin("proven", "passed", "pass"), "proven")
        .when(text.isin("refuted", "failed", "fail"), "refuted")
        .when(text.isin("skipped", "skip"), "skipped")
        .otherwise("candidate")
    )
