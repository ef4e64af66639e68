"""Schema documents (JSON) as typed rows, parsed with VARIANT expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_order

c = F.col


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(value: Column) -> Column:
    """The value when it is a JSON string, else NULL."""
    return F.when(_type(value) == "STRING", F.try_variant_get(value, "$", "string"))


# --- fixed values: JSON texts that count as "not set" ---
_EMPTY = ("null", "false", "0", "0.0", "-0", "-0.0", '""', "[]", "{}")


def _truthy(value: Column) -> Column:
    """Emptiness decides, not meaning: ``"0"`` is true, ``0`` and ``""`` are false."""
    return F.coalesce(~F.to_json(value).isin(*_EMPTY), F.lit(False))


def _get(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def _items(value: Column) -> Column:
    listed = F.when(_type(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    objects = F.filter(F.coalesce(listed, F.array().cast("array<variant>")), lambda v: _type(v).startswith("OBJECT"))
    return objects


def parse(doctype_files: DataFrame) -> DataFrame:
    """One row per file: parsed columns, or ``problem`` when it is malformed.

    Rows of well-formed JSON that is not a schema document are dropped.
    """
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8"))
    # exploding keeps the optimizer from copying the parse into each of its many uses
    read = doctype_files.select("repo", "path", "abs_path", F.explode(F.array(F.try_parse_json(text))).alias("v"))
    root = c("v")
    is_object = F.coalesce(_type(root).startswith("OBJECT"), F.lit(False))
    marker = _text(_get(root, "doctype"))
    name_value = _get(root, "name")
    name = F.when(_truthy(name_value), _text(name_value)).otherwise(marker)
    module = _text(_get(root, "module"))
    problem = (
        F.when(root.isNull(), "parse_error")
        .when(~is_object, "invalid_doctype")
        .when(name.isNull() | (name == ""), "missing_required_key: name")
        .when(module.isNull() | (module == ""), "missing_required_key: module")
    )
    fields = F.filter(
        F.transform(_items(_get(root, "fields")), lambda v: F.struct(
            _text(_get(v, "fieldname")).alias("fieldname"), _text(_get(v, "fieldtype")).alias("fieldtype"),
            _text(_get(v, "options")).alias("options"))),
        lambda f: f["fieldname"].isNotNull() & f["fieldtype"].isNotNull(),
    )
    level = lambda v: F.coalesce(F.try_variant_get(v, "$.permlevel", "int"), F.lit(0))
    flags = ("read", "write", "create", "submit", "cancel", "if_owner")
    permissions = F.filter(
        F.transform(_items(_get(root, "permissions")), lambda v: F.struct(
            _text(_get(v, "role")).alias("role"), level(v).alias("permlevel"),
            *[_truthy(_get(v, f)).alias(f) for f in flags])),
        lambda p: p["role"].isNotNull(),
    )
    return (
        read.where(~is_object | F.coalesce(marker == "DocType", F.lit(False)))
        .select(
            "repo", "path", "abs_path", problem.alias("problem"), name.alias("name"), module.alias("module"),
            F.concat(F.lit("tab"), name).alias("table_name"),
            *[_truthy(_get(root, k)).alias(k) for k in ("is_submittable", "istable", "is_amendable")],
            _text(_get(root, "autoname")).alias("autoname"), fields.alias("fields"),
            permissions.alias("permissions"),
        )
    )


def doctypes(doctype_files: DataFrame, *, strict: bool = False) -> DataFrame:
    """Document types, one per (repo, name): the first file in path order wins.

    ``strict`` fails the job on the first malformed file instead of skipping it.
    """
    parsed = parse(doctype_files)
    if strict:
        message = F.concat(c("problem"), F.lit(": "), c("path"))
        bad = F.when(c("problem").isNotNull(), F.raise_error(message).cast("string"))
        parsed = parsed.withColumn("problem", bad)
    kept = parsed.where(c("problem").isNull()).drop("problem", "abs_path")
    rest = F.struct(*[name for name in kept.columns if name not in ("repo", "name")])
    # min_by combines before the shuffle, so many copies of one type are no hot spot
    first = kept.groupBy("repo", "name").agg(F.min_by(rest, path_order("path")).alias("d"))
    return first.select("repo", "name", "d.*").withColumn(
        "owner_scoped", F.exists("permissions", lambda p: p["if_owner"])
    )


def child_tables(doctypes_df: DataFrame) -> DataFrame:
    """Parent type -> the child types its table fields point to, in field order."""
    exploded = doctypes_df.select("repo", c("name").alias("parent"), F.posexplode("fields").alias("pos", "f")).where(
        (c("f.fieldtype") == "Table") & (F.coalesce(c("f.options"), F.lit("")) != "")
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", c("f.options").alias("child"))))
    return exploded.groupBy("repo", "parent").agg(F.transform(ordered, lambda s: s["child"]).alias("children"))
