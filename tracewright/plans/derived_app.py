"""Applications derived from the ``part`` table, one module per row.

The driver's tables hold no source code, so Spark writes it: every part becomes a
Python module whose statements depend on the part's size and type, every brand a
repository with schema documents, hook files and a shared helper.  The work of a
scan therefore grows with the table, and what it must find follows from the same
columns (see ``catalog``).  All expressions are plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import ScanInput

REPO = "lower(replace(p_brand, '#', ''))"
# the folder decides how a path is classified: report, test, workflow engine, plain
FOLDER = """CASE p_type WHEN 'PROMO' THEN 'promo_report' WHEN 'SMALL' THEN 'tests'
            WHEN 'MEDIUM' THEN 'workflow' ELSE lower(p_type) END"""
FILE = f"concat({FOLDER}, '/mod_', CAST(p_partkey AS VARCHAR(20)), '.py')"
DOCTYPE = """CASE p_type WHEN 'PROMO' THEN 'Promo' WHEN 'SMALL' THEN 'Small' WHEN 'LARGE' THEN 'Large'
             WHEN 'ECONOMY' THEN 'Economy Item' WHEN 'STANDARD' THEN 'Standard Item' ELSE 'Medium Item' END"""
CLASS = f"replace({DOCTYPE}, ' ', '')"
KEY = "CAST(p_partkey AS VARCHAR(20))"


def either(condition: str, yes: str, no: str) -> str:
    return f"CASE WHEN {condition} THEN {yes} ELSE {no} END"


# Source lines of a module, by line number.
LINES = {
    1: "'import frappe'",
    2: "'import requests'",
    3: "'from shared import save_status'",
    4: "''",
    5: either("p_size > 40", "'@frappe.whitelist(allow_guest=True)'", "'@frappe.whitelist()'"),
    6: f"concat('def read_', {KEY}, '(q, url=None, items=', {either('p_size <= 10', repr('[]'), repr('None'))}, '):')",
    7: either("p_size BETWEEN 11 AND 20", "'    frappe.only_for(\"Manager\")'", "'    text = q'"),
    8: either(
        "p_size <= 25",
        "'    frappe.db.sql(\"select * from tabPromo where x = %s\" % q)'",
        f"concat('    frappe.db.sql(\"select name from `tab', {DOCTYPE}, '` where x = %s\", (q,))')",
    ),
    9: either("p_size >= 30", "'    frappe.qb.from_(q)'", "'    frappe.qb.from_(\"Promo\")'"),
    10: either("p_type = 'LARGE'", "'    frappe.get_doc(q)'", "'    frappe.get_doc(\"Promo\", q)'"),
    11: either("p_size >= 49", "'    eval(q)'", "'    eval(\"1\")'"),
    12: either("p_type = 'STANDARD'", "'    requests.get(url)'", "'    requests.get(f\"https://host/{url}\")'"),
    13: either("p_size > 35", "'    open(q)'", "'    open(\"x\")'"),
    14: either("p_size < 5", "'    frappe.throw(\"bad\")'", "'    frappe.throw(_(\"bad\"))'"),
    15: "'    for row in frappe.get_all(\"Promo\"):'",
    16: either("p_size <= 8", "'        frappe.get_doc(\"Promo\", row.name)'", "'        frappe.get_doc({\"doctype\": \"Promo\"})'"),
    17: "'    try:'",
    18: "'        int(text)'",
    19: either("p_size BETWEEN 20 AND 30", "'    except Exception:'", "'    except ValueError:'"),
    20: "'        pass'",
    21: either("p_size >= 15", "'    return save_status(q)'", "'    return q'"),
    22: "''",
    23: f"concat('class ', {CLASS}, '(Document):')",
    24: "'    def on_submit(self):'",
    25: either("p_size > 45", "'        frappe.db.commit()'", "'        pass'"),
    26: either("p_type = 'ECONOMY'", "'        frappe.enqueue(\"m.f\")'", "'        frappe.enqueue(\"m.f\", job_id=\"x\")'"),
    27: either("p_size < 3", "'        return self.colour'", "'        return self.color'"),
    28: either("p_size > 22", "'    def on_cancel(self):'", "'    def on_trash(self):'"),
    29: "'        pass'",
    30: "''",
    31: either("p_size > 40", "'@frappe.whitelist(allow_guest=True)'", "'@frappe.whitelist()'"),
    32: f"concat('def write_', {KEY}, '(doc):')",
    33: either("p_size BETWEEN 28 AND 33", "'    frappe.has_permission(\"Promo\")'", "'    value = doc'"),
    34: f"""concat('    frappe.db.set_value("', {DOCTYPE}, '", doc, "',
           CASE WHEN p_size < 12 THEN 'status' WHEN p_size < 24 THEN 'workflow_state' WHEN p_size < 36 THEN 'color'
           ELSE 'seen' END, '", 1)')""",
    35: either("p_size > 18", "'    frappe.get_doc(\"Promo\", doc).save(ignore_permissions=True)'",
               "'    frappe.get_doc(\"Promo\", doc).save()'"),
    36: f"concat('    return step_', {KEY}, '(doc)')",
    37: "''",
    38: f"concat('def step_', {KEY}, '(doc):')",
    39: either("p_size <= 20", "'    frappe.db.set_value(\"Promo\", doc, \"status\", 2)'", "'    pass'"),
    40: either("p_size <= 6", "'    frappe.db.set_value(\"Promo\", doc, \"docstatus\", 2)'", "'    pass'"),
}
MODULE = "concat_ws(chr(10), " + ", ".join(LINES[n] for n in sorted(LINES)) + ")"

# One schema document and one hook file per (brand, type).
DOC_FOLDER = f"lower(replace({DOCTYPE}, ' ', '_'))"
SUBMITTABLE, CHILD, OWNED = "min(p_size) <= 4", "min(p_size) BETWEEN 5 AND 8", "max(p_size) >= 49"
SCHEMA = f"""concat('{{"doctype": "DocType", "name": "', {DOCTYPE}, '", "module": "Shop", "is_submittable": ',
    CASE WHEN {SUBMITTABLE} THEN '1' ELSE '0' END, ', "istable": ', CASE WHEN {CHILD} THEN 'true' ELSE 'false' END,
    ', "fields": [{{"fieldname": "color", "fieldtype": "Data"}}, {{"fieldname": "rows", "fieldtype": "Table", "options": "Large"}}],',
    '"permissions": [{{"role": "Clerk", "if_owner": ', CASE WHEN {OWNED} THEN '1' ELSE '0' END, '}}]}}')"""
EVENT = "CASE WHEN max(p_size) >= 50 THEN 'on_update' ELSE 'validate' END"
QUERY_HOOK, PERMISSION_HOOK = "count(*) >= 15", "count(*) >= 14"
HOOKS = f"""concat_ws(chr(10),
    concat('doc_events = {{"Shared": {{"', {EVENT}, '": "shared.', lower(p_type), '"}}}}'),
    CASE WHEN {QUERY_HOOK} THEN concat('permission_query_conditions = {{"', {DOCTYPE}, '": "shared.q"}}') ELSE '' END,
    CASE WHEN {PERMISSION_HOOK} THEN concat('has_permission = {{"', {DOCTYPE}, '": "shared.p"}}') ELSE '' END)"""

# One helper per brand, called across files.
SHARED_CHECK = "count(*) >= 80"
SHARED_LINES = {
    1: "'import frappe'",
    2: "'def save_status(doc):'",
    3: either(SHARED_CHECK, "'    frappe.only_for(\"Manager\")'", "'    value = doc'"),
    4: "'    frappe.db.set_value(\"Promo\", doc, \"status\", 3)'",
}
SHARED = "concat_ws(chr(10), " + ", ".join(SHARED_LINES.values()) + ")"


def _files(df: DataFrame, path: str, content: str) -> DataFrame:
    return df.select(
        F.expr(REPO).alias("repo"), F.expr(path).alias("path"), F.expr(f"concat('/src/', {REPO}, '/', {path})").alias("abs_path"),
        F.expr(content).cast("binary").alias("content"),
    )


#: rows of ``part`` whose modules one task parses (about a minute)
TASK_ROWS = 20_000


def spread(part: DataFrame) -> DataFrame:
    """The columns that modules are made of.  The table is one small file; parsing its modules is the work,
    so its rows are spread, over more tasks the more there are."""
    tasks = max(part.sparkSession.sparkContext.defaultParallelism * 2, part.count() // TASK_ROWS)
    columns = ["p_partkey", "p_brand", "p_type", "p_size"]
    return part.select(*columns).repartition(tasks, *columns)


def derived_sources(spark: SparkSession, sf_dir: str) -> ScanInput:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    modules = _files(spread(part), FILE, MODULE)

    def grouped(path: str, content: str, *by: str) -> DataFrame:
        made = part.groupBy(*by).agg(F.expr(content).cast("binary").alias("content"))
        return made.select(F.expr(REPO).alias("repo"), F.expr(path).alias("path"),
                           F.expr(f"concat('/src/', {REPO}, '/', {path})").alias("abs_path"), "content")

    return _with_others(modules, grouped)


def long_sources(spark: SparkSession, sf_dir: str, per_file: int = 6) -> ScanInput:
    """The same application with about ``per_file`` modules in each file (240 lines with six)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size")
    groups = part.select("p_brand", "p_type").distinct().count()
    files = max(1, part.count() // (groups * per_file))
    texts = part.groupBy("p_brand", "p_type", (F.col("p_partkey") % files).alias("file")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.expr(MODULE).alias("text")))), lambda x: x["text"]), "\n\n").alias("text"))
    path = F.concat(F.expr(FOLDER), F.lit("/all_"), "file", F.lit(".py"))
    modules = texts.select(F.expr(REPO).alias("repo"), path.alias("path"), F.concat_ws("/", F.lit("/src"), F.expr(REPO), path).alias("abs_path"),
                           F.col("text").cast("binary").alias("content")).repartition(spark.sparkContext.defaultParallelism * 2, "path")

    def grouped(path: str, content: str, *by: str) -> DataFrame:
        made = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(*by).agg(F.expr(content).cast("binary").alias("content"))
        return made.select(F.expr(REPO).alias("repo"), F.expr(path).alias("path"),
                           F.expr(f"concat('/src/', {REPO}, '/', {path})").alias("abs_path"), "content")

    return _with_others(modules, grouped)


def _with_others(modules: DataFrame, grouped) -> ScanInput:
    """With the shared helpers, schema documents and hook files."""
    shared = grouped("'shared.py'", SHARED, "p_brand")
    schema = grouped(f"concat('doc/', {DOC_FOLDER}, '/', {DOC_FOLDER}, '.json')", SCHEMA, "p_brand", "p_type")
    hooks = grouped("concat(lower(p_type), '/hooks.py')", HOOKS, "p_brand", "p_type")
    return ScanInput(modules.unionByName(shared), schema, hooks)
