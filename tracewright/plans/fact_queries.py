"""Queries on the intermediate relations of the derived application: facts, call
graph, schema documents, hooks, fixes, re-checks, reports of the scan."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sinks
from ..operators import fixes, ledger as lg
from ..operators import rules as rl
from ..sources import doctypes as dt
from ..sources import files as src
from ..session import materialise, work_dir
from ..sources.parsed import ParsedModules
from ..sources.python_source import syntax_rows
from . import derived_app as app
from .catalog import _ENABLED, derived_index, query
from .detector_oracle import union_sql, with_base
from .detectors import DETECTORS, candidates
from .scan import ScanInput, build_index, call_graph, findings

c = F.col

# Facts per module as a condition on the part (or per brand / per module constants).
_ALWAYS = "true"
_PER_MODULE = {
    "functions": [(5, _ALWAYS)],
    "endpoints": [(2, _ALWAYS)],
    "report_entry_points": [(0, _ALWAYS)],
    "calls": [(4, _ALWAYS), (1, "p_size >= 15"), (1, "p_size >= 5")],  # eval, open, int, step + save_status, _()
    "imports": [(3, _ALWAYS)],
    "unused_imports": [(1, "p_size < 15")],
    "string_dispatch_calls": [(1, _ALWAYS)],
    "dynamic_method_calls": [(1, _ALWAYS)],
    "unresolved_calls": [(0, _ALWAYS)],
    "sql_calls": [(1, _ALWAYS)],
    "permission_checks": [(1, "p_size BETWEEN 11 AND 20"), (1, "p_size BETWEEN 28 AND 33")],
    "commit_calls": [(1, "p_size > 45")],
    "set_value_calls": [(1, _ALWAYS), (1, "p_size <= 20"), (1, "p_size <= 6")],
    "direct_writes": [(1, _ALWAYS), (1, "p_size <= 20"), (1, "p_size <= 6")],
    # set_value, save, enqueue, commit
    "mutations": [(3, _ALWAYS), (1, "p_size <= 20"), (1, "p_size <= 6"), (1, "p_size > 45")],
    "path_accesses": [(1, "p_size > 35")],
    "enqueue_calls": [(1, _ALWAYS)],
    "eval_exec_calls": [(1, _ALWAYS)],
    "query_builder_calls": [(1, _ALWAYS)],
    "get_doc_kwargs": [(1, "p_type = 'LARGE'")],
    "ignore_permissions": [(1, "p_size > 18")],
    "hardcoded_user_strings": [(1, "p_size < 5")],
    "msgprint_calls": [(0, _ALWAYS)],
    "outbound_request_calls": [(1, "p_type = 'STANDARD'")],
    "bare_except_blocks": [(1, "p_size BETWEEN 20 AND 30")],
    "mutable_default_args": [(1, "p_size <= 10")],
    "queries_in_loop": [(1, "p_size <= 8")],
    "class_lifecycles": [(1, _ALWAYS)],
    "parse_errors": [(0, _ALWAYS)],
}
# what every brand's shared helper adds
_PER_BRAND = {"functions": "1", "imports": "1", "set_value_calls": "1", "direct_writes": "1", "mutations": "1",
              "permission_checks": "CASE WHEN n >= 80 THEN 1 ELSE 0 END"}
_RELATION_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS relation, (SELECT sum({' + '.join(f'CASE WHEN {w} THEN {k} ELSE 0 END' for k, w in terms)}) FROM part)"
    f" + (SELECT sum({_PER_BRAND.get(name, '0')}) FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)) AS n"
    for name, terms in _PER_MODULE.items())


@query("fact_relation_counts", f"SELECT relation, n::BIGINT AS n FROM ({_RELATION_SQL}) WHERE n > 0")
def fact_relation_counts(spark, sf):
    """Rows of every fact relation (relations without a row are left out)."""
    facts = derived_index(spark, sf).facts
    tagged = [getattr(facts, name).select(F.lit(name).alias("relation")) for name in _PER_MODULE]
    return reduce(lambda a, b: a.unionByName(b), tagged).groupBy("relation").agg(F.count("*").alias("n"))


@query("field_references", f"""SELECT lower(replace(p_brand, '#', '')) AS repo, {app.DOCTYPE} AS doctype,
  CASE WHEN p_size < 3 THEN 'colour' ELSE 'color' END AS fieldname, count(*) AS n FROM part GROUP BY 1, 2, 3""")
def field_references(spark, sf):
    ix = derived_index(spark, sf)
    return ix.facts.field_references(ix.document_classes).groupBy("repo", "doctype", "fieldname").agg(F.count("*").alias("n"))


@query("call_edges", f"""WITH p AS (SELECT {app.FILE} AS f, {app.KEY} AS k, {app.REPO} AS repo, p_size FROM part)
SELECT repo, f || ':write_' || k AS src, f || ':step_' || k AS dst, 'direct_call' AS kind, 1.0::DOUBLE AS confidence FROM p
UNION ALL SELECT repo, f || ':read_' || k, 'shared.py:save_status', 'direct_call', 1.0 FROM p WHERE p_size >= 15
UNION ALL SELECT repo, f || ':write_' || k, '*save', 'dynamic_method', 0.4 FROM p""")
def call_edges(spark, sf):
    return call_graph(derived_index(spark, sf), with_hooks=True).edges


@query("dynamic_targets", f"SELECT {app.REPO} AS repo, '*on_submit' AS hub, count(*) AS n FROM part GROUP BY 1")
def dynamic_targets(spark, sf):
    """The functions behind one hub of the graph, counted per repository."""
    members = call_graph(derived_index(spark, sf)).members.where(c("hub") == "*on_submit")
    return members.groupBy("repo", "hub").agg(F.count("*").alias("n"))


@query("unresolved_calls", f"""WITH p AS (SELECT {app.FILE} || ':read_' || {app.KEY} AS s, {app.REPO} AS repo, p_size FROM part)
SELECT repo, s || ':11:eval' AS call FROM p UNION ALL SELECT repo, s || ':13:open' FROM p UNION ALL SELECT repo, s || ':18:int' FROM p
UNION ALL SELECT repo, s || ':14:_' FROM p WHERE p_size >= 5""")
def unresolved_calls(spark, sf):
    return call_graph(derived_index(spark, sf)).unresolved


@query("symbol_flags", f"""WITH p AS (SELECT {app.FILE} AS f, {app.KEY} AS k, {app.REPO} AS repo, p_brand, p_size AS s FROM part),
b AS (SELECT p_brand, count(*) >= 80 AS checked FROM part GROUP BY 1)
SELECT repo, f || ':read_' || k AS symbol_id, (s BETWEEN 11 AND 20) OR (s >= 15 AND checked) AS guarded, s >= 15 AS mutates, true AS reachable FROM p JOIN b USING (p_brand)
UNION ALL SELECT repo, f || ':write_' || k, s BETWEEN 28 AND 33, true, true FROM p""")
def symbol_flags(spark, sf):
    flags = derived_index(spark, sf).symbols
    return flags.where("is_endpoint").select("repo", "symbol_id", "guarded", "mutates", "reachable")


_TYPES = f"""SELECT {app.REPO} AS repo, {app.DOCTYPE} AS name, {app.SUBMITTABLE} AS is_submittable, {app.CHILD} AS istable, {app.OWNED} AS owner_scoped,
  {app.QUERY_HOOK} AS q, {app.PERMISSION_HOOK} AS ph, {app.EVENT} AS event, lower(p_type) AS app FROM part GROUP BY p_brand, p_type"""


@query("doctype_index", f"SELECT repo, name, 'tab' || name AS table_name, is_submittable, istable, owner_scoped, 2 AS n_fields FROM ({_TYPES})")
def doctype_index(spark, sf):
    return derived_index(spark, sf).doctypes.select(
        "repo", "name", "table_name", "is_submittable", "istable", "owner_scoped", F.size("fields").alias("n_fields"))


@query("child_tables", f"SELECT repo, name AS parent, ['Large'] AS children FROM ({_TYPES})")
def child_tables(spark, sf):
    return dt.child_tables(derived_index(spark, sf).doctypes)


@query("hook_handlers", f"SELECT repo, app, 'Shared' AS doctype, event, 'shared.' || app AS handler FROM ({_TYPES})")
def hook_handlers(spark, sf):
    return derived_index(spark, sf).handlers.select("repo", "app", "doctype", "event", "handler")


@query("permission_hooks", f"""SELECT repo, 'permission_query_conditions' AS section, name AS doctype, 'shared.q' AS handler FROM ({_TYPES}) WHERE q
UNION ALL SELECT repo, 'has_permission', name, 'shared.p' FROM ({_TYPES}) WHERE ph""")
def permission_hooks(spark, sf):
    return derived_index(spark, sf).permission_hooks


def _python_files(spark, sf):
    return app.derived_sources(spark, sf).python


_RECHECKED = [r for r in _ENABLED if r in fixes.RECHECKED]


@query("recheck_findings", with_base(f"""SELECT rule_id, "function", file, line, repo, CASE WHEN rule_id = 'FR-SQLI-001' THEN 'skipped'
  WHEN coalesce(p_retailprice > 1200, false) THEN 'failed' ELSE 'passed' END AS status
  FROM ({union_sql([*_RECHECKED, 'FR-SQLI-001'])}) LEFT JOIN (SELECT {app.REPO} AS repo, {app.FILE} AS file, p_retailprice FROM part) USING (repo, file)"""))
def recheck_findings(spark, sf):
    """Findings against current sources, in which the modules of expensive parts are empty."""
    given = app.derived_sources(spark, sf)
    # the second index parses what the first has not: one content
    modules = ParsedModules(spark, f"{work_dir(spark)}/modules-{uuid.uuid4().hex}", parts=16)
    found = materialise(findings(build_index(given, modules=modules), rules=[*_RECHECKED, "FR-SQLI-001"]), "findings")
    emptied = spark.read.parquet(f"{sf}/part.parquet").where("p_retailprice > 1200").select(
        F.expr(app.REPO).alias("repo"), F.expr(app.FILE).alias("path"), F.lit(True).alias("_gone"))
    current = given.python.join(emptied, ["repo", "path"], "left").withColumn(
        "content", F.when(c("_gone"), F.lit("").cast("binary")).otherwise(c("content"))).drop("_gone")
    again = candidates(build_index(ScanInput(current, given.schema, given.hooks), modules=modules), rules=_RECHECKED)
    checked = fixes.recheck(found, again).select(c("finding_id").alias("id"), c("status").alias("outcome"))
    return found.join(checked, ["id"]).select("rule_id", "function", "file", "line", "repo", c("outcome").alias("status"))


_LINE_BREAK = "chr(10)"


def _fixed_module(rule: str, line: int = 32) -> str:
    """SQL of the module's text after the fix of a rule (at the function of a line)."""
    lines = dict(app.LINES)

    def add(after: int, *new: str) -> None:
        lines[after] = "concat(" + f", {_LINE_BREAK}, ".join([lines[after], *(f"'{x}'" for x in new)]) + ")"

    if rule == "FR-PERM-001":
        add(line, "    frappe.only_for(''System Manager'')")
    if rule == "FR-HOOK-001":
        add(29, "", "    def on_cancel(self):", "        # undo what on_submit does", "        pass")
    if rule == "FR-HOOK-004":
        lines[26] = f"concat(substr({lines[26]}, 1, length({lines[26]}) - 1), ', deduplicate=True)')"
    return f"concat_ws({_LINE_BREAK}, " + ", ".join(lines[n] for n in sorted(lines)) + ")"


@query("fix_previews", with_base(f"""SELECT f.rule_id, f.file, f.line, true AS is_valid, sha256(CASE WHEN f.rule_id = 'FR-HOOK-001' THEN {_fixed_module('FR-HOOK-001')}
    WHEN f.rule_id = 'FR-HOOK-004' THEN {_fixed_module('FR-HOOK-004')} WHEN f.line < 10 THEN {_fixed_module('FR-PERM-001', 6)}
    ELSE {_fixed_module('FR-PERM-001')} END) AS new_text
  FROM ({union_sql(['FR-HOOK-001', 'FR-HOOK-004', 'FR-PERM-001'])}) f LEFT JOIN part ON {app.REPO} = f.repo AND {app.FILE} = f.file"""))
def fix_previews(spark, sf):
    """Patches of all fixable findings, with the whole text of each (a handler that names its exception needs none)."""
    found = findings(derived_index(spark, sf), rules=["FR-HOOK-001", "FR-HOOK-004", "FR-HOOK-006", "FR-PERM-001"])
    patches = fixes.fix_previews(found, app.derived_sources(spark, sf).python)
    return patches.select("rule_id", "file", "line", "is_valid", F.sha2("modified_source", 256).alias("new_text"))


_RULES = ", ".join(f"('{d.rule_id}', '{d.version}', {str(d.enabled).lower()})" for d in DETECTORS)


@query("findings_by_rule", with_base(f"""SELECT r.rule_id, r.rule_version, r.enabled, regexp_replace(r.rule_id, '-[^-]*$', '') AS family,
  count(f.rule_id) AS n_findings, count(DISTINCT f.repo || '/' || f.file) AS n_files
  FROM (VALUES {_RULES}) r(rule_id, rule_version, enabled) LEFT JOIN ({union_sql(_ENABLED)}) f USING (rule_id) GROUP BY 1, 2, 3"""))
def findings_by_rule(spark, sf):
    return rl.by_rule(rl.rule_table(spark), findings(derived_index(spark, sf))).select(
        "rule_id", "rule_version", "enabled", "family", "n_findings", "n_files")


_LAID_OUT = """concat(CASE p_type WHEN 'PROMO' THEN 'node_modules' WHEN 'SMALL' THEN 'x/__pycache__' ELSE lower(p_type) END, '/', CASE
  WHEN p_size <= 10 THEN 'hooks.py' WHEN p_size <= 20 THEN concat('d', p_size, '/d', p_size, '.json') WHEN p_size <= 30 THEN concat('d', p_size, '/e.json')
  ELSE concat('m', p_size, '.py') END)"""


@query("discovery", f"""WITH f AS (SELECT p_partkey, p_size AS s, {_LAID_OUT} AS path FROM part WHERE p_type NOT IN ('PROMO', 'SMALL'))
SELECT 'python' AS kind, p_partkey, path FROM f WHERE s <= 10 OR s > 30 UNION ALL SELECT 'hooks', p_partkey, path FROM f WHERE s <= 10
UNION ALL SELECT 'schema', p_partkey, path FROM f WHERE s BETWEEN 11 AND 20""")
def discovery(spark, sf):
    """Which files a scan takes for what."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    names = part.select("p_partkey", F.lit("r").alias("repo"), F.expr(_LAID_OUT).alias("path"),
                        F.concat(F.lit("/src/"), F.expr(_LAID_OUT)).alias("abs_path"))
    kinds = {"python": src.python_files, "hooks": src.hook_files, "schema": src.doctype_files}
    return reduce(DataFrame.unionByName, [
        pick(names).select(F.lit(kind).alias("kind"), "p_partkey", "path") for kind, pick in kinds.items()])


@query("parse_errors", f"""SELECT {app.REPO} AS repo, {app.FILE} AS path, 'file cannot be read' AS problem FROM part WHERE p_size > 45
UNION ALL SELECT {app.REPO}, {app.FILE}, 'no text' FROM part WHERE p_size < 5""")
def parse_errors(spark, sf):
    """Files that cannot be read, and files that are no UTF-8 text, do not end a scan."""
    part = app.spread(spark.read.parquet(f"{sf}/part.parquet"))
    content = F.when(c("p_size") > 45, None).when(c("p_size") < 5, F.lit(bytearray(b"\xff\xfe"))).otherwise(F.expr(app.MODULE).cast("binary"))
    files = part.select(F.expr(app.REPO).alias("repo"), F.expr(app.FILE).alias("path"), content.alias("content"))
    errors = syntax_rows(files).where("kind = 'error'")
    problem = F.when(c("name") == "file cannot be read", c("name")).otherwise("no text")
    return errors.select("repo", "path", problem.alias("problem"))


@query("sarif_results", with_base(f"""SELECT rule_id, file, line, CASE WHEN score >= 60 THEN 'error' WHEN score >= 20 THEN 'warning' ELSE 'note' END AS level,
  greatest(line, 1) AS start_line FROM ({union_sql(_ENABLED)})"""))
def sarif_results(spark, sf):
    results = sinks.sarif_results(findings(derived_index(spark, sf)))
    return results.select(
        "rule_id", "file", "line", F.get_json_object("result", "$.level").alias("level"),
        F.get_json_object("result", "$.locations[0].physicalLocation.region.startLine").cast("int").alias("start_line"))


@query("csv_export", with_base(f"""SELECT rule_id, CASE WHEN score >= 60 THEN 'CRITICAL' WHEN score >= 40 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  score, file, line, "function", 'candidate' AS status FROM ({union_sql(_ENABLED)})"""))
def csv_export(spark, sf):
    return sinks.csv_rows(findings(derived_index(spark, sf)))


@query("ledger_from_scan", with_base(f"""SELECT repo, rule_id, file, "function", 'candidate' AS status, 0 AS proof_tier, code_location_hash,
  coalesce(CASE WHEN rule_id IN ('FR-SQLI-001', 'FR-SQLI-004', 'FR-INJ-002') THEN 'rce' WHEN rule_id IN ('FR-PERM-002', 'FR-PERM-003', 'FR-WKFL-002', 'FR-INJ-001', 'FR-CSRF-001') THEN 'privilege_escalation'
    WHEN rule_id = 'FR-PERM-001' THEN CASE WHEN fix_confidence = 'low' THEN 'data_exposure' ELSE 'privilege_escalation' END
    WHEN rule_id IN ('FR-SQLI-002', 'FR-PERM-004', 'FR-PERM-005', 'FR-SSRF-001', 'FR-PATH-001') THEN 'data_exposure'
    WHEN rule_id IN ('FR-HOOK-006', 'FR-HOOK-007', 'FR-DATA-001', 'FR-PERF-001', 'FR-I18N-001') THEN NULL ELSE 'data_corruption' END, 'unknown') AS impact_class FROM ({union_sql(_ENABLED)})"""))
def ledger_from_scan(spark, sf):
    rows = lg.ledger_rows(findings(derived_index(spark, sf)), "2026-01-01")
    return rows.select("repo", "rule_id", "file", "function", "status", "proof_tier", "code_location_hash", "impact_class")


