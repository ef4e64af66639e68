"""A second derived application, from ``supplier``: what the modules of ``derived_app`` lack.

Every supplier becomes a module, every nation a repository.  Modules hold report entry points,
messages with request data, calls without a name, dispatches by dotted path (some of
which lead nowhere), submit handlers; hook files hook functions and declare the same
permission hooks twice.  The queries below compare what a scan finds in it with SQL
over the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..session import materialise, work_dir, work_tables
from ..streaming import incremental as st
from .catalog import query
from .detectors import rule, unregister
from .scan import ScanInput, build_index, call_graph, findings

c = F.col
REPO = "concat('n', s_nationkey)"
KEY = "CAST(s_suppkey AS VARCHAR(20))"
# even suppliers are reports
FILE = f"concat(CASE WHEN s_suppkey % 2 = 0 THEN 'crm_report/' ELSE 'lib/' END, 'm_', {KEY}, '.py')"
NEXT = "CAST(s_suppkey + 2 AS VARCHAR(20))"

LINES = {
    1: "'import frappe'",
    2: "'def execute(filters):'",
    3: "CASE WHEN s_acctbal > 5000 THEN '    frappe.msgprint(filters)' ELSE '    frappe.msgprint(\"ready\")' END",
    4: "CASE WHEN s_acctbal < 2000 THEN '    [print][0](filters)' ELSE '    pass' END",
    5: f"concat('    return frappe.call(\"lib.m_', {NEXT}, '.target_', {NEXT}, '\")')",
    6: "''",
    7: "'@frappe.whitelist()'",
    8: f"concat('def entry_', {KEY}, '(q):')",
    9: "CASE WHEN s_acctbal > 0 THEN '    frappe.msgprint(frappe.form_dict.q)' ELSE '    frappe.msgprint(_(q))' END",
    10: f"concat('    frappe.enqueue(\"target_', {KEY}, '\")')",
    11: "''",
    12: f"concat('def target_', {KEY}, '(doc):')",
    13: "CASE WHEN s_acctbal < 4000 THEN '    frappe.only_for(\"Manager\")' ELSE '    return doc' END",
    14: "''",
    15: f"concat('class Order', {KEY}, '(Document):')",
    16: "'    def on_submit(self):'",
    17: "'        pass'",
    18: "CASE WHEN s_acctbal > 7000 THEN '    def before_insert(self):' ELSE '    def validate(self):' END",
    19: "'        pass'",
}
MODULE = "concat_ws(chr(10), " + ", ".join(LINES[n] for n in sorted(LINES)) + ")"
# two hook files of a repository, of which the second one's permission hooks count
FIRST_HOOKS = """concat('doc_events = {"Order": {"validate": "lib.m_', CAST(min(s_suppkey) AS VARCHAR(20)), '.target_',
    CAST(min(s_suppkey) AS VARCHAR(20)), '"}}', chr(10), 'permission_query_conditions = {"Order": "first.q", "Note": "first.n"}')"""
SECOND_HOOKS = """concat('doc_events = {"Order": {"on_update": ["nowhere.f", "execute"]}}', chr(10),
    'permission_query_conditions = {"Order": "second.q', CAST(max(s_suppkey) AS VARCHAR(20)), '"}', chr(10), 'has_permission = {"Note": "second.h"}')"""


def supplier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content) of all files."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    spread = suppliers.select("s_suppkey", "s_nationkey", "s_acctbal").repartition(spark.sparkContext.defaultParallelism, "s_suppkey")
    modules = spread.select(F.expr(REPO).alias("repo"), F.expr(FILE).alias("path"), F.expr(MODULE).cast("binary").alias("content"))
    for path, text in (("a/hooks.py", FIRST_HOOKS), ("b/hooks.py", SECOND_HOOKS)):
        hooks = suppliers.groupBy("s_nationkey").agg(F.expr(text).cast("binary").alias("content"))
        modules = modules.unionByName(hooks.select(F.expr(REPO).alias("repo"), F.lit(path).alias("path"), "content"))
    return modules


def supplier_index(spark, sf_dir):
    from ..sources.files import from_table

    return build_index(ScanInput.of_files(materialise(from_table(supplier_files(spark, sf_dir)), "files")))


_S = f"s AS (SELECT *, {REPO} AS repo, {FILE} AS file, {KEY} AS k, s_acctbal AS b, s_suppkey % 2 = 0 AS report FROM supplier)"


def _hash(first: int, last: int | None = None) -> str:
    lines = [LINES[n] for n in range(first, (last or first) + 1)]
    return f"substr(sha256(concat_ws(chr(10), {', '.join(lines)})), 1, 16)"


@query("supplier_facts", f"""WITH {_S} SELECT repo, 'report_entry_points' AS relation, count(*) FILTER (report) AS n FROM s GROUP BY repo HAVING count(*) FILTER (report) > 0
UNION ALL SELECT repo, 'msgprint_calls', count(*) FILTER (b > 5000) + count(*) FILTER (b > 0) FROM s GROUP BY repo HAVING count(*) FILTER (b > 5000) + count(*) FILTER (b > 0) > 0
UNION ALL SELECT repo, 'unresolved_calls', count(*) FILTER (b < 2000) FROM s GROUP BY repo HAVING count(*) FILTER (b < 2000) > 0
UNION ALL SELECT repo, 'string_dispatch_calls', 2 * count(*) FROM s GROUP BY repo
UNION ALL SELECT repo, 'permission_checks', count(*) FILTER (b < 4000) FROM s GROUP BY repo HAVING count(*) FILTER (b < 4000) > 0""")
def supplier_facts(spark, sf):
    """Relations that the modules of parts do not have, by repository."""
    facts = supplier_index(spark, sf).facts
    tagged = [getattr(facts, name).select("repo", F.lit(name).alias("relation")) for name in (
        "report_entry_points", "msgprint_calls", "unresolved_calls", "string_dispatch_calls", "permission_checks")]
    rows = tagged[0]
    for part in tagged[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("repo", "relation").agg(F.count(F.lit(1)).alias("n"))


@query("dispatch_edges", f"""WITH {_S}, lib AS (SELECT repo, file, k, s_suppkey FROM s WHERE NOT report),
first AS (SELECT repo, min(s_suppkey) AS k FROM s GROUP BY repo), executes AS (SELECT repo, max(file) AS file FROM s GROUP BY repo)
SELECT s.repo, s.file || ':execute' AS src, lib.file || ':target_' || lib.k AS dst, 'string_dispatch' AS kind, 0.9::DOUBLE AS confidence
  FROM s JOIN lib ON lib.repo = s.repo AND lib.s_suppkey = s.s_suppkey + 2
UNION ALL SELECT repo, file || ':entry_' || k, file || ':target_' || k, 'string_dispatch', 0.9 FROM s
UNION ALL SELECT first.repo, '__framework_hook_root__', lib.file || ':target_' || lib.k, 'hook_dispatch', 0.85 FROM first JOIN lib ON lib.repo = first.repo AND lib.s_suppkey = first.k
UNION ALL SELECT repo, '__framework_hook_root__', file || ':execute', 'hook_dispatch', 0.85 FROM executes""")
def dispatch_edges(spark, sf):
    """Edges by dotted path (module and name, or a name alone, of which the last one counts) and by hooks."""
    return call_graph(supplier_index(spark, sf), with_hooks=True).edges.where(c("kind").isin("string_dispatch", "hook_dispatch"))


@query("last_permission_hooks", f"""WITH {_S} SELECT repo, 'permission_query_conditions' AS section, 'Order' AS doctype, 'second.q' || max(s_suppkey) AS handler FROM s GROUP BY repo
UNION ALL SELECT DISTINCT repo, 'permission_query_conditions', 'Note', 'first.n' FROM s UNION ALL SELECT DISTINCT repo, 'has_permission', 'Note', 'second.h' FROM s""")
def last_permission_hooks(spark, sf):
    """Two files declare the same permission hook: the last one wins."""
    return supplier_index(spark, sf).permission_hooks


_FOUND = ("repo", "rule_id", "file", "line", "function", "code_location_hash")
_MESSAGES = f"""SELECT repo, 'FR-INJ-005' AS rule_id, file, 3 AS line, 'execute' AS "function", {_hash(3)} AS code_location_hash FROM s WHERE report AND b > 5000
UNION ALL SELECT repo, 'FR-INJ-005', file, 9, 'entry_' || k, {_hash(9)} FROM s WHERE b > 0"""
_AMENDED = f"""SELECT repo, 'FR-WKFL-004' AS rule_id, file, 15 AS line, 'Order' || k AS "function", {_hash(15, 19)} AS code_location_hash FROM s WHERE b <= 7000"""


@query("detect_inj_005", f"WITH {_S} {_MESSAGES}")
def detect_inj_005(spark, sf):
    """A detector that is off by default, asked for by name."""
    return findings(supplier_index(spark, sf), rules=["FR-INJ-005"]).select(*_FOUND)


@query("detect_wkfl_004", f"WITH {_S} {_AMENDED}")
def detect_wkfl_004(spark, sf):
    """A detector that is off by default; no type is amendable, so all submit handlers count."""
    return findings(supplier_index(spark, sf), rules=["FR-WKFL-004"]).select(*_FOUND)


@query("own_rule", f"""WITH {_S} SELECT repo, 'MY-001' AS rule_id, file, 8 AS line, 'entry_' || k AS "function", {_hash(8, 10)} AS code_location_hash FROM s""")
def own_rule(spark, sf):
    """A detector of one's own: every endpoint."""
    @rule("MY-001")
    def endpoints(ix):
        return ix.facts.endpoints.select("repo", c("path").alias("file"), c("line_start").alias("line"), c("func").alias("function"),
                                         c("hash").alias("code_location_hash"), F.lit("an endpoint").alias("evidence"))

    try:
        return findings(supplier_index(spark, sf), rules=["MY-001"]).select(*_FOUND)
    finally:
        unregister("MY-001")


@query("baseline_round_trip", f"""WITH {_S}, f AS ({_MESSAGES}) SELECT substr(sha256(concat_ws('|', rule_id, file, "function", code_location_hash)), 1, 32) AS fingerprint
FROM f GROUP BY 1""")
def baseline_round_trip(spark, sf):
    """Fingerprints written as a baseline and read again."""
    path = f"{work_dir(spark)}/baseline-{uuid.uuid4().hex}"
    sinks.write_baseline(findings(supplier_index(spark, sf), rules=["FR-INJ-005"]), path)
    return sinks.read_baseline(spark, path)


@query("payload_document", f"""WITH {_S}, f AS ({_MESSAGES}), names AS (SELECT repo, row_number() OVER (ORDER BY repo) - 1 AS section FROM (SELECT DISTINCT repo FROM s))
SELECT names.repo, CAST(2 * section + 1 AS INT) AS section, row_number() OVER (PARTITION BY names.repo ORDER BY file, line) > 1 AS comma, line, file FROM names JOIN f ON f.repo = names.repo""")
def payload_document(spark, sf):
    """The results of several repositories as lines of one document, read back line by line."""
    found = materialise(findings(supplier_index(spark, sf), rules=["FR-INJ-005"]), "findings")
    repos = [r.repo for r in supplier_files(spark, sf).select("repo").distinct().collect()]  # one for each nation
    lines = sinks.payload_by_repo(found, repos).where("section % 2 = 1")
    entry = F.regexp_replace("line", "^,", "")
    return lines.select(
        F.get_json_object(entry, "$.repo").alias("repo"), "section", c("line").startswith(",").alias("comma"),
        F.get_json_object(entry, "$.line").cast("int").alias("line"), F.get_json_object(entry, "$.file").alias("file"))


@query("stream_findings", f"""WITH {_S}, f AS ({_MESSAGES} UNION ALL {_AMENDED}) SELECT f.* FROM f
UNION ALL SELECT repo, 'FR-INJ-005', 'late_report/m_' || k || '.py', 3, 'execute', {_hash(3)} FROM s WHERE s_suppkey % 10 = 1 AND b > 5000
UNION ALL SELECT repo, 'FR-INJ-005', 'late_report/m_' || k || '.py', 9, 'entry_' || k, {_hash(9)} FROM s WHERE s_suppkey % 10 = 1 AND b > 0
UNION ALL SELECT repo, 'FR-WKFL-004', 'late_report/m_' || k || '.py', 15, 'Order' || k, {_hash(15, 19)} FROM s WHERE s_suppkey % 10 = 1 AND b <= 7000""")
def stream_findings(spark, sf):
    """Two arrivals: all modules; then copies of some of them elsewhere, of which no content is parsed again."""
    folder = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    sources, found = st.Sources(spark, f"{folder}/sources", parts=8), st.findings_table(spark, f"{folder}/findings", parts=8)
    files = materialise(supplier_files(spark, sf), "arriving")
    late = files.where(F.expr("path LIKE '%/m\\\\_%1.py'")).withColumn("path", F.regexp_replace("path", "^.*/", "late_report/"))
    for batch in (files, late):
        with work_tables(spark):
            st.scan_batch(spark, batch, sources, found, rules=["FR-INJ-005", "FR-WKFL-004"])
    return found.read().select(*_FOUND)


@query("ledger_versions", f"""WITH {_S}, f AS ({_MESSAGES}), g AS (SELECT *, rule_id || '-' || substr(sha256(concat_ws(':', repo, rule_id, file, "function", code_location_hash)), 1, 16) AS id FROM f)
SELECT id, repo, CASE WHEN line = 3 THEN 'proven' ELSE 'candidate' END AS status, CASE WHEN line = 3 THEN 2 ELSE 0 END AS proof_tier,
  CASE WHEN line = 3 THEN '2026-01-02' END AS proven, CASE WHEN line = 3 THEN 1 ELSE 0 END AS n_history FROM g""")
def ledger_versions(spark, sf):
    """A ledger table after a scan, the proofs of some findings, and the same scan again."""
    from ..operators.ledger import ledger_rows

    path = f"{work_dir(spark)}/ledger-{uuid.uuid4().hex}"
    found = materialise(findings(supplier_index(spark, sf), rules=["FR-INJ-005"]), "findings")
    base = sinks.write_ledger(ledger_rows(found, "2026-01-01"), path)
    proofs = found.where("line = 3").select(c("id").alias("finding_id"), F.lit("passed").alias("status"), F.lit(2).alias("proof_tier"), F.lit("h").alias("reproducer_hash"))
    base = sinks.write_results(spark, path, proofs, "2026-01-02", base=base)
    sinks.write_ledger(ledger_rows(found, "2026-01-03"), path, base=base)
    return sinks.read_ledger(spark, path).select("id", "repo", "status", "proof_tier", "proven", F.size(F.coalesce("status_history", F.array())).alias("n_history"))
