"""Operator queries over relations adapted from the driver's tables.

Adapters: orders act as calls or findings, customers as endpoints or scans, labelled
documents as ledger rows, document text as source text, parts as hook handlers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import findings as fd
from ..operators import graph as gr
from ..operators import ledger as lg
from ..operators import mentions as mn
from ..operators import records as rc
from ..operators import reports as rp
from ..operators import rules as rl
from ..operators import view as vw
from ..session import work_dir
from ..sources import hooks as hk
from .catalog import query
from .derived_app import FILE

c = F.col


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- call graph: customer -> order -> (hub) supplier -> nation -> customer ------------------
def _graph(spark, sf, cyclic=False):
    orders, items = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    suppliers, customers = _t(spark, sf, "supplier"), _t(spark, sf, "customer")
    edge = lambda df, src, dst: df.select(F.lit("r").alias("repo"), F.expr(src).alias("src"), F.expr(dst).alias("dst"))
    edges = (
        edge(orders, "concat('C', o_custkey)", "concat('O', o_orderkey)")
        .unionByName(edge(items, "concat('O', l_orderkey)", "concat('*', l_suppkey)"))
        .unionByName(edge(suppliers, "concat('S', s_suppkey)", "concat('N', s_nationkey)"))
    )
    if cyclic:
        edges = edges.unionByName(edge(customers, "concat('N', c_nationkey)", "concat('C', c_custkey)"))
    members = suppliers.select(F.lit("r").alias("repo"), F.expr("concat('*', s_suppkey)").alias("hub"),
                               F.expr("concat('S', s_suppkey)").alias("member"))
    return gr.CallGraph(edges.distinct(), members)


_EDGES = """
e AS (SELECT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst FROM orders
      UNION SELECT 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)
      UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier)"""


def _customers(spark, sf, condition="c_mktsegment = 'BUILDING'"):
    return _t(spark, sf, "customer").where(condition).select(
        F.lit("r").alias("repo"), F.expr("concat('C', c_custkey)").alias("symbol_id"))


@query("reach_3hop", f"""
WITH {_EDGES}, h0 AS (SELECT 'C' || c_custkey AS n FROM customer WHERE c_mktsegment = 'BUILDING'),
h1 AS (SELECT DISTINCT dst AS n FROM e JOIN h0 ON src = n), h2 AS (SELECT DISTINCT dst AS n FROM e JOIN h1 ON src = n),
h3 AS (SELECT DISTINCT dst AS n FROM e JOIN h2 ON src = n)
SELECT 'r' AS repo, n AS symbol_id FROM (SELECT n FROM h0 UNION SELECT n FROM h1 UNION SELECT n FROM h2 UNION SELECT n FROM h3)""")
def reach_3hop(spark, sf):
    return gr.reach(_graph(spark, sf), _customers(spark, sf), 3)


@query("reach_unbounded", f"""
WITH RECURSIVE {_EDGES}, e2 AS (SELECT * FROM e UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer),
r AS (SELECT 'C' || c_custkey AS n FROM customer WHERE c_acctbal < -990 UNION SELECT e2.dst FROM r JOIN e2 ON e2.src = r.n)
SELECT 'r' AS repo, n AS symbol_id FROM r""")
def reach_unbounded(spark, sf):
    return gr.reach_all(_graph(spark, sf, cyclic=True), _customers(spark, sf, "c_acctbal < -990"))


@query("reach_chain", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS cust, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS nxt FROM orders)
SELECT 'r' AS repo, 'O' || k AS symbol_id FROM o WHERE k >= (SELECT min(k) FROM o WHERE cust % 100 = 7)
UNION SELECT 'r', 'C' || cust FROM o WHERE k >= (SELECT min(k) FROM o WHERE cust % 100 = 7)""")
def reach_chain(spark, sf):
    """Every order calls the next one, and some their customer: one chain through the whole table."""
    orders = vw.numbered(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), [c("o_orderkey")])
    node = lambda prefix, column: F.concat(F.lit(prefix), column)
    following = orders.select(c("o_orderkey").alias("following"), (c("number") - 1).alias("number"))
    edges = orders.join(following, ["number"]).select(F.lit("r").alias("repo"), node("O", "o_orderkey").alias("src"), node("O", "following").alias("dst"))
    last = orders.select(F.lit("r").alias("repo"), node("O", "o_orderkey").alias("src"), node("C", "o_custkey").alias("dst"))
    none = spark.createDataFrame([], "repo string, hub string, member string")
    seeds = orders.where("o_custkey % 100 = 7").select(F.lit("r").alias("repo"), node("O", "o_orderkey").alias("symbol_id"))
    return gr.reach_all(gr.CallGraph(edges.unionByName(last), none), seeds)


@query("callee_lists", f"WITH {_EDGES} SELECT 'r' AS repo, src, string_agg(d, ',' ORDER BY d) AS callees FROM (SELECT src, replace(dst, 'S', '*') AS d FROM e) GROUP BY src")
def callee_lists(spark, sf):
    return gr.callees(_graph(spark, sf)).withColumn("callees", F.array_join("callees", ","))


def _order_flags(spark, sf):
    """Orders as functions: urgent ones check permissions, returned ones mutate."""
    returned = _t(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(
        F.max(c("l_returnflag") == "R").alias("has_mutation"))
    flags = _t(spark, sf, "orders").join(returned, ["o_orderkey"], "left").select(
        F.lit("r").alias("repo"), F.expr("concat('O', o_orderkey)").alias("symbol_id"),
        (c("o_orderpriority") == "1-URGENT").alias("has_check"), F.coalesce("has_mutation", F.lit(False)).alias("has_mutation"))
    everyone = _customers(spark, sf, "true").withColumn("has_check", F.lit(False)).withColumn("has_mutation", F.lit(False))
    return flags.unionByName(everyone)


def _near(spark, sf):
    return gr.within_one_hop(_graph(spark, sf), _customers(spark, sf, "true"), _order_flags(spark, sf), ("has_check", "has_mutation"))


@query("unguarded_endpoints", """
SELECT 'r' AS repo, 'C' || c_custkey AS symbol_id FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def unguarded_endpoints(spark, sf):
    return _near(spark, sf).where("NOT has_check").select("repo", "symbol_id")


@query("endpoint_mutation_class", """
SELECT 'C' || c_custkey AS symbol_id, CASE WHEN EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE o_custkey = c_custkey AND l_returnflag = 'R') THEN 'high' ELSE 'low' END AS fix_confidence
FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def endpoint_mutation_class(spark, sf):
    return _near(spark, sf).where("NOT has_check").select(
        "symbol_id", F.when(c("has_mutation"), "high").otherwise("low").alias("fix_confidence"))


@query("sink_from_unguarded", """
WITH open AS (SELECT c_custkey FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'))
SELECT 'O' || o_orderkey AS symbol_id, o_totalprice AS total FROM orders JOIN open ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def sink_from_unguarded(spark, sf):
    open_ends = _near(spark, sf).where("NOT has_check").select("repo", "symbol_id")
    exposed = gr.one_hop_targets(_graph(spark, sf), open_ends)
    sinks = _t(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        F.lit("r").alias("repo"), F.expr("concat('O', o_orderkey)").alias("symbol_id"), c("o_totalprice").alias("total"))
    return sinks.join(exposed, ["repo", "symbol_id"], "left_semi").select("symbol_id", "total")


@query("exact_one_match", """
SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2 HAVING count(*) = 1""")
def exact_one_match(spark, sf):
    return gr.exactly_one(_t(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("dispatch_lookup", """
WITH f AS (SELECT p_name AS func, split_part(p_name, ' ', 2) AS last, lower(p_type) AS module, p_partkey AS k FROM part),
named AS (SELECT func AS target, arg_max(k, row(module, k)) AS by_name FROM f GROUP BY 1),
located AS (SELECT module || '.' || last AS target, arg_min(k, row(module, k)) AS by_module FROM f GROUP BY 1),
asked AS (SELECT func AS target FROM f UNION SELECT module || '.' || last FROM f)
SELECT target, coalesce(by_name, by_module) AS dst FROM asked LEFT JOIN named USING (target) LEFT JOIN located USING (target)""")
def dispatch_lookup(spark, sf):
    functions = _t(spark, sf, "part").select(
        F.lit("r").alias("repo"), F.expr("concat(lower(p_type), '.py')").alias("path"), c("p_partkey").alias("ord"),
        c("p_partkey").alias("symbol_id"), c("p_name").alias("func"), F.expr("split_part(p_name, ' ', 2)").alias("name"))
    asked = functions.select("repo", c("func").alias("target")).unionByName(functions.select(
        "repo", F.concat_ws(".", F.regexp_replace("path", r"\.py$", ""), "name").alias("target")))
    return gr.resolve_paths(asked, functions).select("target", "dst")


# ---- hook declarations --------------------------------------------------------------------------
@query("hook_collisions", """
SELECT p_type AS doctype, 'on_' || p_size AS event, count(DISTINCT p_brand) AS n_apps, count(*) AS n_handlers,
  arg_min(p_brand, row(p_brand, p_partkey)) AS first_path,
  string_agg(p_brand || ':' || p_name, ',' ORDER BY p_brand, p_partkey) AS handlers FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_brand) > 1""")
def hook_collisions(spark, sf):
    handlers = _t(spark, sf, "part").select(
        F.lit("r").alias("repo"), c("p_brand").alias("app"), c("p_type").alias("doctype"), F.expr("concat('on_', p_size)").alias("event"),
        c("p_name").alias("handler"), F.struct(c("p_brand").alias("file"), c("p_partkey").alias("pos")).alias("ord"), c("p_brand").alias("abs_path"))
    listed = F.array_join(F.transform("handlers", lambda h: F.concat_ws(":", h["app"], h["handler"])), ",")
    return hk.collisions(handlers).withColumn("handlers", listed).drop("repo")


# ---- text and path predicates --------------------------------------------------------------------
_IDENTIFIER = "[A-Za-z0-9_]+"


def _words(spark, sf):
    """Names to look for: every identifier of the items, and every two with one space between."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"{_IDENTIFIER}(?: {_IDENTIFIER})*"), 0)).alias("run")
    words = _t(spark, sf, "benchmark").select(runs).select(F.split("run", " ").alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return words.select(F.explode(F.concat("w", F.array_compact(pairs))).alias("word")).distinct()


def _runs_sql(column: str) -> str:
    return f"""SELECT {column}, string_split(unnest(regexp_extract_all(text, '{_IDENTIFIER}(?: {_IDENTIFIER})*')), ' ') AS w"""


_WORDS = f"""b AS (SELECT w FROM ({_runs_sql('item_id')} FROM benchmark)),
w AS (SELECT unnest(w) AS word FROM b UNION SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b))"""


@query("regex_table_mention", f"""
WITH {_WORDS}, d AS ({_runs_sql('doc_id')} FROM documents),
t AS (SELECT doc_id, lower(unnest(w)) AS word FROM d UNION SELECT doc_id, lower(w[i] || ' ' || w[i + 1]) FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d))
SELECT doc_id, w.word FROM t JOIN w ON t.word = lower(w.word)""")
def regex_table_mention(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return mn.mentions(docs, _words(spark, sf), ["doc_id"], "text", "word", on=[]).select("doc_id", "word")


@query("token_table_mention", f"""
WITH {_WORDS}, d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS word FROM documents)
SELECT doc_id, word FROM d JOIN w USING (word)""")
def token_table_mention(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return mn.exact_mentions(docs, _words(spark, sf), ["doc_id"], "text", "word", on=[]).select("doc_id", "word")


@query("path_predicates", f"""
SELECT p_partkey, f AS path, regexp_matches(f, '(^|/)(patches|tests)/') OR regexp_matches(f, '(^|/)test_[^/]*$') AS non_runtime,
  regexp_matches(f, '(^|/)(workflow|workflow_action)/') AS workflow, regexp_matches(f, '(^|/)(report|[^/]*_report)/') AS report,
  split_part(f, '/', -1) AS last_part, replace(f, '.py', '') AS module
FROM (SELECT p_partkey, {FILE} AS f FROM part)""")
def path_predicates(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.expr(FILE).alias("path")).select(
        "p_partkey", "path", text.is_non_runtime_path("path").alias("non_runtime"), text.is_workflow_path("path").alias("workflow"),
        text.is_report_path("path").alias("report"), F.substring_index("path", "/", -1).alias("last_part"),
        text.module_path("path").alias("module"))


@query("suffix_join", """
WITH u AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages),
s AS (SELECT page_id, array_to_string(list_slice(parts, i, len(parts)), '/') AS suffix FROM
      (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM u))
SELECT suffix, count(*) AS n_pages, min(page_id) AS first_page FROM s GROUP BY suffix""")
def suffix_join(spark, sf):
    pages = _t(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return pages.select("page_id", F.explode(text.path_suffixes("path")).alias("suffix")).groupBy("suffix").agg(
        F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@query("stable_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def stable_hash(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.stable_hash("text").alias("hash"))


_KEYED = """SELECT l_orderkey, l_linenumber, l_returnflag || '-1' AS rule_id, 'f' || l_suppkey AS file, 'p' || l_partkey AS "function",
  l_shipdate::DATE::VARCHAR AS h, l_linestatus AS repo FROM lineitem"""


def _item_candidates(spark, sf):
    return _t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("concat(l_returnflag, '-1')").alias("rule_id"), F.expr("concat(l_returnflag, '-1')").alias("taxonomy_id"),
        F.lit("1.0.0").alias("rule_version"), F.expr("concat('f', l_suppkey)").alias("file"), F.expr("concat('p', l_partkey)").alias("function"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("code_location_hash"), c("l_linestatus").alias("repo"))


@query("finding_id", f"""SELECT l_orderkey, l_linenumber, rule_id || '-' || substr(sha256(
  repo || ':' || rule_id || ':' || file || ':' || "function" || ':' || h), 1, 16) AS id FROM ({_KEYED})""")
def finding_id(spark, sf):
    return _item_candidates(spark, sf).select("l_orderkey", "l_linenumber", fd.finding_id().alias("id"))


@query("fingerprint", f"""SELECT l_orderkey, l_linenumber, substr(sha256(
  rule_id || '|' || file || '|' || "function" || '|' || h), 1, 32) AS fingerprint FROM ({_KEYED})""")
def fingerprint(spark, sf):
    return _item_candidates(spark, sf).select("l_orderkey", "l_linenumber", fd.fingerprint().alias("fingerprint"))


# ---- duplicates and known findings ------------------------------------------------------------------
@query("dedup_last_wins", """
SELECT l_suppkey, l_returnflag, arg_max(l_orderkey, row(l_shipdate, l_orderkey, l_linenumber)) AS l_orderkey,
  max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2""")
def dedup_last_wins(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_shipdate", F.struct(
        "l_shipdate", "l_orderkey", "l_linenumber").alias("emit_ord"))
    return fd.keep_last(rows, ["l_suppkey", "l_returnflag"], "emit_ord").drop("emit_ord")


@query("first_wins", """
SELECT p_name, arg_min(p_partkey, row(p_brand, p_partkey)) AS p_partkey, min(p_brand) AS p_brand FROM part GROUP BY 1""")
def first_wins(spark, sf):
    rows = _t(spark, sf, "part").select("p_name", "p_partkey", "p_brand", F.struct("p_brand", "p_partkey").alias("o"))
    return fd.keep_first(rows, ["p_name"], "o").drop("o")


@query("fp_suppression", f"""
SELECT l_orderkey, l_linenumber FROM ({_KEYED}) k WHERE NOT EXISTS (
  SELECT 1 FROM ({_KEYED}) b WHERE b.l_linenumber = 1 AND b.rule_id = k.rule_id AND b.repo = k.repo AND b.file = k.file
  AND b."function" = k."function" AND b.h = k.h)""")
def fp_suppression(spark, sf):
    items = _item_candidates(spark, sf)
    return fd.drop_false_positives(items, items.where("l_linenumber = 1")).select("l_orderkey", "l_linenumber")


@query("fp_suppressed_ids", f"""
SELECT b.id AS finding_id, count(*) AS n FROM ({_KEYED}) k JOIN (SELECT max('fp' || l_orderkey) AS id, rule_id, repo, file, "function", h
  FROM ({_KEYED}) WHERE l_linenumber = 1 GROUP BY ALL) b USING (rule_id, repo, file, "function", h) GROUP BY 1""")
def fp_suppressed_ids(spark, sf):
    items = _item_candidates(spark, sf)
    log = items.where("l_linenumber = 1").withColumn("finding_id", F.expr("concat('fp', l_orderkey)"))
    return fd.suppressed_ids(items, log).groupBy("finding_id").agg(F.count("*").alias("n"))


@query("baseline_filter", f"""
SELECT l_orderkey, l_linenumber FROM ({_KEYED}) k WHERE NOT EXISTS (
  SELECT 1 FROM ({_KEYED}) b WHERE b.l_linenumber = 2 AND b.rule_id = k.rule_id AND b.file = k.file
  AND b."function" = k."function" AND b.h = k.h)""")
def baseline_filter(spark, sf):
    items = _item_candidates(spark, sf)
    baseline = items.where("l_linenumber = 2").select(fd.fingerprint().alias("fingerprint"))
    return fd.drop_known(items, baseline).select("l_orderkey", "l_linenumber")


_SPOT = "'c' || o_custkey AS file, date_part('day', o_orderdate)::INT AS line"
_RULE = "CASE o_orderstatus WHEN 'F' THEN 'FR-AAA-001' WHEN 'O' THEN 'FR-BBB-002' ELSE 'FR-BBB-0021' END"
_COMMENT = """CASE o_orderpriority WHEN '1-URGENT' THEN 'x = 1  # tracewright:ignore' WHEN '2-HIGH' THEN 'y  # tracewright: ignore FR-AAA-001, FR-BBB-002'
  WHEN '3-MEDIUM' THEN 'z # Tracewright :IGNORE FR-BBB-002 # tracewright:ignore FR-CCC-003' WHEN '4-NOT SPECIFIED' THEN 'w # tracewright:ignore FR-BBB-0021'
  ELSE 'plain = text' END"""


def _commented(spark, sf):
    orders = _t(spark, sf, "orders").select(
        F.lit("r").alias("repo"), F.expr("concat('c', o_custkey)").alias("file"), F.dayofmonth("o_orderdate").alias("line"), "o_orderkey",
        F.expr(_RULE).alias("rule_id"), F.expr(_RULE).alias("taxonomy_id"), F.expr(_COMMENT).alias("text"))
    lines = fd.keep_first(orders.select("repo", "file", "line", "text", "o_orderkey"), ["repo", "file", "line"], "o_orderkey").drop("o_orderkey")
    return orders.drop("text"), lines


_LINES = f"""o AS (SELECT o_orderkey, {_SPOT}, {_RULE} AS rule, {_COMMENT} AS t FROM orders),
l AS (SELECT file, line, arg_min(t, o_orderkey) AS t FROM o GROUP BY 1, 2)"""


@query("inline_suppression_same_line", f"""
WITH {_LINES} SELECT o_orderkey FROM o JOIN l USING (file, line) WHERE NOT (contains(l.t, '# tracewright:ignore') AND (
  trim(split_part(l.t, '# tracewright:ignore', 2)) = '' OR contains(split_part(l.t, '# tracewright:ignore', 2), rule)))""")
def inline_suppression_same_line(spark, sf):
    candidates, lines = _commented(spark, sf)
    return fd.silenced_on_line(candidates, lines).select("o_orderkey")


@query("inline_suppression_nearby", f"""
WITH {_LINES}, s AS (SELECT file, line, t = 'x = 1  # tracewright:ignore' AS everything,
  CASE WHEN t LIKE 'y%' THEN ['FR-AAA-001', 'FR-BBB-002'] WHEN t LIKE 'z%' THEN ['FR-BBB-002', 'FR-CCC-003'] WHEN t LIKE 'w%' THEN ['FR-BBB-0021'] ELSE [] END AS ids
  FROM l WHERE t NOT LIKE 'plain%')
SELECT o_orderkey FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.file = o.file AND s.line IN (o.line, o.line - 1)
  AND (everything OR list_contains(ids, o.rule)))""")
def inline_suppression_nearby(spark, sf):
    candidates, lines = _commented(spark, sf)
    return fd.silenced_nearby(candidates, lines).select("o_orderkey")


@query("diff_filter", """
WITH ch AS (SELECT DISTINCT 'f' || s_suppkey AS path FROM supplier WHERE s_acctbal < 2000 UNION SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < -500)
SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM ch WHERE ends_with('f' || l_suppkey, path))""")
def diff_filter(spark, sf):
    suppliers = _t(spark, sf, "supplier")
    changed = suppliers.where("s_acctbal < 2000").select(F.expr("concat('f', s_suppkey)").alias("path")).union(
        suppliers.where("s_acctbal < -500").select(c("s_suppkey").cast("string").alias("path")))
    return fd.only_changed(_item_candidates(spark, sf), changed).select("l_orderkey", "l_linenumber")


@query("glob_exclude", f"""
SELECT p_partkey FROM (SELECT p_partkey, {FILE} AS f FROM part)
WHERE NOT (f LIKE 'tests/%' OR f GLOB '*/mod_?.py' OR split_part(f, '/', -1) GLOB 'mod_1[0-3]*.py' OR f GLOB 'mod_1[0-3]*.py')""")
def glob_exclude(spark, sf):
    files = _t(spark, sf, "part").select("p_partkey", F.expr(FILE).alias("file"))
    return fd.exclude_paths(files, ["tests/*", "*/mod_?.py", "mod_1[0-3]*.py"]).select("p_partkey")


# ---- scoring -----------------------------------------------------------------------------------------
_SCORED_RULE = """CASE l_linenumber WHEN 1 THEN 'FR-SQLI-001' WHEN 2 THEN 'FR-PERM-001' WHEN 3 THEN 'FR-HOOK-006' WHEN 4 THEN 'FR-CSRF-001'
  WHEN 5 THEN 'FR-I18N-001' WHEN 6 THEN 'FR-SSRF-001' ELSE 'FR-DATA-001' END"""
_TIER = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


def _scored(spark, sf):
    return _t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr(_SCORED_RULE).alias("rule_id"), F.expr(_TIER).alias("tier"), (c("l_linestatus") == "F").alias("guest"),
        F.expr("CASE WHEN l_quantity > 25 THEN 'low' ELSE 'high' END").alias("fix_confidence"), "l_suppkey",
    ).withColumn("severity", scoring.severity("rule_id", "fix_confidence", "guest", "tier"))


_SCORE_SQL = f"""SELECT l_orderkey, l_linenumber, l_suppkey, rule_id, CASE l_linenumber
  WHEN 1 THEN ((CASE WHEN g THEN 15 ELSE 12 END) + 20 + 6 + w) * m
  WHEN 2 THEN ((CASE WHEN g THEN 15 ELSE 12 END) + (CASE WHEN l_quantity > 25 THEN 8 ELSE 16 END) + 4 + w) * m
  WHEN 3 THEN 7 + w WHEN 4 THEN ((CASE WHEN g THEN 15 ELSE 12 END) + 16 + 10 + w) * m WHEN 5 THEN 2
  WHEN 6 THEN ((CASE WHEN g THEN 15 ELSE 12 END) + 8 + 8 + w) * m ELSE 7 + w END::DOUBLE AS score
  FROM (SELECT *, {_SCORED_RULE} AS rule_id, l_linestatus = 'F' AS g, CASE WHEN l_linestatus = 'F' THEN 1.5 ELSE 1.0 END AS m,
    CASE {_TIER} WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS w FROM lineitem)"""


@query("severity_score", _SCORE_SQL.replace("l_suppkey, rule_id,", "rule_id,", 1))
def severity_score(spark, sf):
    return _scored(spark, sf).select("l_orderkey", "l_linenumber", "rule_id", c("severity.score").alias("score"))


@query("severity_band_hist", f"""SELECT CASE WHEN score >= 60 THEN 'CRITICAL' WHEN score >= 40 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM'
  WHEN score > 0 THEN 'LOW' ELSE '—' END AS band, count(*) AS n FROM ({_SCORE_SQL}) GROUP BY 1""")
def severity_band_hist(spark, sf):
    return rp.band_histogram(_scored(spark, sf), "severity.score")


@query("report_level", f"""SELECT rule_id, CASE WHEN score >= 60 THEN 'error' WHEN score >= 20 THEN 'warning' ELSE 'note' END AS level,
  count(*) AS n FROM ({_SCORE_SQL}) GROUP BY 1, 2""")
def report_level(spark, sf):
    return _scored(spark, sf).groupBy("rule_id", scoring.report_level("severity.score").alias("level")).agg(F.count("*").alias("n"))


def _score_order():
    return [c("severity.score").desc(), c("rule_id"), c("l_orderkey"), c("l_linenumber")]


_SCORE_RANK = f"SELECT *, row_number() OVER (ORDER BY score DESC, rule_id, l_orderkey, l_linenumber) AS number FROM ({_SCORE_SQL})"


@query("topk_severity", f"SELECT l_orderkey, l_linenumber, rule_id, score FROM ({_SCORE_RANK}) WHERE number <= 100")
def topk_severity(spark, sf):
    return vw.top(_scored(spark, sf), _score_order(), 100).select("l_orderkey", "l_linenumber", "rule_id", c("severity.score").alias("score"))


@query("page_n", f"SELECT l_orderkey, l_linenumber, rule_id FROM ({_SCORE_RANK}) WHERE number BETWEEN 51 AND 75")
def page_n(spark, sf):
    return vw.page(_scored(spark, sf), _score_order(), 3).select("l_orderkey", "l_linenumber", "rule_id")


_LAST_PAGE = f"(SELECT greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) FROM ({_SCORE_SQL}))"


@query("list_pages", f"""SELECT CAST((number - 1) // 25 + 1 AS INT) AS page, l_orderkey, l_linenumber, rule_id FROM ({_SCORE_RANK})
WHERE (number - 1) // 25 + 1 IN (1, 2, 40, {_LAST_PAGE} - 1, {_LAST_PAGE})""")
def list_pages(spark, sf):
    """Several pages of a list that is put in order once."""
    pages = vw.paged(_scored(spark, sf), _score_order())
    shown = [pages.page(n).select(F.lit(n).alias("page"), "l_orderkey", "l_linenumber", "rule_id")
             for n in sorted({1, 2, 40, pages.count() - 1, pages.count()})]
    rows = shown[0]
    for more in shown[1:]:
        rows = rows.unionByName(more)
    return rows


@query("display_numbers", f"SELECT l_orderkey, l_linenumber, number FROM ({_SCORE_RANK})")
def display_numbers(spark, sf):
    flat = _scored(spark, sf).select("l_orderkey", "l_linenumber", "rule_id", c("severity.score").alias("score"))
    return vw.numbered(flat, [c("score").desc(), c("rule_id"), c("l_orderkey"), c("l_linenumber")]).select(
        "l_orderkey", "l_linenumber", "number")


# ---- ledger and reports: labelled documents ------------------------------------------------------------
_LEDGER_SQL = """led AS (SELECT 'd' || doc_id AS id, 'FR-' || upper(lang) || '-' || source AS taxonomy_id, source AS rule_id, lang AS rule_version,
  CASE WHEN n_chars > 3000 THEN 'big' WHEN n_chars > 1000 THEN 'mid' ELSE 'small' END AS repo,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'proven' WHEN quality = 1 THEN 'merged' WHEN toxic = 1 OR quality IS NULL THEN 'candidate' ELSE 'false_positive' END AS status,
  CASE lang WHEN 'en' THEN 'rce' WHEN 'fr' THEN 'data_exposure' ELSE 'availability' END AS impact_class, toxic, quality, n_chars, text
  FROM documents LEFT JOIN labels USING (doc_id))"""


def _ledger(spark, sf):
    """Documents as ledger rows; one without a label is a candidate."""
    docs = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), ["doc_id"], "left")
    return docs.selectExpr(
        "concat('d', doc_id) AS id", "concat('FR-', upper(lang), '-', source) AS taxonomy_id", "source AS rule_id", "lang AS rule_version",
        "CASE WHEN n_chars > 3000 THEN 'big' WHEN n_chars > 1000 THEN 'mid' ELSE 'small' END AS repo",
        "CASE WHEN quality = 1 AND toxic = 0 THEN 'proven' WHEN quality = 1 THEN 'merged' WHEN toxic = 1 OR quality IS NULL THEN 'candidate' ELSE 'false_positive' END AS status",
        "CASE lang WHEN 'en' THEN 'rce' WHEN 'fr' THEN 'data_exposure' ELSE 'availability' END AS impact_class", "toxic", "quality", "n_chars", "text",
        "substr(sha2(text, 256), 1, 16) AS code_location_hash")


@query("precision_by_rule", f"""WITH {_LEDGER_SQL} SELECT rule_id, rule_version, proven, false_positives,
  proven::DOUBLE / nullif(proven + false_positives, 0) AS precision FROM (SELECT rule_id, rule_version,
  count(*) FILTER (status IN ('proven', 'merged')) AS proven, count(*) FILTER (status = 'false_positive') AS false_positives FROM led GROUP BY 1, 2)""")
def precision_by_rule(spark, sf):
    return rp.precision_by_rule(_ledger(spark, sf))


@query("fp_rate_review", f"""WITH {_LEDGER_SQL}, g AS (SELECT rule_id, rule_version, count(*) FILTER (status <> 'candidate') AS attempts,
  count(*) FILTER (status = 'false_positive') AS refuted FROM led GROUP BY 1, 2)
  SELECT rule_id, rule_version, attempts, refuted::DOUBLE / attempts AS fp_rate, attempts >= 5 AND refuted::DOUBLE / attempts > 0.5 AS needs_logic_review
  FROM g WHERE attempts > 0""")
def fp_rate_review(spark, sf):
    return rp.fp_rates(_ledger(spark, sf)).select("rule_id", "rule_version", "attempts", c("fp_rate_exact").alias("fp_rate"), "needs_logic_review")


@query("status_counts_zero_fill", f"""WITH {_LEDGER_SQL}, dim AS (SELECT unnest(['candidate', 'proven', 'merged', 'patched', 'false_positive', 'regressed']) AS status)
  SELECT status, count(led.id) AS n FROM dim LEFT JOIN led USING (status) GROUP BY 1""")
def status_counts_zero_fill(spark, sf):
    return rp.status_counts(_ledger(spark, sf)).select("status", "n")


_FAMILY = """CASE o_orderpriority WHEN '1-URGENT' THEN 'FR-PERM-001' WHEN '2-HIGH' THEN 'FR-PERMX-002' WHEN '3-MEDIUM' THEN 'FR-I18N-001'
  WHEN '4-NOT SPECIFIED' THEN 'FR-PATH-001' ELSE 'FR-INJ-002' END"""


@query("family_coverage", f"""WITH dim AS (SELECT unnest(['FR-PERM', 'FR-SQLI', 'FR-HOOK', 'FR-WKFL', 'FR-DATA', 'FR-INJ', 'FR-CSRF', 'FR-SSRF', 'FR-PERF', 'FR-I18N']) AS family)
  SELECT family, count(o_orderkey) AS n FROM dim LEFT JOIN (SELECT o_orderkey, {_FAMILY} AS t FROM orders) ON starts_with(t, family) GROUP BY 1""")
def family_coverage(spark, sf):
    return rp.family_coverage(_t(spark, sf, "orders").select(F.expr(_FAMILY).alias("taxonomy_id"))).select("family", "n")


@query("repo_pivot", f"""WITH {_LEDGER_SQL} SELECT repo, count(*) FILTER (status = 'candidate') AS candidate, count(*) FILTER (status = 'proven') AS proven,
  count(*) FILTER (status = 'merged') AS merged, count(*) FILTER (status = 'false_positive') AS false_positive FROM led GROUP BY 1""")
def repo_pivot(spark, sf):
    return rp.by_repo(_ledger(spark, sf))


@query("impact_distribution", f"WITH {_LEDGER_SQL} SELECT impact_class, count(*) AS n FROM led GROUP BY 1")
def impact_distribution(spark, sf):
    return rp.impact_distribution(_ledger(spark, sf)).select("impact_class", "n")


def _heading(section: int, title: str, columns: str) -> str:
    n = columns.count("|") + 1
    lines = [(section, 0, ""), (section, 1, f"## {title}"), (section, 2, ""), (section + 1, 0, f"| {columns} |"),
             (section + 1, 1, "| --- |" + " ---: |" * (n - 1))]
    return " UNION ALL ".join(f"SELECT {s} AS section, '{p:06d}' AS position, '{x}' AS line" for s, p, x in lines)


_STATES = "['candidate', 'proven', 'merged', 'patched', 'false_positive', 'regressed']"
_TITLES = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(rp.FAMILIES.items()))
_IMPACTS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(rp.IMPACT_ORDER))


@query("track_record", f"""WITH {_LEDGER_SQL}, pr AS (SELECT rule_id, rule_version, count(*) FILTER (status IN ('proven', 'merged')) AS p, count(*) FILTER (status = 'false_positive') AS f FROM led GROUP BY 1, 2)
SELECT 0 AS section, '000000' AS position, '# Track Record' AS line UNION ALL {_heading(10, 'Evidence Status', 'Status | Count')}
UNION ALL SELECT 12, lpad(CAST(i - 1 AS VARCHAR), 3, '0'), '| ' || s || ' | ' || (SELECT count(*) FROM led WHERE status = s) || ' |' FROM (SELECT unnest({_STATES}) AS s, unnest(range(1, 7)) AS i)
UNION ALL {_heading(20, 'Rule Precision', 'Rule | Proven | False Positives | Precision')}
UNION ALL SELECT 22, rule_id || chr(1) || rule_version, '| ' || rule_id || ' v' || rule_version || ' | ' || p || ' | ' || f || ' | ' ||
  CASE WHEN p + f = 0 THEN 'N/A' ELSE CAST(round_even(p::DOUBLE / (p + f)::DOUBLE * 100, 0) AS INT) || '%' END || ' |' FROM pr
UNION ALL {_heading(30, 'Rule Coverage', 'Family | Category | Findings')}
UNION ALL SELECT 32, lpad(CAST(i AS VARCHAR), 3, '0'), '| ' || k || ' | ' || t || ' | ' || (SELECT count(*) FROM led WHERE starts_with(regexp_replace(taxonomy_id, '-[^-]*$', ''), k)) || ' |'
  FROM (VALUES {_TITLES}) v(i, k, t)
UNION ALL {_heading(40, 'Per-Repo Breakdown', 'Repo | Candidates | Proven | Merged | FP')}
UNION ALL SELECT 42, repo, '| ' || repo || ' | ' || count(*) FILTER (status = 'candidate') || ' | ' || count(*) FILTER (status = 'proven') || ' | ' || count(*) FILTER (status = 'merged') || ' | '
  || count(*) FILTER (status = 'false_positive') || ' |' FROM led GROUP BY repo
UNION ALL {_heading(50, 'Severity Distribution', 'Impact Class | Count')}
UNION ALL SELECT 52, lpad(CAST(i AS VARCHAR), 3, '0'), '| ' || k || ' | ' || count(*) || ' |' FROM (VALUES {_IMPACTS}) v(i, k) JOIN led ON impact_class = k GROUP BY i, k
UNION ALL SELECT 60, '000000', '' UNION ALL SELECT 60, '000001', '## Upstream History' UNION ALL SELECT 60, '000002', ''
UNION ALL SELECT 61, id, '- ' || id || ': merged upstream at pr/' || id FROM led WHERE status = 'merged' AND n_chars > 1000""")
def track_record(spark, sf):
    """The whole document, line by line."""
    upstream = F.when(c("n_chars") > 1000, F.concat(F.lit("pr/"), "id"))
    return rp.track_record(_ledger(spark, sf).withColumn("upstream_pr", upstream))


def _results(spark, sf):
    """Proof results of the documents longer than 500 characters."""
    return _ledger(spark, sf).where("n_chars > 500").selectExpr(
        "id AS finding_id", "CASE WHEN toxic = 1 THEN 'failed' WHEN n_chars > 4000 THEN 'dry_run' WHEN n_chars > 2000 THEN 'skipped' ELSE 'passed' END AS status",
        "2 AS proof_tier", "substr(code_location_hash, 1, 8) AS reproducer_hash")


def _full_ledger(spark, sf):
    """Ledger rows as stored (no history yet)."""
    return _ledger(spark, sf).selectExpr(
        "id", "status", "1 AS proof_tier", "CAST(NULL AS STRING) AS reproducer_hash", "CAST(NULL AS STRING) AS proven",
        "CAST(array() AS array<struct<date:string,status:string,proof_tier:int,reproducer_hash:string>>) AS status_history")


@query("ledger_transition", f"""WITH {_LEDGER_SQL}, r AS (SELECT id, status AS old, CASE WHEN n_chars <= 500 THEN NULL WHEN toxic = 1 THEN 'failed' WHEN n_chars > 4000 THEN NULL
  WHEN n_chars > 2000 THEN 'skipped' ELSE 'passed' END AS res FROM led)
  SELECT id, CASE res WHEN 'passed' THEN 'proven' WHEN 'failed' THEN 'false_positive' ELSE old END AS status, CASE WHEN res = 'passed' THEN 2 ELSE 1 END AS proof_tier,
  CASE WHEN res IS NULL THEN 0 ELSE 1 END AS n_history, CASE WHEN res = 'passed' OR (res = 'skipped' AND old = 'proven') THEN '2026-01-01' END AS proven FROM r""")
def ledger_transition(spark, sf):
    changed = lg.apply_results(_full_ledger(spark, sf), _results(spark, sf), "2026-01-01")
    return changed.select("id", "status", "proof_tier", F.size("status_history").alias("n_history"), "proven")


_ITEM_ORIGIN = "concat(l_returnflag, '-', l_linenumber, '-', l_partkey)"


@query("ledger_insert_absent", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, 'documents' AS origin FROM documents UNION ALL
SELECT CAST(l_orderkey AS VARCHAR), min({_ITEM_ORIGIN}) FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents) GROUP BY 1""")
def ledger_insert_absent(spark, sf):
    """Many new rows of one id: the first comes in."""
    old = _t(spark, sf, "documents").select(c("doc_id").cast("string").alias("id"), F.lit("documents").alias("origin"))
    new = _t(spark, sf, "lineitem").select(c("l_orderkey").cast("string").alias("id"), F.expr(_ITEM_ORIGIN).alias("origin"))
    return lg.insert_absent(old, new)


@query("upsert", f"""
WITH n AS (SELECT l_orderkey AS id, {_ITEM_ORIGIN} AS origin, l_shipdate AS changed, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_shipdate DESC, {_ITEM_ORIGIN} DESC) AS nr FROM lineitem)
SELECT id, origin, changed FROM n WHERE nr = 1 UNION ALL SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT id FROM n)""")
def upsert(spark, sf):
    """Several changes of one key: the last wins."""
    old = _t(spark, sf, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("origin"), c("o_orderdate").alias("changed"))
    new = _t(spark, sf, "lineitem").select(c("l_orderkey").alias("id"), F.expr(_ITEM_ORIGIN).alias("origin"), c("l_shipdate").alias("changed"))
    return lg.upsert(old, new, ["id"], "changed")


@query("ledger_violations", """
WITH x AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'proven' WHEN 'O' THEN 'candidate' ELSE 'unknown' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN NULL ELSE 2 END AS tier, CASE WHEN o_totalprice > 250000 THEN '1996-01-01' END AS proven FROM orders)
SELECT id, 'invalid status: unknown' AS problem FROM x WHERE status = 'unknown' UNION ALL SELECT id, 'proof_tier must be an int 0-3' FROM x WHERE tier = 5
UNION ALL SELECT id, 'missing required fields: proof_tier' FROM x WHERE tier IS NULL UNION ALL SELECT id, 'proven without a date' FROM x WHERE status = 'proven' AND proven IS NULL""")
def ledger_violations(spark, sf):
    other = [n for n in lg.REQUIRED if n not in ("id", "status", "proof_tier")]
    rows = _t(spark, sf, "orders").select(
        c("o_orderkey").alias("id"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'proven' WHEN 'O' THEN 'candidate' ELSE 'unknown' END").alias("status"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN NULL ELSE 2 END").alias("proof_tier"),
        F.expr("CASE WHEN o_totalprice > 250000 THEN '1996-01-01' END").alias("proven"), *[F.lit("x").alias(n) for n in other])
    return lg.violations(rows)


@query("ledger_integrity", """
WITH a AS (SELECT item_id AS id, substr(sha256(text), 1, 16) AS h FROM benchmark), s AS (SELECT doc_id AS id, CASE WHEN n_chars < 100 THEN NULL ELSE substr(sha256(text), 1, 16) END AS h FROM documents)
SELECT s.id, CASE WHEN a.h IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM s LEFT JOIN a USING (id) WHERE s.h IS NOT NULL AND (a.h IS NULL OR a.h <> s.h)""")
def ledger_integrity(spark, sf):
    stored = _t(spark, sf, "documents").select(c("doc_id").alias("id"), F.when(c("n_chars") >= 100, text.stable_hash("text")).alias("reproducer_hash"))
    current = _t(spark, sf, "benchmark").select(c("item_id").alias("id"), text.stable_hash("text").alias("current_hash"))
    return lg.integrity(stored, current)


@query("eligibility_gate", f"WITH {_LEDGER_SQL} SELECT id FROM led WHERE status = 'proven' AND n_chars > 1000")
def eligibility_gate(spark, sf):
    tiered = _ledger(spark, sf).withColumn("proof_tier", F.when(c("n_chars") > 1000, 2).when(c("n_chars") > 500, 1))
    return lg.eligible(tiered, 2).select("id")


@query("taxonomy_drift", f"""WITH {_LEDGER_SQL}, reg AS (SELECT 'FR-EN' AS entry UNION SELECT DISTINCT taxonomy_id FROM led WHERE quality = 1)
  SELECT DISTINCT taxonomy_id FROM led WHERE regexp_replace(taxonomy_id, '-[^-]*$', '') NOT IN (SELECT entry FROM reg) AND taxonomy_id NOT IN (SELECT entry FROM reg)""")
def taxonomy_drift(spark, sf):
    ledger = _ledger(spark, sf)
    registry = ledger.where("quality = 1").select(c("taxonomy_id").alias("entry")).union(
        spark.createDataFrame([("FR-EN",)], "entry string"))
    return lg.taxonomy_drift(ledger, registry)


_REGISTERED = ", ".join(f"('{e}', '{t}', {a if a is not None else 'NULL'}, {b if b is not None else 'NULL'})" for e, t, a, b in rl.registry_ranges())


@query("registry_coverage", f"""WITH reg AS (SELECT * FROM (VALUES {_REGISTERED}) v(entry, tier, f, l) WHERE tier <> 'extensions'), x AS (SELECT {_FAMILY} AS id FROM orders),
g AS (SELECT regexp_replace(id, '-[^-]*$', '') AS entry, count(*) AS n_findings, count(DISTINCT id) AS n_rules FROM x GROUP BY 1)
SELECT reg.entry, tier, CAST(l - f + 1 AS INT) AS n_given, CAST(coalesce(n_findings, 0) AS BIGINT) AS n_findings, coalesce(n_rules, 0) AS n_rules FROM reg LEFT JOIN g USING (entry)""")
def registry_coverage(spark, sf):
    """Findings of every family of the registry."""
    found = _t(spark, sf, "orders").select(F.expr(_FAMILY).alias("taxonomy_id"))
    return rl.coverage(found, rl.taxonomy(spark)).drop("name")


_NUMBERED = "CASE o_orderstatus WHEN 'F' THEN 'FR-PERM-' WHEN 'O' THEN 'FR-NONE-' ELSE 'FR-CORR-' END || lpad(CAST(o_custkey % 9 + 1 AS VARCHAR), 3, '0')"


@query("registry_drift", f"""WITH reg AS (SELECT * FROM (VALUES {_REGISTERED}) v(entry, tier, f, l)), x AS (SELECT DISTINCT {_NUMBERED} AS id FROM orders),
y AS (SELECT id, CAST(substr(id, 9) AS INT) AS n, e.entry AS e, fam.entry AS fam, fam.f, fam.l FROM x LEFT JOIN reg e ON e.entry = id LEFT JOIN reg fam ON fam.entry = substr(id, 1, 7))
SELECT id AS taxonomy_id, coalesce(e, fam) AS entry, CASE WHEN e IS NULL AND fam IS NULL THEN 'unknown' WHEN e IS NULL AND n NOT BETWEEN f AND l THEN 'number' END AS problem FROM y""")
def registry_drift(spark, sf):
    """Ids that the registry does not know, or whose family has not given out their number."""
    found = _t(spark, sf, "orders").select(F.expr(_NUMBERED.replace("CAST(o_custkey % 9 + 1 AS VARCHAR)", "CAST(o_custkey % 9 + 1 AS STRING)")).alias("taxonomy_id"))
    return rl.placed(found, rl.taxonomy(spark)).select("taxonomy_id", "entry", "problem")


@query("rules_as_of", """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q FROM lineitem),
d AS (SELECT p_partkey % 6 + 1 AS r, p_size AS v, max(p_name) AS recipe FROM part WHERE p_size % 4 = 0 GROUP BY 1, 2),
m AS (SELECT l_linenumber, q, max(v) AS v FROM (SELECT DISTINCT l_linenumber, q FROM x) JOIN d ON r = l_linenumber AND v <= q GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, q AS quantity, CASE WHEN m.v IS NOT NULL THEN '1.' || m.v || '.0' END AS dimension_version, recipe
FROM x LEFT JOIN m USING (l_linenumber, q) LEFT JOIN d ON d.r = l_linenumber AND d.v = m.v""")
def rules_as_of(spark, sf):
    """Items as findings, and what their rule said in the version they name (1.10.0 comes after 1.9.0)."""
    name = lambda number: F.concat(F.lit("FR-R"), number, F.lit("-001"))
    version = lambda number: F.concat(F.lit("1."), number.cast("string"), F.lit(".0"))
    found = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", c("l_quantity").cast("int").alias("quantity"),
                                             name(c("l_linenumber")).alias("rule_id"), version(c("l_quantity").cast("int")).alias("rule_version"))
    rules = _t(spark, sf, "part").where("p_size % 4 = 0").groupBy(name(c("p_partkey") % 6 + 1).alias("rule_id"), version(c("p_size")).alias("rule_version")).agg(
        F.max("p_name").alias("recipe"))
    return rl.as_of(found, rules, "recipe").select("l_orderkey", "l_linenumber", "quantity", "dimension_version", "recipe")


# ---- scans and proofs: customers and their orders --------------------------------------------------------
_STATE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'proven' WHEN '2-HIGH' THEN 'refuted' WHEN '3-MEDIUM' THEN 'skipped' WHEN '5-LOW' THEN 'error' ELSE 'candidate' END"


def _scan_findings(spark, sf):
    return _t(spark, sf, "orders").select(c("o_custkey").alias("scan_id"), c("o_orderkey").alias("finding_id"), F.expr(_STATE).alias("status"))


_COUNTS = ", ".join(f"count(*) FILTER (s = '{s}') AS {s}_count" for s in ("proven", "refuted", "skipped", "candidate"))


@query("scan_list", f"""SELECT c_custkey AS scan_id, c_name, count(o_orderkey) AS finding_count, {_COUNTS}
  FROM customer LEFT JOIN (SELECT *, {_STATE} AS s FROM orders) ON o_custkey = c_custkey GROUP BY 1, 2""")
def scan_list(spark, sf):
    scans = _t(spark, sf, "customer").select(c("c_custkey").alias("scan_id"), "c_name")
    return rp.scan_list(scans, _scan_findings(spark, sf))


@query("scan_stats", f"""SELECT scan_id, count(*) AS total, count(*) FILTER (s = 'proven') AS proven, count(*) FILTER (s = 'refuted') AS refuted,
  count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'candidate') AS candidate, count(*) FILTER (s = 'error') AS errors
  FROM (SELECT o_custkey AS scan_id, {_STATE} AS s FROM orders) GROUP BY 1""")
def scan_stats(spark, sf):
    return rp.scan_stats(_scan_findings(spark, sf))


# ---- the same as stored tables: written in two batches, proofs on top --------------------------------------
def _stored_records(spark, sf):
    """Orders are findings: the first batch has those before 1997, the second all of urgent priority and
    those since 1996; every item of an order with three or more is a proof.  Customers are scans."""
    store = rc.open_records(spark, f"{work_dir(spark)}/records-{uuid.uuid4().hex}", parts=16)
    customers = _t(spark, sf, "customer").select(
        c("c_custkey").cast("string").alias("scan_id"), c("c_name").alias("repo_path"), c("c_acctbal").alias("started_at"))
    rc.start_scans(store, customers)
    orders = _t(spark, sf, "orders").withColumns({"id": c("o_orderkey").cast("string"), "rule_id": F.expr(_RULE), "file": c("o_orderstatus")})
    rows = lambda df, batch: rc.finding_rows(df.withColumn("line", F.lit(batch)), c("o_custkey").cast("string"), batch)
    rc.record_findings(store, rows(orders.where("o_orderdate < '1997-01-01'"), 1))
    rc.record_findings(store, rows(orders.where("o_orderdate >= '1996-01-01' OR o_orderpriority = '1-URGENT'"), 2))
    proofs = _t(spark, sf, "lineitem").where("l_linenumber >= 3").select(
        c("l_orderkey").cast("string").alias("finding_id"), c("l_linenumber").alias("exit_code"),
        *[F.lit(None).alias(n) for n in ("stdout", "stderr", "reproducer_path", "reproducer_source", "error_message", "duration_seconds")],
        F.expr("CASE WHEN l_linenumber % 3 = 0 THEN 'PASSED' WHEN l_linenumber % 3 = 1 THEN 'FAILED' ELSE 'SKIPPED' END").alias("proof_status"),
        (c("l_linenumber") % 4).cast("int").alias("proof_tier"), c("l_linenumber").cast("double").alias("proved_at"))
    rc.record_proofs(store, proofs)
    rc.finish_scans(store, customers.where("started_at > 0").select("scan_id", (c("started_at") + 1).alias("finished_at"), F.lit("done").alias("status")))
    return store


_STORED_SQL = f"""o AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS scan_id, {_RULE} AS rule_id, o_orderstatus AS file,
    CASE WHEN o_orderdate >= DATE '1996-01-01' OR o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS line FROM orders),
  p AS (SELECT l_orderkey AS k, max(l_linenumber) AS n FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1),
  stored AS (SELECT CAST(o.k AS VARCHAR) AS finding_id, scan_id, rule_id, file, line, CASE WHEN n IS NULL THEN 'candidate' WHEN n % 3 = 0 THEN 'proven'
    WHEN n % 3 = 1 THEN 'refuted' ELSE 'skipped' END AS status, CASE n % 3 WHEN 0 THEN 'PASSED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'SKIPPED' END AS proof_status,
    n % 4 AS proof_tier FROM o LEFT JOIN p USING (k))"""


@query("stored_findings", f"WITH {_STORED_SQL} SELECT finding_id, scan_id, rule_id, file, line, status, proof_status, CAST(proof_tier AS INT) AS proof_tier FROM stored")
def stored_findings(spark, sf):
    """The findings table after two overlapping batches and the proofs."""
    return _stored_records(spark, sf).findings.read().select(
        "finding_id", "scan_id", "rule_id", "file", "line", "status", "proof_status", "proof_tier")


@query("stored_scans", f"""WITH {_STORED_SQL} SELECT CAST(c_custkey AS VARCHAR) AS scan_id, c_name AS repo_path, CAST(c_acctbal AS DOUBLE) AS started_at,
  CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DOUBLE) + 1 END AS finished_at, CASE WHEN c_acctbal > 0 THEN 'done' ELSE 'running' END AS status,
  count(finding_id) AS finding_count, count(*) FILTER (stored.status = 'proven') AS proven_count, count(*) FILTER (stored.status = 'refuted') AS refuted_count,
  count(*) FILTER (stored.status = 'skipped') AS skipped_count, count(*) FILTER (stored.status = 'candidate') AS candidate_count
  FROM customer LEFT JOIN stored ON scan_id = CAST(c_custkey AS VARCHAR) GROUP BY c_custkey, c_name, c_acctbal""")
def stored_scans(spark, sf):
    """The list of scans, from the stored tables."""
    store = _stored_records(spark, sf)
    return rp.scan_list(store.scans.read(), store.findings.read())


@query("latest_scan", "SELECT arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS scan_id FROM orders WHERE o_orderstatus = 'F'")
def latest_scan(spark, sf):
    return rp.latest_scan(_t(spark, sf, "orders").select(
        c("o_orderkey").alias("scan_id"), F.when(c("o_orderstatus") == "F", "done").otherwise("running").alias("status"),
        c("o_orderdate").alias("finished_at"), c("o_orderdate").alias("started_at")))


@query("proof_summary", f"""SELECT count(*) AS total, count(*) FILTER (s = 'proven') AS proven, count(*) FILTER (s = 'refuted') AS refuted,
  count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'error') AS errors,
  100.0::DOUBLE * count(*) FILTER (s = 'proven') / count(*) AS proven_pct FROM (SELECT {_STATE} AS s FROM orders)""")
def proof_summary(spark, sf):
    return rp.proof_summary(_scan_findings(spark, sf))


# every line of an order is a proof result of it; the last one counts
_LAST_ITEM = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1"


def _item_results(spark, sf):
    return _t(spark, sf, "lineitem").withColumn("nr", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


@query("proof_detail", f"""WITH p AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'skipped' ELSE 'passed' END AS ps, CASE WHEN l_returnflag = 'A' THEN NULL ELSE 0 END AS ec,
    CASE WHEN l_linestatus = 'F' THEN 'out' ELSE '' END AS so, CASE WHEN l_quantity > 30 THEN 'No bench configured here' WHEN l_quantity > 15 THEN 'no reproducer' WHEN l_quantity > 5 THEN 'x' END AS em
    FROM lineitem QUALIFY {_LAST_ITEM}), j AS (SELECT o_orderkey, {_STATE} AS s, p.* FROM orders LEFT JOIN p ON l_orderkey = o_orderkey)
  SELECT o_orderkey AS finding_id, coalesce(ps, s) AS proof_status, CASE WHEN l_orderkey IS NULL THEN 0 ELSE 1 END AS proof_tier, ec AS exit_code, coalesce(so, '') AS stdout,
  CASE WHEN l_orderkey IS NULL THEN CASE WHEN s = 'candidate' THEN 'not run' END WHEN ps = 'skipped' OR (ec IS NULL AND so = '') THEN
    CASE WHEN em LIKE 'No bench%' THEN 'no server configured' WHEN em = 'no reproducer' THEN 'no strategy for this rule' ELSE coalesce(em, 'skipped') END END AS skip_reason FROM j""")
def proof_detail(spark, sf):
    proofs = _item_results(spark, sf).selectExpr(
        "l_orderkey AS finding_id", "CASE WHEN l_returnflag = 'R' THEN 'skipped' ELSE 'passed' END AS proof_status", "1 AS proof_tier",
        "CASE WHEN l_returnflag = 'A' THEN NULL ELSE 0 END AS exit_code", "CASE WHEN l_linestatus = 'F' THEN 'out' ELSE '' END AS stdout",
        "CASE WHEN l_quantity > 30 THEN 'No bench configured here' WHEN l_quantity > 15 THEN 'no reproducer' WHEN l_quantity > 5 THEN 'x' END AS error_message", "nr")
    found = _scan_findings(spark, sf).select("finding_id", "status", F.lit(None).cast("string").alias("proof_status"), F.lit(0).alias("proof_tier"))
    return vw.proof_details(found, proofs, "nr")


@query("status_update", f"""WITH p AS (SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem QUALIFY {_LAST_ITEM})
  SELECT o_orderkey AS finding_id, CASE WHEN l_orderkey IS NULL THEN {_STATE} WHEN l_linestatus = 'O' THEN 'error'
  WHEN l_returnflag = 'A' THEN 'proven' WHEN l_returnflag = 'N' THEN 'refuted' ELSE 'skipped' END AS status FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def status_update(spark, sf):
    results = _item_results(spark, sf).select(c("l_orderkey").alias("finding_id"), F.expr(
        "CASE WHEN l_linestatus = 'O' THEN 'odd' WHEN l_returnflag = 'A' THEN 'passed' WHEN l_returnflag = 'N' THEN 'FAILED' ELSE 'Skipped' END").alias("proof_status"), "nr")
    return lg.update_status(_scan_findings(spark, sf), results, "nr").select("finding_id", "status")


@query("keep_newest", "SELECT o_orderkey FROM orders ORDER BY (o_orderdate, o_orderkey) DESC LIMIT 1000")
def keep_newest(spark, sf):
    return lg.keep_newest(_t(spark, sf, "orders").select("o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("t")), "t", 1000).select("o_orderkey")


# ---- findings list ------------------------------------------------------------------------------------------
def _list(spark, sf):
    return _t(spark, sf, "orders").select(
        F.expr("concat('o', o_orderkey)").alias("id"), F.expr(_RULE).alias("rule_id"), F.expr("concat('c', o_custkey)").alias("file"),
        F.dayofmonth("o_orderdate").alias("line"), c("o_orderpriority").alias("function"), c("o_orderstatus").alias("evidence"),
        F.expr(_STATE).alias("status"), (c("o_totalprice") / 6000).alias("score"))


@query("search_filter", f"""SELECT 'o' || o_orderkey AS id FROM orders WHERE contains(lower({_RULE} || ' c' || o_custkey || ' ' || o_orderpriority || ' ' || o_orderstatus), 'c12')
  AND {_STATE} = 'proven' AND o_totalprice / 6000 >= 20 AND o_totalprice / 6000 < 40""")
def search_filter(spark, sf):
    return vw.filtered(_list(spark, sf), text="C12", status="proven", severity="MEDIUM").select("id")


@query("locator_select", f"""SELECT DISTINCT 'o' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' OR ('c' || o_custkey, date_part('day', o_orderdate)::INT, {_RULE}, o_orderpriority) IN
  (SELECT 'c' || o_custkey, date_part('day', o_orderdate)::INT, {_RULE}, o_orderpriority FROM orders WHERE o_totalprice > 300000)""")
def locator_select(spark, sf):
    rows = _list(spark, sf)
    return vw.select(rows, rows.where("evidence = 'P'").select("id"), rows.where("score > 50")).select("id")


@query("list_sort", f"""SELECT 'o' || o_orderkey AS id FROM orders ORDER BY 'c' || o_custkey || ':' || lpad(CAST(date_part('day', o_orderdate)::INT AS VARCHAR), 10, '0'), 'o' || o_orderkey LIMIT 200""")
def list_sort(spark, sf):
    return vw.top(_list(spark, sf), [*vw.sort_keys("location", descending=False), c("id")], 200).select("id")


def _texts(spark, sf):
    return _t(spark, sf, "documents").select(c("source").alias("repo"), F.expr("concat('d', doc_id)").alias("file"), "text")


@query("snippet_window", """
WITH l AS (SELECT 'd' || doc_id AS file, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS num FROM documents)
SELECT file, 3 AS target, num::INT AS num, code, num = 3 AS is_error FROM l WHERE num BETWEEN 1 AND 6""")
def snippet_window(spark, sf):
    wanted = _t(spark, sf, "documents").select(
        c("source").alias("repo"), F.expr("concat('d', doc_id)").alias("file"), F.lit("3").alias("line"))
    return vw.snippets(wanted, _texts(spark, sf)).drop("repo")


@query("source_lines", """SELECT 'd' || doc_id AS file, count(*) AS n, max(len(code)) AS longest FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS code FROM documents) GROUP BY 1""")
def source_lines(spark, sf):
    return vw.source_lines(_texts(spark, sf)).groupBy("file").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


_RAW_STATUS = "CASE event_type WHEN 'signup' THEN 'PASSED' WHEN 'purchase' THEN 'Fail' WHEN 'view' THEN 'skip' WHEN 'error' THEN 'proven' ELSE 'other' END"


@query("status_normalise", """SELECT event_id, CASE event_type WHEN 'signup' THEN 'proven' WHEN 'purchase' THEN 'refuted' WHEN 'view' THEN 'skipped' WHEN 'error' THEN 'proven'
  ELSE 'candidate' END AS status FROM events""")
def status_normalise(spark, sf):
    return _t(spark, sf, "events").select("event_id", text.plain_status(F.expr(_RAW_STATUS)).alias("status"))


@query("line_numbers", """SELECT event_id, CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' THEN 1 ELSE greatest(1, json_extract_string(props, '$.k')::INT - 50) END AS line FROM events""")
def line_numbers(spark, sf):
    given = F.when(c("event_type") == "click", "abc").when(c("event_type") == "view", "").otherwise(
        (F.get_json_object("props", "$.k").cast("int") - 50).cast("string"))
    return _t(spark, sf, "events").select("event_id", text.line_number(given).alias("line"))


@query("line_break_guard", "SELECT conv_id, turn FROM conversations WHERE NOT regexp_matches(text, '[\\r\\n]')")
def line_break_guard(spark, sf):
    return _t(spark, sf, "conversations").where(~text.has_line_break("text")).select("conv_id", "turn")
