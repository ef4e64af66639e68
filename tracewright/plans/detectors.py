"""The detectors, declared as column conditions over a few shared views.

A detector names the view it reads, the condition that makes a row a candidate and
the texts of the candidate.  All detectors of a view run in one pass: the view is
joined once with the per-function flags (and document types), then every row
yields the candidates of the conditions it meets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import framework as fw
from ..functions.text import (
    identifiers, is_non_runtime_path, is_report_path, is_workflow_path,
    last_segment, mentions_name, path_order, stable_hash, symbol_function,
)
from ..operators.facts import Facts, kind, null_safe_in
from ..operators.mentions import candidate_mentions
from ..sources.hooks import collisions

c = F.col
DEFAULT_VERSION = "1.0.0"
VERSIONS = {"FR-PERM-002": "1.1.0"}


@dataclass
class Index:
    """What the detectors read; every member is a DataFrame of one scan."""

    facts: Facts
    symbols: DataFrame
    doctypes: DataFrame
    handlers: DataFrame
    permission_hooks: DataFrame
    document_classes: DataFrame
    _views: dict = field(default_factory=dict)

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            self._views[name] = VIEWS[name](self)
        return self._views[name]


@dataclass(frozen=True)
class Detector:
    rule_id: str
    view: str
    when: Callable[[], Column]
    evidence: Callable[[], Column]
    recipe: str
    fix: Callable[[], Column] | str = "none"
    target_arg: Callable[[], Column] | None = None
    location_hash: Callable[[], Column] | None = None
    tie: Callable[[], Column] | None = None  # breaks ties among rows of one location
    enabled: bool = True

    @property
    def version(self) -> str:
        return VERSIONS.get(self.rule_id, DEFAULT_VERSION)


# ---- views ----------------------------------------------------------------------------
VIEWS: dict[str, Callable[[Index], DataFrame]] = {}


def view(name: str):
    def register(build):
        VIEWS[name] = build
        return build
    return register


def _located(df: DataFrame, *extra, file="path", line="line_start", function="func") -> DataFrame:
    """Rename a fact row's location to the candidate's columns."""
    return df.select(
        "repo", c(file).alias("file"), c(line).alias("line"), c(function).alias("function"),
        c("hash").alias("code_location_hash"), F.struct(path_order("path").alias("file"), c("ord").alias("ord")).alias("at"),
        (~is_non_runtime_path("path")).alias("runtime"), *extra,
    )


_SYMBOL = ("reachable", "exposed", "guarded", "mutates", "has_check", "writes_docstatus", "sets_value",
           "is_endpoint", "is_report")


def _with_symbols(df: DataFrame, ix: Index, *flags: str) -> DataFrame:
    return df.join(ix.symbols.select("repo", "symbol_id", *flags), ["repo", "symbol_id"])


@view("calls")
def _calls(ix: Index) -> DataFrame:
    """Framework calls, with the flags of the calling function and of the written type."""
    marks = {
        "raw_sql": c("is_sql") & c("sql_query").isNull() & c("value_from_request") & ~c("sql_parameterised"),
        "dynamic_table": c("is_builder") & c("builder_is_dynamic"),
        "set_value": c("is_set_value"),
        "commit": c("is_commit"),
        "unkeyed_job": c("is_enqueue") & ~c("has_dedupe_key"),
        "mass_assignment": c("is_get_doc") & c("get_doc_is_controlled"),
        "evaluates_input": c("is_eval") & c("argument_from_request"),
        "dynamic_url": c("is_outbound") & c("outbound_is_dynamic"),
        "hardcoded_text": c("is_hardcoded_message"),
        "unescaped_text": c("is_unescaped_message"),
    }
    marked = ix.facts.rows.where(kind("call")).select(
        "repo", "path", "line_start", "func", "hash", "ord", "symbol_id", "name",
        c("set_value_doctype").alias("doctype"), c("set_value_field").alias("field"),
        *[F.coalesce(v, F.lit(False)).alias(k) for k, v in marks.items()],
    )
    any_mark = F.array_contains(F.array(*marks), True)
    marked = _with_symbols(marked.where(any_mark), ix, "reachable", "has_check", "writes_docstatus")
    types = ix.doctypes.select(
        "repo", c("name").alias("doctype"), "is_submittable", "istable", "owner_scoped", F.lit(True).alias("known")
    )
    handled = ix.handlers.select("repo", last_segment("handler").alias("bare"), F.lit(True).alias("is_handler")).distinct()
    # most calls name no type: give them keys that match nothing instead of one NULL key,
    # which would send all of them to a single task
    nobody = F.concat(F.lit("\u0000"), F.pmod(F.hash("path", "ord"), F.lit(1024)).cast("string"))
    joined = (
        marked.withColumn("bare", last_segment("func")).withColumn("doctype", F.coalesce("doctype", nobody))
        .join(types, ["repo", "doctype"], "left").join(handled, ["repo", "bare"], "left")
        .na.fill(False, ["is_submittable", "istable", "owner_scoped", "known", "is_handler"])
    )
    return _located(
        joined, "name", "bare", "doctype", "field", *marks, "reachable", "has_check", "writes_docstatus",
        "is_submittable", "istable", "owner_scoped", "known", "is_handler",
    )


@view("tables")
def _tables(ix: Index) -> DataFrame:
    """SQL texts with every document type whose table they may mention.

    The exact test is left to each detector.
    """
    queries = ix.facts.rows.where(kind("call") & c("is_sql") & c("sql_query").isNotNull()).select(
        "repo", "path", "line_start", "func", "hash", "ord", "symbol_id", c("sql_query").alias("query")
    )
    queries = _with_symbols(queries, ix, "reachable")
    hooked = ix.permission_hooks.groupBy("repo", c("doctype").alias("name")).agg(
        F.max(c("section") == "permission_query_conditions").alias("query_hook"),
        F.max(c("section") == "has_permission").alias("permission_hook"),
    )
    types = (
        ix.doctypes.select("repo", "name", "table_name", "is_submittable")
        .join(hooked, ["repo", "name"], "left").na.fill(False, ["query_hook", "permission_hook"])
    )
    joined = candidate_mentions(queries, types, ["path", "ord"], "query", "table_name", on=["repo"], prefix="tab")
    return _located(
        joined, "query", c("name").alias("doctype"), "table_name", "is_submittable", "query_hook",
        "permission_hook", "reachable",
        F.array_contains(identifiers("query"), c("table_name")).alias("named_exactly"),
    )


@view("endpoints")
def _endpoints(ix: Index) -> DataFrame:
    rows = ix.facts.rows.where(kind("def") & c("is_endpoint")).select(
        "repo", "path", "line_start", "func", "hash", "ord", "symbol_id", c("allow_guest").alias("allow_guest")
    )
    return _located(_with_symbols(rows, ix, "guarded", "mutates", "sets_value"),
                    "allow_guest", "guarded", "mutates", "sets_value")


@view("flags")
def _flags(ix: Index) -> DataFrame:
    return _located(_with_symbols(ix.facts.ignore_permissions, ix, "exposed"), "call_name", "exposed")


@view("paths")
def _paths(ix: Index) -> DataFrame:
    rows = _with_symbols(ix.facts.path_accesses, ix, "reachable")
    return _located(rows, "call_name", "has_guard", "reachable")


@view("classes")
def _classes(ix: Index) -> DataFrame:
    return _located(ix.facts.class_lifecycles, "class_name", "methods", "has_on_submit", "has_on_cancel", function="class_name")


@view("amended_classes")
def _amended_classes(ix: Index) -> DataFrame:
    """Submit handlers of amendable types; of all types where a repository names none."""
    amendable = ix.doctypes.where("is_amendable").select("repo", c("name").alias("class_name"), F.lit(True).alias("amendable"))
    # a repository counts once; its classes meet that row under spread keys, so that one
    # large repository is not one task
    spread = F.sequence(F.lit(0), F.lit(63))
    naming = amendable.select("repo").distinct().select("repo", F.explode(spread).alias("salt"), F.lit(True).alias("some_amendable"))
    rows = (
        ix.facts.class_lifecycles.where("has_on_submit").join(amendable, ["repo", "class_name"], "left")
        .withColumn("salt", F.pmod(F.hash("path", "ord"), F.lit(64)))
        .join(naming, ["repo", "salt"], "left").na.fill(False, ["amendable", "some_amendable"])
    )
    return _located(rows, "class_name", "methods", "amendable", "some_amendable", function="class_name")


@view("collisions")
def _collisions(ix: Index) -> DataFrame:
    target = F.concat_ws(".", "doctype", "event")
    return collisions(ix.handlers).select(
        "repo", c("first_path").alias("file"), F.lit(0).alias("line"), target.alias("function"),
        F.concat_ws("_", F.lit("hook_collision"), "doctype", "event").alias("code_location_hash"),
        F.struct(target.alias("file"), F.lit(0).alias("ord")).alias("at"), "n_handlers",
    )


@view("statements")
def _statements(ix: Index) -> DataFrame:
    rows = ix.facts.rows.where(kind("except") & c("is_silent_except") | kind("loop_call") & c("is_query_in_loop"))
    return _located(rows.withColumn("func", symbol_function("symbol_id")), "kind")


@view("defaults")
def _defaults(ix: Index) -> DataFrame:
    return _located(ix.facts.mutable_default_args.withColumn("func", symbol_function("symbol_id")),
                    "arg_name", "arg_pos", "default_kind")


@view("fields")
def _fields(ix: Index) -> DataFrame:
    reads = ix.facts.field_references(ix.document_classes)
    types = ix.doctypes.select("repo", c("name").alias("doctype"), F.transform("fields", lambda f: f["fieldname"]).alias("known_fields"))
    rows = reads.join(types, ["repo", "doctype"]).withColumn("func", symbol_function("symbol_id"))
    return _located(rows, "doctype", "fieldname", "confidence", F.array_contains("known_fields", c("fieldname")).alias("is_known"))


# ---- detectors ---------------------------------------------------------------------------
def _runtime():
    return c("runtime")


def say(*parts) -> Callable[[], Column]:
    """Text with column values: strings starting with ``:`` name a column."""
    return lambda: F.concat(*[F.coalesce(c(p[1:]), F.lit("")) if p.startswith(":") else F.lit(p) for p in parts])


DETECTORS: tuple[Detector, ...] = (
    Detector(
        "FR-SQLI-001", "calls", lambda: c("raw_sql") & c("reachable"),
        say("SQL text is assembled from request data and run without bound parameters."),
        "Send a value containing SQL syntax through the endpoint and check that the statement keeps its meaning.",
    ),
    Detector(
        "FR-SQLI-002", "tables",
        lambda: c("is_submittable") & ~F.contains(F.lower("query"), F.lit("docstatus")) & _runtime()
        & mentions_name("query", "table_name"),
        say("SQL reads or writes the submittable type ", ":doctype", " and does not look at docstatus."),
        "Create draft, submitted and cancelled documents and compare what the query returns for each.",
        tie=lambda: c("doctype"),
    ),
    Detector(
        "FR-SQLI-003", "calls",
        lambda: c("set_value") & c("reachable") & _runtime() & ~c("has_check")
        & ~null_safe_in(c("field"), fw.READ_MARKER_FIELDS),
        lambda: F.concat(F.lit("Direct database write to '"), F.coalesce(F.nullif("field", F.lit("")), F.lit("unknown")),
                         F.lit("' skips the controller's validation.")),
        "Call the endpoint and check whether validate() ran and derived values were refreshed.",
    ),
    Detector(
        "FR-SQLI-004", "calls", lambda: c("dynamic_table") & c("reachable"),
        say("The query builder gets a table or column name that is not a literal."),
        "Pass another table's name through the endpoint and check that the query does not follow it.",
    ),
    Detector(
        "FR-PERM-001", "endpoints",
        lambda: ~c("guarded") & (c("mutates") | ~last_segment("function").isin(*fw.PUBLIC_READ_FUNCTIONS)),
        lambda: F.when(c("mutates"), "Endpoint changes data and neither it nor a direct callee checks permissions.")
        .otherwise("Endpoint returns data and neither it nor a direct callee checks permissions."),
        "Call the endpoint as a user without rights on the data and check that it is refused.",
        fix=lambda: F.when(c("mutates"), "high").otherwise("low"),
    ),
    Detector(
        "FR-PERM-002", "flags",
        lambda: c("exposed") & ~c("call_name").isin(*fw.SAFE_IGNORE_CALLS) & ~c("call_name").endswith(".insert"),
        say("ignore_permissions=True can be reached from an endpoint that checks no permission."),
        "As the weakest allowed role, reach this call for a document of somebody else and check that it is refused.",
    ),
    Detector(
        "FR-PERM-003", "calls", lambda: c("set_value") & c("owner_scoped") & c("reachable") & _runtime(),
        say("Direct write to '", ":doctype", "', whose rows only their owner may change."),
        "Call the endpoint as a user who does not own the document and check that the write is refused.",
    ),
    Detector(
        "FR-PERM-004", "tables", lambda: is_report_path("file") & c("named_exactly") & ~c("query_hook"),
        say("Report queries '", ":doctype", "' in SQL; no permission_query_conditions hook covers the type."),
        "Run the report as a restricted user and look for rows of other users.",
        location_hash=lambda: stable_hash(F.concat_ws(":", "code_location_hash", "doctype")),
    ),
    Detector(
        "FR-PERM-005", "tables", lambda: c("reachable") & c("named_exactly") & c("permission_hook"),
        say("SQL on '", ":doctype", "' goes around the has_permission hook of the type."),
        "Call the endpoint as a restricted user and look for rows the hook hides in list views.",
        tie=lambda: c("doctype"),
    ),
    Detector(
        "FR-PERM-006", "calls", lambda: c("set_value") & c("istable") & c("reachable") & _runtime(),
        say("Direct write to the child type '", ":doctype", "' does not validate its parent again."),
        "Change a child row this way and check whether totals and checks of the parent are refreshed.",
    ),
    Detector(
        "FR-HOOK-001", "classes", lambda: c("has_on_submit") & ~c("has_on_cancel"),
        say("Class '", ":class_name", "' acts on submit and has no on_cancel to take it back."),
        "Submit and cancel a document and check that every effect of submitting is gone.",
    ),
    Detector(
        "FR-HOOK-002", "collisions", lambda: F.lit(True),
        lambda: F.concat(c("n_handlers").cast("string"), F.lit(" handlers of different apps hook '"), c("function"),
                         F.lit("'; their order is the order of installation.")),
        "Install the apps in both orders and compare the results.",
    ),
    Detector(
        "FR-HOOK-003", "calls", lambda: c("set_value") & c("reachable") & _runtime() & ~c("has_check"),
        lambda: F.concat(F.lit("Request path writes '"), F.coalesce(F.nullif("field", F.lit("")), F.lit("field")),
                         F.lit("' in the database instead of saving the document.")),
        "Call the endpoint and check whether the hooks of the document ran.",
    ),
    Detector(
        "FR-HOOK-004", "calls", lambda: c("unkeyed_job") & _runtime(),
        say("A background job is queued without a key that keeps it from running twice."),
        "Stop the worker in the middle of the job and check what the second run does.",
        fix="medium",
    ),
    Detector(
        "FR-HOOK-005", "calls", lambda: c("commit") & (c("bare").isin(*fw.LIFECYCLE_METHODS) | c("is_handler")),
        say("The transaction is committed inside a document hook."),
        "Make a later hook fail and check that everything is rolled back.",
    ),
    Detector(
        "FR-HOOK-006", "statements", lambda: c("kind") == "except",
        say("A catch-all handler drops every error without a trace."),
        "Raise an error in the guarded block and check that somebody notices.",
    ),
    Detector(
        "FR-HOOK-007", "defaults", lambda: F.lit(True),
        say("Argument '", ":arg_name", "' has a ", ":default_kind", " as default that all calls share."),
        "Call the function twice without the argument and compare.",
        fix="high", target_arg=lambda: c("arg_name"), tie=lambda: F.lpad(c("arg_pos").cast("string"), 6, "0"),
    ),
    Detector(
        "FR-WKFL-001", "calls",
        lambda: c("set_value") & c("is_submittable") & c("reachable") & _runtime() & ~c("has_check")
        & ~null_safe_in(c("field"), ("docstatus",)),
        say("Direct write to the submittable type '", ":doctype", "' without looking at docstatus."),
        "Call the endpoint for submitted and cancelled documents and check that the write is refused.",
        fix="medium",
    ),
    Detector(
        "FR-WKFL-002", "calls",
        lambda: c("set_value") & (c("field") == "workflow_state") & c("reachable") & ~is_workflow_path("file"),
        say("workflow_state is written directly on a request path."),
        "Call the endpoint as a role that may not make the transition and check that it is refused.",
    ),
    Detector(
        "FR-WKFL-003", "calls",
        lambda: c("set_value") & (c("field") == "status") & _runtime() & ~c("writes_docstatus")
        & ~(c("known") & ~c("is_submittable")),
        say("status is written and docstatus is not, in the same function."),
        "Set the status this way and compare it with docstatus.",
    ),
    Detector(
        "FR-WKFL-004", "amended_classes",
        lambda: (~c("some_amendable") | c("amendable"))
        & ~F.arrays_overlap("methods", F.array(F.lit("before_insert"), F.lit("after_insert"))),
        say("Amendable class '", ":class_name", "' does not reset fields when it is amended."),
        "Submit, cancel and amend a document and look for values that should be empty.",
        enabled=False,
    ),
    Detector(
        "FR-INJ-001", "calls", lambda: c("mass_assignment") & c("reachable"),
        say("Request data is turned into a document as a whole."),
        "Add owner, docstatus and name to the request and check that they are ignored.",
    ),
    Detector(
        "FR-INJ-002", "calls", lambda: c("evaluates_input") & c("reachable"),
        say(":name", "() runs text that comes from the request."),
        "Send an expression with a visible effect and check that it does not run.",
    ),
    Detector(
        "FR-INJ-005", "calls", lambda: c("unescaped_text") & c("reachable"),
        say("A message shows request data without escaping it."),
        "Send markup in the field and check that it is shown as text.",
        enabled=False,
    ),
    Detector(
        "FR-CSRF-001", "endpoints", lambda: c("allow_guest") & c("sets_value"),
        say("An endpoint open to guests changes data and asks for no token."),
        "Post to the endpoint from a page of another origin and check that it is refused.",
    ),
    Detector(
        "FR-SSRF-001", "calls", lambda: c("dynamic_url") & c("reachable"),
        say("The address of an outgoing request is not fixed."),
        "Pass an internal address and check that no request is made.",
    ),
    Detector(
        "FR-DATA-001", "fields", lambda: ~c("is_known") & ~c("fieldname").isin(*fw.DOCUMENT_ATTRIBUTES),
        say("'", ":doctype", "' has no field '", ":fieldname", "' (type known with ", ":confidence", " confidence)."),
        "Read the attribute on a document of the type.",
    ),
    Detector(
        "FR-PATH-001", "paths", lambda: ~c("has_guard") & c("reachable") & _runtime(),
        say("The path given to ", ":call_name", "() comes from the request and is not checked."),
        "Pass a path that leaves the folder and check that it is refused.",
        fix="high",
    ),
    Detector(
        "FR-PERF-001", "statements", lambda: (c("kind") == "loop_call") & _runtime(),
        say("A document is loaded for each row of a query result."),
        "Count the queries for ten and for a hundred rows.",
        fix="low",
    ),
    Detector(
        "FR-I18N-001", "calls", lambda: c("hardcoded_text"),
        say("The text shown by ", ":name", "() is not marked for translation."),
        "Switch the language and look at the message.",
        fix="high",
    ),
)

_custom: dict[str, Callable[[Index], DataFrame]] = {}


def rule(rule_id: str):
    """Register a detector of one's own: a function from the index to candidates
    (``repo, file, line, function, code_location_hash, evidence``)."""
    def register(build):
        _custom[rule_id] = build
        return build
    return register


def unregister(rule_id: str) -> None:
    _custom.pop(rule_id, None)


# ---- evaluation ----------------------------------------------------------------------------
def _candidate(d: Detector, position: int) -> Column:
    fix = F.lit(d.fix) if isinstance(d.fix, str) else d.fix()
    location = d.location_hash() if d.location_hash else c("code_location_hash")
    tie = d.tie() if d.tie else F.lit("")
    return F.when(d.when(), F.struct(
        F.lit(d.rule_id).alias("rule_id"), F.lit(d.version).alias("rule_version"),
        location.alias("code_location_hash"), d.evidence().alias("evidence"), F.lit(d.recipe).alias("proof_recipe"),
        fix.alias("fix_confidence"),
        (d.target_arg() if d.target_arg else F.lit(None)).cast("string").alias("target_arg"),
        F.struct(F.lit(position).alias("rule"), c("at.file").alias("file"), c("at.ord").alias("ord"),
                 tie.alias("tie")).alias("emit_ord"),
    ))


def _shape(df: DataFrame) -> DataFrame:
    return df.select(
        "repo", "m.rule_id", "m.rule_version", c("m.rule_id").alias("taxonomy_id"), "file", "line", "function",
        "m.code_location_hash", "m.evidence", "m.proof_recipe", F.lit(0).alias("proof_tier"),
        F.lit("candidate").alias("status"), "m.fix_confidence", "m.target_arg", "m.emit_ord",
    )


def candidates(ix: Index, rules: list[str] | None = None, log=None) -> DataFrame:
    """Raw candidates of the enabled detectors (or of the named ones, also disabled)."""
    chosen = [(n, d) for n, d in enumerate(DETECTORS)
              if (d.rule_id in rules if rules is not None else d.enabled)]
    parts = []
    for name in dict.fromkeys(d.view for _, d in chosen):
        base = _unless_broken(lambda: ix.view(name), name, log)
        own = [(n, d) for n, d in chosen if d.view == name]
        if base is not None and log is not None:  # a broken detector does not take the others of its view along
            own = [(n, d) for n, d in own
                   if _unless_broken(lambda: base.select(_candidate(d, n)), d.rule_id, log) is not None]
        if base is not None and own:
            matches = F.filter(F.array(*[_candidate(d, n) for n, d in own]), lambda m: m.isNotNull())
            parts.append(_shape(base.withColumn("m", F.explode(matches))))
    for position, (rule_id, build) in enumerate(_custom.items(), len(DETECTORS)):
        if rules is None or rule_id in rules:
            part = _unless_broken(lambda: _own(ix, rule_id, build, position), rule_id, log)
            parts += [part] if part is not None else []
    if not parts:
        none = ix.facts.rows.sparkSession.range(0).select(
            *[F.lit("").alias(x) for x in ("repo", "file", "function", "code_location_hash", "evidence")], F.lit(0).alias("line"))
        parts = [_own(ix, "", lambda _: none, 0)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _unless_broken(build, name, log):
    """What ``build`` makes; with a log, a failure is told there and gives None."""
    try:
        return build()
    except Exception as problem:
        if log is None:
            raise
        log(name, problem)
        return None


def _own(ix, rule_id, build, position):
    df = build(ix)
    given = lambda name, default: c(name) if name in df.columns else F.lit(default)
    match = F.struct(
        F.lit(rule_id).alias("rule_id"), given("rule_version", DEFAULT_VERSION).alias("rule_version"),
        c("code_location_hash"), c("evidence"), given("proof_recipe", "").alias("proof_recipe"),
        given("fix_confidence", "none").alias("fix_confidence"),
        given("target_arg", None).cast("string").alias("target_arg"),
        F.struct(F.lit(position).alias("rule"), path_order("file").alias("file"), c("line").cast("int").alias("ord"),
                 F.lit("").alias("tie")).alias("emit_ord"),
    )
    return _shape(df.select("repo", "file", "line", "function", match.alias("m")))
