"""Typed fact relations: column expressions over syntax rows, no shuffles.

Each predicate says when a syntax row is a fact of one kind.  The relations are
plain filters and projections, so Spark prunes them to the columns and row kinds
a detector needs.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import framework as fw
from ..functions.text import any_in, any_of, any_starts_with, is_report_path
from ..sources.syntax import PARAMETER



def c(name: str) -> Column:
    return F.col(name)


def kind(name: str) -> Column:
    return c("kind") == name


def null_safe_in(column: Column, values) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False))


# ---- taint: does a value come from the request? --------------------------------
def from_request(origins: str) -> Column:
    known = F.coalesce(c(origins), F.array().cast("array<string>"))
    return F.array_contains(known, PARAMETER) | any_starts_with(known, fw.REQUEST_PREFIXES)



def _keyword_text(*keys: str) -> Column:
    hit = F.filter(c("keyword_values"), lambda k: k["key"].isin(*keys))
    return F.get(hit, F.lit(0))["text"]


def fact_columns() -> dict[str, Column]:
    """All predicates and derived columns (built when used: columns need a session)."""
    # ---- definitions -----------------------------------------------------------------
    _decorator_names = F.transform(c("decorators"), lambda d: d["name"])
    is_endpoint = kind("def") & any_in(_decorator_names, [fw.ENDPOINT_DECORATOR])
    is_report_entry = kind("def") & (c("name") == "execute") & is_report_path("path")
    _guest_flags = F.filter(
        F.transform(
            F.filter(c("decorators"), lambda d: d["name"] == fw.ENDPOINT_DECORATOR),
            lambda d: d["flags"]["allow_guest"],
        ),
        lambda f: f.isNotNull(),
    )
    allow_guest = F.coalesce(F.get(_guest_flags, F.lit(0)), F.lit(False))

    # ---- calls -------------------------------------------------------------------------
    _call = kind("call")
    is_bare_call = _call & (c("shape") == "Name")
    is_sql = _call & (c("name") == fw.SQL_CALL)
    sql_query = c("value0.text")
    sql_parameterised = (c("n_args") > 1) | F.array_contains(c("keywords"), "values")
    is_set_value = _call & (c("name") == fw.SET_VALUE_CALL)
    set_value_doctype = F.when(c("n_args") > 0, F.get(c("arg_texts"), F.lit(0))).otherwise(_keyword_text("doctype"))
    set_value_field = F.when(c("n_args") >= 3, F.get(c("arg_texts"), F.lit(2))).otherwise(
        _keyword_text("fieldname", "field")
    )
    is_commit = _call & (c("name") == fw.COMMIT_CALL)
    is_enqueue = _call & (c("name") == fw.ENQUEUE_CALL)
    has_dedupe_key = any_in(c("keywords"), fw.DEDUPE_KEYWORDS)
    is_eval = _call & c("name").isin(*fw.EVAL_CALLS)
    is_builder = _call & c("name").isin(*fw.BUILDER_CALLS)

    _names_table = null_safe_in(c("value0.callee"), fw.BUILDER_TABLE_CALLS) | F.coalesce(
        c("value0.callee").endswith(".DocType"), F.lit(False)
    )
    _assembled = ("JoinedStr", "BinOp")
    builder_is_dynamic = (
        F.when(c("value0").isNull() | (c("value0.node") == "Constant"), F.lit(False))
        .when(c("value0.node").isin(*_assembled), F.lit(True))
        .when(
            (c("value0.node") == "Call") & _names_table & c("value0.inner_node").isNotNull(),
            F.when(c("value0.inner_node") == "Constant", F.lit(False))
            .when(c("value0.inner_node").isin(*_assembled), F.lit(True))
            .otherwise(from_request("value0.inner_origins")),
        )
        .otherwise(from_request("value0.origins"))
    )

    is_get_doc = _call & (c("name") == fw.GET_DOC_CALL)
    _spreads_keywords = F.coalesce(F.exists(c("keywords"), lambda k: k.isNull()), F.lit(False))
    get_doc_is_controlled = _spreads_keywords | (
        (c("n_args") == 1) & null_safe_in(c("arg0.node"), ("Name", "Call")) & from_request("arg0.origins")
    )
    _is_file_method = null_safe_in(c("attr"), fw.FILE_METHODS) & ~null_safe_in(c("name"), fw.FILE_CALLS)
    is_file_access = _call & (
        (null_safe_in(c("name"), fw.FILE_CALLS) & from_request("arg0.origins"))
        | (_is_file_method & from_request("receiver_origins"))
    )
    file_call_name = F.when(c("name") == "", c("attr")).otherwise(c("name"))

    is_message = _call & c("name").isin(*fw.MESSAGE_CALLS)
    is_hardcoded_message = is_message & (c("arg0.node") == "Constant") & c("arg0.text").isNotNull()
    _arg_is_call = c("arg0.node") == "Call"
    _translated = null_safe_in(c("arg0.callee"), ("_", "frappe._")) | F.coalesce(
        c("arg0.callee").endswith("._"), F.lit(False)
    )
    _plain_template = (F.length("arg0.template") > 0) & ~c("arg0.template").rlike("[<>]")
    _is_format = F.coalesce(c("arg0.method") == "format", F.lit(False))
    _neutral = _arg_is_call & F.when(_is_format, F.coalesce(_plain_template, F.lit(False))).otherwise(_translated)
    is_unescaped_message = is_message & c("arg0").isNotNull() & from_request("arg0.origins") & ~_neutral

    is_outbound = _call & c("name").isin(*fw.OUTBOUND_CALLS)
    _fixed_host = F.coalesce(
        ((c("arg0.node") == "JoinedStr") | (_arg_is_call & _is_format) | ((c("arg0.node") == "BinOp") & (c("arg0.method") == "%")))
        & c("arg0.template").rlike("(?s)^https?://.*?/"),
        F.lit(False),
    )
    outbound_is_dynamic = c("arg0").isNotNull() & (c("arg0.node") != "Constant") & ~_fixed_host

    is_string_dispatch = (
        _call & c("name").isin(*fw.DISPATCH_CALLS) & (c("arg0.node") == "Constant") & c("arg0.text").isNotNull()
    )
    dispatch_target = F.when(is_string_dispatch, c("arg0.text"))
    is_dynamic_method = _call & (c("receiver") == "Call")
    is_unresolved = _call & (c("shape") != "Name") & (c("name") == "")

    value_from_request = from_request("value0.origins")
    argument_from_request = from_request("arg0.origins")

    # ---- permission checks -----------------------------------------------------------
    _permission_call = null_safe_in(c("name"), fw.PERMISSION_CALLS + fw.SESSION_HELPERS) | null_safe_in(
        c("attr"), fw.PERMISSION_METHODS
    )
    _raises_denial = F.exists(c("arg_names"), lambda n: n.contains("PermissionError")) | F.exists(
        c("keyword_values"), lambda k: (k["key"] == "exc") & k["name"].contains("PermissionError")
    )
    _throws_denial = (null_safe_in(c("name"), fw.THROW_CALLS) | F.coalesce(c("attr") == "throw", F.lit(False))) & F.coalesce(
        _raises_denial, F.lit(False)
    )
    _denies = c("flag") | F.exists(c("body_calls"), lambda n: n.isin(*fw.DENY_CALLS) | n.endswith(".throw"))
    _asks_role = F.exists(
        c("calls"), lambda n: n.isin(*fw.ROLE_CALLS) | any_of(n.endswith(s) for s in fw.ROLE_METHOD_SUFFIXES)
    )
    _asks_owner = F.exists(c("names"), lambda n: n.endswith(".owner"))
    _developer_only = F.exists(c("names"), lambda n: n.endswith("developer_mode"))
    _caller_compared = F.array_contains(c("names"), fw.SESSION_USER) & (_asks_owner | _asks_role)
    is_permission_check = (
        (kind("def") & any_in(_decorator_names, fw.SEARCH_INPUT_DECORATORS))
        | (kind("attr") & (c("shape") == "watched") & (c("name") == fw.SESSION_USER))
        | (kind("if") & F.coalesce((_developer_only | _caller_compared) & _denies, F.lit(False)))
        | (kind("raise") & c("name").contains("PermissionError"))
        | (_call & (_permission_call | _throws_denial))
    )
    is_path_guard = kind("if") & (
        any_in(c("methods"), fw.PATH_GUARD_METHODS) | any_in(c("calls"), fw.PATH_GUARD_CALLS)
    )

    # ---- mutations ---------------------------------------------------------------------
    is_mutation = _call & (
        null_safe_in(c("attr"), fw.WRITE_METHODS)
        | null_safe_in(c("name"), fw.WRITE_CALLS)
        | F.coalesce((c("name") == fw.SQL_CALL) & sql_query.rlike(fw.WRITE_SQL_PATTERN), F.lit(False))
    )

    # ---- the rest ------------------------------------------------------------------------
    is_silent_except = kind("except") & c("flag") & (
        c("shape").isNull() | F.coalesce(c("raw") == "Exception", F.lit(False))
    )
    _builds_document = F.when(
        c("n_args") > 0, (c("arg0.node") == "Dict") | F.coalesce(c("arg0.callee") == "dict", F.lit(False))
    ).otherwise(F.coalesce(F.array_contains(c("keywords"), "doctype"), F.lit(False)))
    is_query_in_loop = kind("loop_call") & (c("raw") == fw.GET_DOC_CALL) & ~_builds_document
    is_field_read = kind("attr") & c("shape").isin("self", "variable")
    read_from_get_doc = F.coalesce(c("owner") == fw.GET_DOC_CALL, F.lit(False)) & c("owner_text").isNotNull()

    return {k: v for k, v in locals().items() if not k.startswith("_")}


# Columns of the syntax rows that stay as they are.
_KEPT = ("repo", "path", "ord", "kind", "symbol_id", "func", "fn", "cls", "name", "raw", "attr", "shape", "flag",
         "owner_text", "bases", "methods", "defaults", "line_start", "line_end", "hash")
_TEXTS = ("sql_query", "set_value_doctype", "set_value_field", "file_call_name", "dispatch_target")


def fact_table(rows: DataFrame) -> DataFrame:
    """Syntax rows -> fact rows: one narrow pass that replaces the syntactic details by
    one column per predicate."""
    return rows.select(*_KEPT, *[
        (value if name in _TEXTS else F.coalesce(value, F.lit(False))).alias(name)
        for name, value in fact_columns().items()
    ])


_LOCATION = ("repo", "path", "ord", "fn", "symbol_id", "func", "line_start", "line_end", "hash")


class Facts:
    """The fact relations of a set of source files."""

    def __init__(self, rows: DataFrame):
        """``rows``: a fact table."""
        self.rows = rows

    def _where(self, condition: Column, **columns: Column) -> DataFrame:
        return self.rows.where(condition).select(*_LOCATION, *[v.alias(k) for k, v in columns.items()])

    def _calls(self, condition: Column, **columns: Column) -> DataFrame:
        """Call facts: the kind prunes to the part of each file that holds calls."""
        return self._where(kind("call") & condition, **columns)

    @property
    def functions(self):
        return self._where(kind("def"), name=c("name"))

    @property
    def endpoints(self):
        return self._where(kind("def") & c("is_endpoint"), name=c("name"), allow_guest=c("allow_guest"))

    @property
    def report_entry_points(self):
        return self._where(kind("def") & c("is_report_entry"), name=c("name"))

    @property
    def calls(self):
        return self._calls(c("is_bare_call"), callee_name=c("raw"))

    @property
    def imports(self):
        return self.rows.where(kind("import")).select(
            "repo", "path", "ord", c("name").alias("local_name"), c("raw").alias("module"),
            c("attr").alias("imported_name"), c("flag").alias("used"),
        )

    @property
    def unused_imports(self):
        return (
            self.imports.where(~c("used") & ~c("local_name").startswith("_"))
            .select("repo", "path", "local_name").distinct()
        )

    @property
    def string_dispatch_calls(self):
        return self._calls(c("is_string_dispatch"), target=c("dispatch_target"))

    @property
    def dynamic_method_calls(self):
        return self._calls(c("is_dynamic_method"), method_name=c("attr"))

    @property
    def unresolved_calls(self):
        return self._calls(c("is_unresolved"))

    @property
    def sql_calls(self):
        return self._calls(
            c("is_sql"), parameterized=c("sql_parameterised"), dynamic=c("sql_query").isNull(),
            request_controlled=c("value_from_request"), query=c("sql_query"),
        )

    @property
    def permission_checks(self):
        return self._where(c("is_permission_check"))

    @property
    def commit_calls(self):
        return self._calls(c("is_commit"))

    @property
    def set_value_calls(self):
        return self._calls(c("is_set_value"), doctype_arg=c("set_value_doctype"), field_name=c("set_value_field"))

    @property
    def direct_writes(self):
        return self._calls(c("is_set_value"), field_name=c("set_value_field"))

    @property
    def mutations(self):
        return self._calls(c("is_mutation"), call_name=c("name"))

    @property
    def path_accesses(self):
        guards = self.rows.where(kind("if") & c("is_path_guard")).select("repo", "path", "fn").distinct().withColumn("g", F.lit(True))
        found = self._calls(c("is_file_access"), call_name=c("file_call_name"))
        return found.join(guards, ["repo", "path", "fn"], "left").withColumn(
            "has_guard", F.coalesce("g", F.lit(False))
        ).drop("g")

    @property
    def enqueue_calls(self):
        return self._calls(c("is_enqueue"), has_dedupe_key=c("has_dedupe_key"))

    @property
    def eval_exec_calls(self):
        return self._calls(c("is_eval"), call_type=c("name"), request_controlled=c("argument_from_request"))

    @property
    def query_builder_calls(self):
        return self._calls(c("is_builder"), dynamic_table=c("builder_is_dynamic"))

    @property
    def get_doc_kwargs(self):
        return self._calls(c("is_get_doc") & c("get_doc_is_controlled"), request_controlled=F.lit(True))

    @property
    def ignore_permissions(self):
        return self._where(kind("flag") & (c("attr") == "ignore_permissions"), call_name=c("name"))

    @property
    def hardcoded_user_strings(self):
        return self._calls(c("is_hardcoded_message"), call_kind=c("name"))

    @property
    def msgprint_calls(self):
        return self._calls(c("is_unescaped_message"), uses_unescaped_user_input=F.lit(True))

    @property
    def outbound_request_calls(self):
        return self._calls(c("is_outbound") & c("outbound_is_dynamic"), url_arg_is_dynamic=F.lit(True))

    @property
    def bare_except_blocks(self):
        return self._where(kind("except") & c("is_silent_except"), swallows_return=F.lit(True), catches_base_exception=F.lit(True))

    @property
    def mutable_default_args(self):
        exploded = self.rows.where(kind("def")).select(*_LOCATION, F.posexplode("defaults").alias("arg_pos", "d"))
        return exploded.select(*_LOCATION, "arg_pos", c("d.arg").alias("arg_name"), c("d.kind").alias("default_kind"))

    @property
    def queries_in_loop(self):
        return self._where(kind("loop_call") & c("is_query_in_loop"), query_kind=F.lit("get_doc"), loop_iterates_over_query_result=F.lit(True))

    @property
    def class_lifecycles(self):
        hooks = F.array_sort(F.array_intersect(c("methods"), F.array(*[F.lit(m) for m in fw.LIFECYCLE_METHODS])))
        has = {f"has_{m}": F.array_contains(c("methods"), m)
               for m in ("on_submit", "on_cancel", "before_save", "validate", "before_submit")}
        return self._where(kind("class"), class_name=c("name"), methods=hooks, **{
            k: v for k, v in has.items()}).where(F.size("methods") > 0)

    @property
    def parse_errors(self):
        return self.rows.where(kind("error")).select("repo", "path", c("name").alias("message"))

    def field_references(self, document_classes: DataFrame) -> DataFrame:
        """Attribute reads whose document type is known.

        ``document_classes``: (repo, path, cls, doctype), see ``operators.classes``.
        """
        reads = self.rows.where(kind("attr") & c("is_field_read") & (c("read_from_get_doc") | (c("shape") == "self"))).select(
            *_LOCATION, "cls", "shape", c("attr").alias("fieldname"),
            F.when(c("read_from_get_doc"), c("owner_text")).alias("assigned"),
        )
        classes = document_classes.select("repo", "path", "cls", c("doctype").alias("own_doctype"))
        own = F.when(c("shape") == "self", c("own_doctype"))
        return (
            reads.join(classes, ["repo", "path", "cls"], "left")
            .withColumn("doctype", F.coalesce(own, c("assigned")))
            .where(c("doctype").isNotNull())
            .select(*_LOCATION, "doctype", "fieldname", F.lit("attr").alias("access_kind"),
                    F.when(own.isNotNull(), "medium").otherwise("high").alias("confidence"))
        )
