"""One small repository per case: files, and the rules that must / must not fire.

``expect`` maps a rule to the number of findings (after removal of duplicates); rules
in ``absent`` must find nothing.
"""

HEAD = "import frappe\n"
ENDPOINT = "@frappe.whitelist()\n"
ORDER = """{"doctype": "DocType", "name": "Sales Order", "module": "Shop", "is_submittable": 1,
 "fields": [{"fieldname": "customer", "fieldtype": "Data"}, {"fieldname": "items", "fieldtype": "Table", "options": "Order Line"}],
 "permissions": [{"role": "Clerk", "read": 1}]}"""
NOTE = """{"doctype": "DocType", "name": "Note", "module": "Shop", "is_submittable": 0, "istable": "0",
 "fields": [{"fieldname": "title", "fieldtype": "Data"}], "permissions": [{"role": "All", "if_owner": 1}]}"""
SCHEMA = {"shop/sales_order/sales_order.json": ORDER, "shop/note/note.json": NOTE}


def api(body, head=HEAD, decorator=ENDPOINT, args="q", name="act"):
    lines = "".join(f"    {line}\n" for line in body.splitlines())
    return f"{head}\n{decorator}def {name}({args}):\n{lines}"


CASES = {}


def case(name, files, expect=(), absent=()):
    files = {"shop/api.py": files} if isinstance(files, str) else files
    CASES[name] = (files, dict(expect), tuple(absent))


# ---- SQL -------------------------------------------------------------------------------
case("sql_format", api('frappe.db.sql("select a from t where b = %s" % q)'), {"FR-SQLI-001": 1})
case("sql_fstring", api('frappe.db.sql(f"select a from t where b = {q}")'), {"FR-SQLI-001": 1})
case("sql_fstring_plain", api('frappe.db.sql(f"select a from t")'), absent=["FR-SQLI-001"])
case("sql_bound", api('frappe.db.sql("select a from t where b = %s", (q,))'), absent=["FR-SQLI-001"])
case("sql_values_keyword", api('frappe.db.sql(q + "x", values={"a": 1})'), absent=["FR-SQLI-001"])
case("sql_not_reachable", api('frappe.db.sql("a %s" % q)', decorator=""), absent=["FR-SQLI-001"])
case("sql_variable", api('text = "select " + q\nfrappe.db.sql(text)'), {"FR-SQLI-001": 1})
case("sql_local_only", api('text = "select " + other\nfrappe.db.sql(text)'), absent=["FR-SQLI-001"])
case("sql_form_dict", api('value = frappe.form_dict.get("x")\nfrappe.db.sql("a" + value)', args=""), {"FR-SQLI-001": 1})
case("sql_request_alias", api('frappe.db.sql("a" + request.args["x"])', head="from frappe import request\nimport frappe\n", args=""),
     {"FR-SQLI-001": 1})
case("sql_grown_literal", api('text = "select a"\ntext += " from b"\nfrappe.db.sql(text)'), absent=["FR-SQLI-001"])
case("sql_cycle", api('a = b\nb = a\nfrappe.db.sql(a + "")'), absent=["FR-SQLI-001"])
case("sql_aliased_module", api('db.sql("a" + q)', head="import frappe\nfrom frappe import db\n"), {"FR-SQLI-001": 1})
case("sql_reassigned_parameter", api('q = "select 1"\nfrappe.db.sql(q)'), absent=["FR-SQLI-001"])
case("raw_submittable", {**SCHEMA, "shop/x.py": HEAD + 'def f():\n    frappe.db.sql("select a from `TABSALES order` where 1")\n'}, {"FR-SQLI-002": 1})
case("raw_docstatus", {**SCHEMA, "shop/x.py": HEAD + 'def f():\n    frappe.db.sql("select a from `tabSales Order` where DocStatus = 1")\n'},
     absent=["FR-SQLI-002"])
case("raw_longer_name", {**SCHEMA, "shop/x.py": HEAD + 'def f():\n    frappe.db.sql("select a from `tabSales Order_Log`, xtabSales Order")\n'},
     absent=["FR-SQLI-002"])
case("raw_in_tests", {**SCHEMA, "shop/tests/x.py": HEAD + 'def f():\n    frappe.db.sql("select a from `tabSales Order`")\n'}, absent=["FR-SQLI-002"])
case("builder_parameter", api("frappe.qb.from_(q)"), {"FR-SQLI-004": 1})
case("builder_doctype", api('t = frappe.qb.DocType("Note")\nfrappe.qb.from_(t)'), absent=["FR-SQLI-004"])
case("builder_doctype_dynamic", api('t = frappe.qb.DocType("tab" + x)\nfrappe.qb.from_(t)'), {"FR-SQLI-004": 2})
case("builder_fstring", api('frappe.qb.from_(f"Note")'), {"FR-SQLI-004": 1})

# ---- permissions --------------------------------------------------------------------------
case("open_reading", api("return q"), {"FR-PERM-001": 1})
case("open_public_name", api("return q", name="get_years"), absent=["FR-PERM-001"])
case("public_name_writing", api("frappe.delete_doc(q)", name="get_years"), {"FR-PERM-001": 1})
case("guard_call", api('frappe.has_permission("Note", throw=True)\nreturn q'), absent=["FR-PERM-001"])
case("guard_method", api("doc.check_permission()\nreturn q"), absent=["FR-PERM-001"])
case("guard_session_user", api("return frappe.session.user"), absent=["FR-PERM-001"])
case("guard_raise", api("if q:\n    raise frappe.PermissionError\nreturn q"), absent=["FR-PERM-001"])
case("guard_throw", api('frappe.throw("no", frappe.PermissionError)'), absent=["FR-PERM-001"])
case("guard_throw_keyword", api('frappe.throw("no", exc=frappe.PermissionError)'), absent=["FR-PERM-001"])
case("guard_throw_other", api('frappe.throw("no", exc=frappe.ValidationError)'), {"FR-PERM-001": 1})
case("guard_decorator", HEAD + "@frappe.whitelist()\n@frappe.validate_and_sanitize_search_inputs\ndef act(q):\n    return q\n", absent=["FR-PERM-001"])
case("guard_developer", api("if frappe.conf.developer_mode:\n    return 1\nreturn q"), absent=["FR-PERM-001"])
case("guard_role_text_only", api('if doc.user != doc.owner and "Manager" in doc.roles:\n    return 1\nreturn q'), {"FR-PERM-001": 1})
case("guard_one_hop", api("check()\nreturn q") + "\ndef check():\n    frappe.only_for('A')\n", absent=["FR-PERM-001"])
case("guard_two_hops", api("first()\nreturn q") + "\ndef first():\n    check()\n\ndef check():\n    frappe.only_for('A')\n", {"FR-PERM-001": 1})
case("guard_attribute_call", api("self.check()\nreturn q") + "\ndef check():\n    frappe.only_for('A')\n", {"FR-PERM-001": 1})
case("guard_dynamic", api("frappe.get_doc('A', q).verify()") + "\nclass A:\n    def verify(self):\n        frappe.only_for('A')\n", absent=["FR-PERM-001"])
case("guard_dispatched", {"shop/api.py": api('frappe.call("shop.lib.check")'), "shop/lib.py": HEAD + "def check():\n    frappe.only_for('A')\n"},
     absent=["FR-PERM-001"])
case("guard_imported", {"shop/api.py": api("check()", head="import frappe\nfrom shop.lib import check\n"),
                        "core/shop/lib.py": HEAD + "def check():\n    frappe.only_for('A')\n"}, absent=["FR-PERM-001"])
case("guard_import_boundary", {"shop/api.py": api("check()", head="import frappe\nfrom shop.lib import check\n"),
                               "core/myshop/lib.py": HEAD + "def check():\n    frappe.only_for('A')\n"}, {"FR-PERM-001": 1})
case("guard_import_twice", {"shop/api.py": api("check()", head="import frappe\nfrom shop.lib import check\n"),
                            "a/shop/lib.py": HEAD + "def check():\n    frappe.only_for('A')\n",
                            "b/shop/lib.py": HEAD + "def check():\n    frappe.only_for('A')\n"}, {"FR-PERM-001": 1})
case("guard_relative_import", {"shop/api.py": api("check()", head="import frappe\nfrom .lib import check\n"),
                               "shop/lib.py": HEAD + "def check():\n    frappe.only_for('A')\n"}, {"FR-PERM-001": 1})
case("guard_package_import", {"shop/api.py": api("check()", head="import frappe\nfrom lib import check\n"),
                              "lib/__init__.py": HEAD + "def check():\n    frappe.only_for('A')\n"}, absent=["FR-PERM-001"])
case("ignored", api("doc.save(ignore_permissions=True)"), {"FR-PERM-002": 1})
case("ignored_false", api("doc.save(ignore_permissions=False)"), absent=["FR-PERM-002"])
case("ignored_read", api('frappe.get_all("Note", ignore_permissions=True)'), absent=["FR-PERM-002"])
case("ignored_insert", api("doc.insert(ignore_permissions=True)"), absent=["FR-PERM-002"])
case("ignored_chained_insert", api('frappe.get_doc("A").insert(ignore_permissions=True)'), {"FR-PERM-002": 1})
case("ignored_guarded", api("frappe.only_for('A')\ndoc.save(ignore_permissions=True)"), absent=["FR-PERM-002"])
case("ignored_two_hops", api("one()") + "\ndef one():\n    two()\n\ndef two():\n    doc.save(ignore_permissions=True)\n", absent=["FR-PERM-002"])
case("owner_scoped", {**SCHEMA, "shop/api.py": api('frappe.db.set_value("Note", q, "title", 1)')}, {"FR-PERM-003": 1, "FR-SQLI-003": 1, "FR-HOOK-003": 1},
     ["FR-WKFL-001"])
case("child_string_flag", {**SCHEMA, "shop/api.py": api('frappe.db.set_value("Note", q, "title", 1)')}, {"FR-PERM-006": 1})
case("report_sql", {"shop/tiny/tiny.json": NOTE.replace('"Note"', '"Tiny"'),
                    "shop/stock_report/x.py": HEAD + 'def execute(filters):\n    frappe.db.sql("select a from tabTiny")\n'}, {"FR-PERM-004": 1})
case("report_sql_hooked", {"shop/tiny/tiny.json": NOTE.replace('"Note"', '"Tiny"'), "shop/hooks.py": 'permission_query_conditions = {"Tiny": "a.b"}\n',
                           "shop/report/x.py": HEAD + 'def execute(filters):\n    frappe.db.sql("select a from tabTiny")\n'}, absent=["FR-PERM-004"])
case("hooked_type_sql", {"shop/tiny/tiny.json": NOTE.replace('"Note"', '"Tiny"'), "shop/hooks.py": 'has_permission = {"Tiny": "a.b"}\n',
                         "shop/api.py": api('frappe.db.sql("select a from tabTiny")')}, {"FR-PERM-005": 1})
case("report_entry_reaches", {"shop/report/x.py": HEAD + "def execute(filters):\n    eval(filters)\n"}, {"FR-INJ-002": 1})

# ---- hooks ----------------------------------------------------------------------------------
case("submit_only", "class A:\n    def on_submit(self):\n        x = 1\n", {"FR-HOOK-001": 1})
case("submit_cancel", "class A:\n    def on_submit(self):\n        x = 1\n    def on_cancel(self):\n        x = 1\n", absent=["FR-HOOK-001"])
case("collision", {"one/hooks.py": 'doc_events = {"Note": {"validate": "one.a", "on_trash": ["one.b", 3]}}\n',
                   "two/hooks.py": 'doc_events = {"Note": {"validate": ["two.a", "two.b"], "on_trash": ("x",)}}\n'}, {"FR-HOOK-002": 1})
case("same_app_twice", {"one/hooks.py": 'doc_events = {"Note": {"validate": ["one.a", "one.b"]}}\n'}, absent=["FR-HOOK-002"])
case("job_without_key", HEAD + 'def f():\n    frappe.enqueue("a.b")\n', {"FR-HOOK-004": 1})
case("job_with_key", HEAD + 'def f():\n    frappe.enqueue("a.b", job_id="x")\n', absent=["FR-HOOK-004"])
case("commit_in_hook", {"shop/hooks.py": 'doc_events = {"Note": {"on_trash": "shop.x.clean"}}\n',
                        "shop/x.py": HEAD + "def clean(doc):\n    frappe.db.commit()\n\ndef other():\n    frappe.db.commit()\n"}, {"FR-HOOK-005": 1})
case("commit_in_method", HEAD + "class A:\n    def validate(self):\n        frappe.db.commit()\n", {"FR-HOOK-005": 1})
case("silent_except", "def f():\n    try:\n        x()\n    except:\n        return\n", {"FR-HOOK-006": 1})
case("loud_except", "def f():\n    try:\n        x()\n    except Exception:\n        log()\n    try:\n        x()\n    except ValueError:\n        pass\n",
     absent=["FR-HOOK-006"])
case("mutable_defaults", "def f(a=[], *, b={}):\n    pass\n\ndef g(c=list()):\n    pass\n\ndef h(d=(), e=list('a')):\n    pass\n", {"FR-HOOK-007": 2})

# ---- workflow ---------------------------------------------------------------------------------
case("write_submittable", {**SCHEMA, "shop/api.py": api('frappe.db.set_value("Sales Order", q, "customer", 1)')}, {"FR-WKFL-001": 1})
case("write_docstatus", {**SCHEMA, "shop/api.py": api('frappe.db.set_value("Sales Order", q, "docstatus", 1)')},
     absent=["FR-WKFL-001", "FR-SQLI-003"])
case("write_dict_form", {**SCHEMA, "shop/api.py": api('frappe.db.set_value("Sales Order", q, {"customer": 1})')}, {"FR-WKFL-001": 1, "FR-SQLI-003": 1})
case("workflow_state", api('frappe.db.set_value("A", q, fieldname="workflow_state", value=1)'), {"FR-WKFL-002": 1})
case("workflow_engine", {"shop/workflow/api.py": api('frappe.db.set_value("A", q, "workflow_state", 1)')}, absent=["FR-WKFL-002"])
case("status_alone", {**SCHEMA, "shop/x.py": HEAD + 'def f():\n    frappe.db.set_value("Sales Order", 1, "status", 2)\n'}, {"FR-WKFL-003": 1})
case("status_plain_type", {**SCHEMA, "shop/x.py": HEAD + 'def f():\n    frappe.db.set_value("Note", 1, "status", 2)\n'}, absent=["FR-WKFL-003"])
case("status_and_docstatus", HEAD + 'def f():\n    frappe.db.set_value("A", 1, "status", 2)\n    frappe.db.set_value("A", 1, "docstatus", 1)\n',
     absent=["FR-WKFL-003"])
case("status_in_patch", {"shop/patches/x.py": HEAD + 'def f():\n    frappe.db.set_value("A", 1, "status", 2)\n'}, absent=["FR-WKFL-003"])

# ---- injection, requests, files ----------------------------------------------------------------
case("mass_assignment", api("frappe.get_doc(q).insert()"), {"FR-INJ-001": 1})
case("mass_spread", api('frappe.get_doc(doctype="A", **data)'), {"FR-INJ-001": 1})
case("mass_parsed", api("frappe.get_doc(json.loads(q))"), {"FR-INJ-001": 1})
case("mass_literal", api('frappe.get_doc({"doctype": "A", "x": q})'), absent=["FR-INJ-001"])
case("mass_attribute", api("frappe.get_doc(frappe.form_dict)", args=""), absent=["FR-INJ-001"])
case("evaluates", api("exec(q)"), {"FR-INJ-002": 1})
case("evaluates_literal", api('eval("1 + 1")'), absent=["FR-INJ-002"])
case("guest_write", api('frappe.db.set_value("A", q, "x", 1)', decorator="@frappe.whitelist(allow_guest=True)\n"), {"FR-CSRF-001": 1})
case("guest_flag_false", api('frappe.db.set_value("A", q, "x", 1)', decorator="@frappe.whitelist(allow_guest=0)\n"), absent=["FR-CSRF-001"])
case("guest_indirect", api("w(q)", decorator="@frappe.whitelist(allow_guest=True)\n") + '\ndef w(q):\n    frappe.db.set_value("A", q, "x", 1)\n',
     absent=["FR-CSRF-001"])
case("url_parameter", api("requests.get(q)", head="import frappe\nimport requests\n"), {"FR-SSRF-001": 1})
case("url_fixed_host", api('requests.get(f"https://host/{q}")\nrequests.post("https://host/%s" % q)\nrequests.put("https://host/{}".format(q))',
                           head="import frappe\nimport requests\n"), absent=["FR-SSRF-001"])
case("url_open_host", api('requests.get(f"https://{q}")', head="import frappe\nimport requests\n"), {"FR-SSRF-001": 1})
case("url_keyword", api("requests.get(url=q)", head="import frappe\nimport requests\n"), absent=["FR-SSRF-001"])
case("path_open", api("open(q)"), {"FR-PATH-001": 1})
case("path_method", api("Path(q).read_text()"), {"FR-PATH-001": 1})
case("path_guarded_later", api("open(q)\nif q.startswith('/x'):\n    return 1"), absent=["FR-PATH-001"])
case("path_three_hops", api("a(q)") + "\ndef a(p):\n    b(p)\n\ndef b(p):\n    c(p)\n\ndef c(p):\n    open(p)\n", {"FR-PATH-001": 1})
case("path_four_hops", api("a(q)") + "\ndef a(p):\n    b(p)\n\ndef b(p):\n    c(p)\n\ndef c(p):\n    d(p)\n\ndef d(p):\n    open(p)\n", absent=["FR-PATH-001"])

# ---- data, performance, texts ----------------------------------------------------------------------
CONTROLLER = "class SalesOrder(Document):\n    def validate(self):\n        {}\n    def helper(self):\n        self.cache = 1\n"
case("field_typo", {**SCHEMA, "shop/x.py": CONTROLLER.format("return self.custmer")}, {"FR-DATA-001": 1})
case("field_known", {**SCHEMA, "shop/x.py": CONTROLLER.format("return self.customer, self.cache, self.helper, self.name, self._x, self.set_status()")},
     absent=["FR-DATA-001"])
case("field_callee_chain", {**SCHEMA, "shop/x.py": CONTROLLER.format("self.lines.append(1)")}, absent=["FR-DATA-001"])
case("field_from_get_doc", {**SCHEMA, "shop/x.py": HEAD + 'def f():\n    d = frappe.get_doc("Note", 1)\n    d.titel = d.title\n'}, {"FR-DATA-001": 1})
case("field_unknown_type", {**SCHEMA, "shop/x.py": HEAD + 'def f():\n    d = frappe.get_doc("Other", 1)\n    return d.titel\n'}, absent=["FR-DATA-001"])
case("class_inherits_seen", {**SCHEMA, "shop/a.py": "class Base:\n    pass\n", "shop/b.py": "class Note(Base):\n    def f(self):\n        return self.titel\n"},
     {"FR-DATA-001": 1})
case("class_inherits_later", {**SCHEMA, "shop/z.py": "class Base:\n    pass\n", "shop/b.py": "class Note(Base):\n    def f(self):\n        return self.titel\n"},
     absent=["FR-DATA-001"])
case("class_qualified_chain", {**SCHEMA, "shop/a.py": "class One(Document):\n    pass\n", "shop/b.py": "class Two(a.One):\n    pass\n",
                               "shop/c.py": "class Note(b.Two):\n    def f(self):\n        return self.titel\n"}, {"FR-DATA-001": 1})
case("class_qualified_plain", {**SCHEMA, "shop/a.py": "class One:\n    pass\n", "shop/c.py": "class Note(a.One):\n    def f(self):\n        return self.titel\n"},
     absent=["FR-DATA-001"])
case("loads_in_loop", HEAD + 'def f():\n    rows = frappe.get_all("A")\n    for r in rows:\n        while True:\n            frappe.get_doc("A", r)\n', {"FR-PERF-001": 1})
case("builds_in_loop", HEAD + 'def f():\n    for r in frappe.get_all("A"):\n        frappe.get_doc({"doctype": "A"})\n        frappe.get_doc(dict(a=1))\n        frappe.get_doc(doctype="A")\n',
     absent=["FR-PERF-001"])
case("loop_over_list", HEAD + 'def f(rows):\n    for r in rows:\n        frappe.get_doc("A", r)\n', absent=["FR-PERF-001"])
case("plain_text", HEAD + 'def f():\n    frappe.msgprint("hello")\n', {"FR-I18N-001": 1})
case("translated_text", HEAD + 'def f():\n    frappe.msgprint(_("hello"))\n', absent=["FR-I18N-001"])

# ---- disabled rules (only on request) ------------------------------------------------------------------
case("markup", api('frappe.throw("<b>" + q)'), {"FR-INJ-005": 1})
case("no_markup", api('frappe.throw("no {}".format(q))\nfrappe.msgprint(_(q))'), absent=["FR-INJ-005"])
case("amend_unhandled", "class A:\n    def on_submit(self):\n        x = 1\n", {"FR-WKFL-004": 1})
case("amend_other_type", {"shop/b/b.json": NOTE.replace('"is_submittable": 0', '"is_amendable": 1'), "shop/x.py": "class A:\n    def on_submit(self):\n        x = 1\n"},
     absent=["FR-WKFL-004"])

# ---- files ------------------------------------------------------------------------------------------------
case("broken_file", {"shop/bad.py": "def f(:\n", "shop/bytes.py": b"x = '\xff'\n", "shop/ok.py": "def f(a=[]):\n    pass\n"}, {"FR-HOOK-007": 1})
case("skipped_folders", {"node_modules/x.py": "def f(a=[]):\n    pass\n", "shop/fixtures/x.py": "def f(a=[]):\n    pass\n", "env.py": "def f(a=[]):\n    pass\n"},
     {"FR-HOOK-007": 1})
case("module_level_if", "if True:\n    def f(a=[]):\n        pass\n", absent=["FR-HOOK-007"])
case("nested_function", "def f():\n    def g(a=[]):\n        pass\n", {"FR-HOOK-007": 1})
case("silenced", "def f(a=[]):  # tracewright:ignore FR-HOOK-007\n    pass\n\ndef g(a=[]):  # tracewright:ignore\n    pass\n\ndef h(a=[]):  # tracewright:ignore FR-HOOK-001\n    pass\n",
     {"FR-HOOK-007": 1})
