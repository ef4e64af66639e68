"""Sources, sinks, fixes, configuration, command line, streaming, registered queries."""

import json
import os
import subprocess

import pytest
from cases import ENDPOINT, HEAD, NOTE, ORDER
from pyspark.sql import functions as F

import tracewright
from tracewright import __main__ as cli
from tracewright import config, sinks
from tracewright.operators import fixes
from tracewright.operators.ledger import ledger_rows
from tracewright.operators.records import open_records
from tracewright.plans.detectors import candidates
from tracewright.plans.scan import ScanInput, build_index, call_graph
from tracewright.sources import doctypes as dt
from tracewright.sources import files as src
from tracewright.sources import hooks as hk
from tracewright.streaming.incremental import latest_findings, scan_stream

APP = {
    "shop/__init__.py": "def f(a=[]):\n    pass\n",
    "shop/api.py": HEAD + ENDPOINT + 'def act(q):\n    """Doc."""\n    return q\n',
    "shop/x.py": HEAD + 'class A:\n\tdef on_submit(self):\n\t\tfrappe.enqueue("a.b")\n\t\ttry:\n\t\t\tpass\n\t\texcept:\n\t\t\tpass\n',
    "shop/sales_order/sales_order.json": ORDER,
    "shop/other/different.json": ORDER,
    "shop/tests/note/note.json": NOTE,
    "shop/node_modules/y.py": "def f(a=[]):\n    pass\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("app")
    for path, text in APP.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def found(spark, folder):
    from tracewright.session import materialise

    return materialise(tracewright.scan(spark, folder), "test-findings")


def paths(df):
    return sorted(r.path for r in df.collect())


# ---- sources --------------------------------------------------------------------------------
def test_listing_reports_what_it_cannot_list(spark, tmp_path, monkeypatch):
    """A dangling link and an unreadable folder are rows, at the top and deep below."""
    for deep in ("", "a/b/c/d/"):
        (tmp_path / deep).mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{deep}ok.py").write_text("x = 1\n")
        (tmp_path / f"{deep}gone.py").symlink_to(tmp_path / "nowhere.py")
        (tmp_path / f"{deep}linked").symlink_to(tmp_path)
        (tmp_path / f"{deep}locked").mkdir()
        (tmp_path / f"{deep}locked/x.py").write_text("y = 1\n")
    real = os.scandir

    def scandir(path):
        if str(path).endswith("locked"):
            raise PermissionError(13, "Permission denied")
        return real(path)

    found = [(os.path.relpath(p, tmp_path), problem) for p, problem in walk_with(scandir, monkeypatch, str(tmp_path))]
    want = [(f"{d}{n}", p) for d in ("", "a/b/c/d/") for n, p in (
        ("ok.py", None), ("gone.py", "link leads nowhere"), ("locked", "folder cannot be listed: Permission denied"))]
    assert sorted(found) == sorted(want)
    entries = src.list_entries(spark, {"r": str(tmp_path)}).collect()
    assert sorted(r.path for r in entries if r.problem) == ["a/b/c/d/gone.py", "gone.py"]
    assert paths(src.list_files(spark, {"r": str(tmp_path)}, "*.py")) == sorted(f"{d}{n}" for d in ("", "a/b/c/d/") for n in ("ok.py", "locked/x.py"))
    errors = build_index(ScanInput.of_folders(spark, {"r": str(tmp_path)})).facts.parse_errors.collect()
    assert sorted(r.path for r in errors) == ["a/b/c/d/gone.py", "gone.py"]


def walk_with(scandir, monkeypatch, root):
    monkeypatch.setattr(os, "scandir", scandir)
    try:
        return list(src._walk(root, ()))
    finally:
        monkeypatch.undo()


def test_discovery(spark, folder):
    names = src.list_files(spark, {"r": folder})
    assert paths(src.python_files(names)) == ["shop/__init__.py", "shop/api.py", "shop/x.py"]
    assert paths(src.doctype_files(names)) == ["shop/sales_order/sales_order.json"]
    assert src.read_contents(names.where("path = 'shop/__init__.py'")).first().content == APP["shop/__init__.py"].encode()


def test_packed_table_gives_the_same_findings(spark, folder, found, tmp_path):
    src.pack(src.from_folders(spark, {"local": folder}), str(tmp_path / "packed"))
    again = tracewright.scan_table(spark.read.parquet(str(tmp_path / "packed")))
    key = lambda df: sorted((r.id, r.line) for r in df.collect())
    assert key(again) == key(found) and key(found)


@pytest.mark.parametrize("text, name, flags", [
    ('{"doctype": "DocType", "name": "A", "module": "M", "is_submittable": "0", "istable": 0}', "A", (True, False, False)),
    ('{"doctype": "DocType", "name": "A", "module": "M", "is_submittable": [], "istable": [0], "is_amendable": null}', "A", (False, True, False)),
    ('{"doctype": "DocType", "name": "A", "module": "M", "is_submittable": true, "istable": "", "is_amendable": 0.5}', "A", (True, False, True)),
    ('{"doctype": "DocType", "module": "M"}', "DocType", (False, False, False)),
    ('{"doctype": "DocType", "name": "A"}', None, None), ('{"doctype": "Page", "name": "A", "module": "M"}', None, None),
    ("[1]", None, None), ("{", None, None), ('{"doctype": "DocType", "name": 5, "module": "M"}', None, None)])
def test_schema_documents(spark, text, name, flags):
    files = spark.createDataFrame([("r", "a/a.json", "/a/a.json", bytearray(text.encode()))], "repo string, path string, abs_path string, content binary")
    rows = dt.doctypes(files).collect()
    assert [(r.name, (r.is_submittable, r.istable, r.is_amendable)) for r in rows] == ([(name, flags)] if name else [])


def test_schema_details(spark):
    body = {"doctype": "DocType", "name": "A", "module": "M", "autoname": 5,
            "fields": [{"fieldname": "x", "fieldtype": "Table", "options": "C"}, {"fieldname": 1, "fieldtype": "Data"}, 7,
                       {"fieldname": "y", "fieldtype": "Table", "options": "B"}, {"fieldname": "z", "fieldtype": "Table", "options": 3}],
            "permissions": [{"role": "R", "permlevel": "2", "read": 1, "if_owner": "x"}, {"role": None}]}
    row = lambda path, b: ("r", path, "/" + path, bytearray(json.dumps(b).encode()))
    files = spark.createDataFrame([row("b/b.json", {**body, "module": "late"}), row("a/a.json", body)], "repo string, path string, abs_path string, content binary")
    types = dt.doctypes(files)
    first = types.first()
    assert types.count() == 1 and first.module == "M" and first.autoname is None and first.table_name == "tabA"
    assert [(f.fieldname, f.options) for f in first.fields] == [("x", "C"), ("y", "B"), ("z", None)]
    assert [(p.role, p.permlevel, p.read, p.write, p.if_owner) for p in first.permissions] == [("R", 2, True, False, True)] and first.owner_scoped
    assert dt.child_tables(types).first().children == ["C", "B"]


def test_hook_files(spark):
    one = 'doc_events = {"A": {"e": ["m.x", 1, "m.y"], 2: "no"}, "B": "no"}\nhas_permission = {"A": "one"}\nbroken = call()\nhas_permission_x: dict = {}\n'
    two = 'has_permission = {"A": "two", "B": ["no"]}\ndoc_events = {"A": {"e": "n.x"}}\n'
    files = spark.createDataFrame([("r", "one/hooks.py", "/s/one/hooks.py", bytearray(one.encode())), ("r", "two/hooks.py", "/s/two/hooks.py", bytearray(two.encode())),
                                   ("r", "bad/hooks.py", "/s/bad/hooks.py", bytearray(b"def (")), ("r", "hooks.py", "/s/hooks.py", bytearray(two.encode()))],
                                  "repo string, path string, abs_path string, content binary")
    leaves = hk.hook_leaves(files)
    handlers = [(r.app, r.handler) for r in hk.handlers_for(hk.hook_handlers(leaves), "A", "e").orderBy("ord").collect()]
    assert handlers == [("s", "n.x"), ("one", "m.x"), ("one", "m.y"), ("two", "n.x")]
    assert [(r.section, r.handler) for r in hk.permission_hooks_for(hk.permission_hooks(leaves), "A").collect()] == [("has_permission", "two")]
    assert hk.permission_hooks_for(hk.permission_hooks(leaves), "B").count() == 0
    assert sorted(r.unresolved for r in hk.unresolved_hooks(leaves).collect()) == ["/s/bad/hooks.py:parse_error", "/s/one/hooks.py:broken"]


def test_graph_edges(packed):
    files = packed({"r": {
        "shop/hooks.py": 'doc_events = {"A": {"e": "shop.lib.go"}}\n',
        "shop/lib.py": "def go():\n    pass\n\ndef same():\n    pass\n\nclass A:\n    def same(self):\n        pass\n",
        "shop/api.py": HEAD + 'from shop.lib import go\ndef f():\n    go()\n    same()\n    missing()\n    frappe.enqueue("A.same")\n    frappe.call("shop.lib.go")\n    x()[0]()\n    get().same()\n'}})
    graph = call_graph(build_index(ScanInput.of_files(src.from_table(files))), with_hooks=True)
    edges = {(r.src.split(":")[-1], r.dst.split(":")[-1], r.kind, r.confidence) for r in graph.edges.collect()}
    assert edges == {("f", "go", "direct_call", 1.0), ("f", "A.same", "string_dispatch", 0.9), ("f", "go", "string_dispatch", 0.9),
                     ("f", "*same", "dynamic_method", 0.4), ("__framework_hook_root__", "go", "hook_dispatch", 0.85)}
    assert {r.member.split(":")[-1] for r in graph.members.where("hub = '*same'").collect()} == {"same", "A.same"}
    lost = {r.call.split(":", 1)[1] for r in graph.unresolved.collect()}
    assert {"f:5:same", "f:6:missing", "f:9:dynamic_call", "f:9:x", "f:10:get"} <= lost


# ---- sinks --------------------------------------------------------------------------------------
def test_sarif_is_one_document(found, tmp_path):
    sinks.write_sarif(found, str(tmp_path / "sarif"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "sarif").glob("part-*")))
    run = json.loads(text)["runs"][0]
    assert len(run["results"]) == found.count() > 3
    keys = [(r["ruleId"], r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]) for r in run["results"]]
    assert keys == sorted(keys) and {r["id"] for r in run["tool"]["driver"]["rules"]} == {k for k, _ in keys}


def test_baseline_round_trip(spark, found, tmp_path):
    sinks.write_baseline(found, str(tmp_path / "base"))
    known = sinks.read_baseline(spark, str(tmp_path / "base"))
    from tracewright.operators.findings import drop_known
    assert drop_known(found, known).count() == 0
    document = tmp_path / "one.json"
    document.write_text(json.dumps({"version": 1, "fingerprints": [r.fingerprint for r in known.collect()]}, indent=2))
    assert sinks.read_baseline(spark, str(document)).count() == known.count()
    document.write_text("{broken")
    assert sinks.read_baseline(spark, str(document)).count() == sinks.read_baseline(spark, str(tmp_path / "none")).count() == 0


def test_payload_is_one_document(spark, found, tmp_path):
    groups = {"candidates": found, "proven": found.limit(0), "again": found.where("rule_id = 'FR-PERM-001'")}
    sinks.write_payload(groups, str(tmp_path / "payload"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "payload").glob("part-*")))
    document = json.loads(text)
    assert list(document) == list(groups) and document["proven"] == []
    assert sorted(x["id"] for x in document["candidates"]) == sorted(r.id for r in found.collect())


def test_tables_and_ledger_folder(spark, found, tmp_path):
    sinks.write_json(found, str(tmp_path / "json"), by_repo=True)
    assert spark.read.json(str(tmp_path / "json")).count() == found.count() and (tmp_path / "json" / "repo=local").is_dir()
    sinks.write_csv(found, str(tmp_path / "csv"))
    assert len(spark.read.option("header", True).csv(str(tmp_path / "csv")).columns) == 7
    rows = ledger_rows(found, "2026-01-01")
    target = str(tmp_path / "findings")
    sinks.write_ledger_folder(rows, target)
    sinks.write_ledger_folder(rows.withColumn("status", F.lit("proven")), target)
    (tmp_path / "findings" / "odd.yaml").write_text("- a list\n")
    (tmp_path / "findings_latest_1").mkdir()
    (tmp_path / "findings_latest_1" / "x.yaml").write_text("id: X-1\nstatus: merged\nproof_tier: 2\nstatus_history: [{date: 2026-01-01, status: proven, proof_tier: 2}]\n")
    back = sinks.read_ledger_folder(spark, target)
    assert {r.status for r in back.collect()} == {"candidate", "merged"} and back.count() == rows.count() + 1
    assert cli.main(["report", target]) == 0 and cli.main(["fp-report", target]) == 0


def whole(target):
    """The document that part files make when read in the order of their names."""
    return json.loads("\n".join(p.read_text() for p in sorted(target.glob("part-*"))))


# ---- fixes -------------------------------------------------------------------------------------------
def test_fix_previews_and_rechecks(spark, folder, found):
    names = src.python_files(src.list_files(spark, {"local": folder}))
    patches = {r.rule_id: r for r in fixes.fix_previews(found, names).collect()}
    assert set(patches) == {"FR-PERM-001", "FR-HOOK-001", "FR-HOOK-004", "FR-HOOK-006"}
    assert all(p.is_valid for p in patches.values())
    assert "+    frappe.only_for('System Manager')\n" in patches["FR-PERM-001"].diff and patches["FR-PERM-001"].start_line == 5
    assert "+\t\texcept Exception:\n" in patches["FR-HOOK-006"].diff
    assert "deduplicate=True)" in patches["FR-HOOK-004"].modified_source
    files = src.from_folders(spark, {"local": folder})
    whole = {r.file: r for r in fixes.fixed_files(found, files).collect()}
    assert whole["shop/x.py"].n_edits == 3 and whole["shop/x.py"].is_valid
    fixed = files.join(spark.createDataFrame([(r.file, r.fixed) for r in whole.values()], "path string, fixed string"), ["path"], "left").select(
        "repo", "path", "abs_path", F.coalesce(F.encode("fixed", "UTF-8"), "content").alias("content"))
    rules = {r.id: r.rule_id for r in found.collect()}

    def state(rule, sources):
        again = candidates(build_index(ScanInput.of_files(sources)), rules=list(fixes.RECHECKED))
        return {r.status for r in fixes.recheck(found, again).collect() if rules[r.finding_id] == rule}
    assert state("FR-HOOK-001", files) == state("FR-HOOK-004", files) == state("FR-HOOK-006", files) == {"passed"}
    assert state("FR-HOOK-001", fixed) == state("FR-HOOK-004", fixed) == {"failed"}
    assert state("FR-PERM-001", files) == {"skipped"}


@pytest.mark.parametrize("rule, line, before, after", [
    ("FR-HOOK-004", 1, "frappe.enqueue('m.f')  # later (soon)\n", "frappe.enqueue('m.f', deduplicate=True)  # later (soon)\n"),
    ("FR-HOOK-004", 2, "x = frappe.enqueue(\n    'é',  # one)\n    queue='long'\n)\n", "x = frappe.enqueue(\n    'é',  # one)\n    queue='long', deduplicate=True\n)\n"),
    ("FR-HOOK-004", 1, "frappe.enqueue('m.f', (1),)\r\n", "frappe.enqueue('m.f', (1), deduplicate=True)\r\n"),
    ("FR-HOOK-004", 1, "é = enqueue(); frappe.enqueue('a', job_id=1)\n", "é = enqueue(deduplicate=True); frappe.enqueue('a', job_id=1)\n"),
    ("FR-HOOK-004", 1, "frappe.enqueue('a', job_id=1)\n", None),
    ("FR-HOOK-006", 3, "try:\n    f()\nexcept : # any\n    pass\n", "try:\n    f()\nexcept Exception : # any\n    pass\n"),
    ("FR-HOOK-006", 3, "try:\n    f()\nexcept Exception:\n    pass\n", None),
    ("FR-PERM-001", 3, "class A:\n    def f(self): pass\n@w\ndef f():\n    'text'\n    pass\n", "class A:\n    def f(self): pass\n@w\ndef f():\n    'text'\n    frappe.only_for('System Manager')\n    pass\n"),
    ("FR-PERM-001", 1, "def f():\n    'text'", "def f():\n    'text'\n    frappe.only_for('System Manager')"),
    ("FR-PERM-001", 1, "def f(): pass\n", None), ("FR-PERM-001", 9, "def f(): pass\n", None), ("FR-PERM-001", 1, "def f(:\n", None),
    ("FR-HOOK-001", 4, "class A:\n  def on_cancel(self): pass\nclass B:\n  def on_submit(self):\n    pass\nx = 1\n",
     "class A:\n  def on_cancel(self): pass\nclass B:\n  def on_submit(self):\n    pass\n\n  def on_cancel(self):\n      # undo what on_submit does\n      pass\nx = 1\n")])
def test_edits(rule, line, before, after):
    from tracewright.sources import source_edits as edits

    text = edits.read(before)
    edit, = edits.edits_of(text, [(rule, line)]) if text else [None]
    assert (edit and edits.apply_edits(before, [edit])) == after
    assert after is None or edits.is_sound(text, after)
    if edit:
        assert patched(before, edits.insertion_diff("x.py", text, edit)) == after


def patched(before, diff):
    """The text after a diff of one hunk, read by its numbers."""
    import re

    head = re.search(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@\n", diff)
    start, n_old, n_new = int(head[1]), int(head[2] or 1), int(head[4] or 1)
    hunk = re.split(r"(?<=\n)(?=[ +-])", diff[head.end():].replace("\n\\ No newline at end of file\n", "\0\n"))
    hunk = [x.replace("\0\n", "") for x in hunk]
    old, new = [x[1:] for x in hunk if x[0] != "+"], [x[1:] for x in hunk if x[0] != "-"]
    lines = before.splitlines(keepends=True)
    at = start - (n_old > 0)
    assert lines[at:at + n_old] == old and (len(old), len(new)) == (n_old, n_new)
    return "".join(lines[:at] + new + lines[at + n_old:])


def test_diffs_of_insertions_anywhere():
    import random

    from tracewright.sources import source_edits as edits

    rng = random.Random(3)
    for _ in range(500):
        before = "".join(rng.choice(["a = 1\n", "b = 2\n", "\n", "é = 3\n"]) for _ in range(rng.randrange(9))) + rng.choice(["", "z = 9"])
        edit = edits.Edit(rng.randrange(len(before) + 1), rng.choice(["x", "x\n", "\nx", "a = 1\n", "\n", "p\nq\n", "\n\nb = 2"]), "")
        after = edits.apply_edits(before, [edit])
        text = edits.Source("")
        text.source = before
        diff = edits.insertion_diff("x.py", text, edit)
        assert patched(before, diff) == after, (before, edit)


def test_a_comment_is_no_fix():
    from tracewright.sources import source_edits as edits

    text = edits.Source("def f():\n    return 1\n")
    assert not edits.is_sound(text, "# more\ndef f():\n    # even more\n    return 1\n")
    assert edits.is_sound(text, "def f():\n    return 2\n") and not edits.is_sound(text, "def f(:\n")


def test_one_bad_file_does_not_end_the_job(spark, packed):
    deep = "x = " + "+".join(["1"] * 50_000) + "\n"
    files = packed({"r": {"a.py": "def f(a=[]):\n    pass\n", "b.py": b"\xff\xfe", "hooks.py": "doc_events = " + "a." * 20_000 + "b\n", "d.py": deep}})
    given = src.from_table(files).withColumn("content", F.when(F.col("path") != "d.py", F.col("content")))
    index = build_index(ScanInput.of_files(given))
    assert {r.file for r in candidates(index).collect()} >= {"a.py"}
    assert {r.path for r in index.facts.parse_errors.select("path").collect()} == {"b.py", "d.py", "hooks.py"}
    some = spark.createDataFrame([("r", "b.py", "i", "FR-HOOK-006", 1)], "repo string, file string, id string, rule_id string, line int")
    assert fixes.fix_previews(some, src.from_table(files)).collect() == []


# ---- configuration -------------------------------------------------------------------------------------
def test_configuration(spark, tmp_path):
    path = tmp_path / "scan.yaml"
    path.write_text("repos:\n  - {id: a, path: /x}\n  - {id: b, path: /y, enabled: false}\ntimeout_seconds: '7'\n")
    loaded = config.load_scan_config(str(path))
    assert loaded.folders() == {"a": "/x"} and loaded.timeout_seconds == 7 and loaded.output_format == "yaml"
    for bad in ("repos: [{path: /x}]", "repos: [{id: a, path: /x}, {id: a, path: /y}]", "[1]"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            config.load_scan_config(str(path))
    (tmp_path / config.IGNORE_FILE).write_text("# note\n\ngen/*\n")
    assert config.load_project_settings(str(tmp_path)).exclude_paths == ["gen/*"]
    (tmp_path / config.SETTINGS_FILE).write_text('[tool.tracewright]\nexclude = ["x"]\nbaseline = "b.json"\nfail_on = "high"\n')
    settings = config.load_project_settings(str(tmp_path))
    assert (settings.exclude_paths, settings.fail_on, settings.baseline_path) == (["x"], "high", str(tmp_path / "b.json"))
    (tmp_path / config.SETTINGS_FILE).write_text("= broken")
    assert config.load_project_settings(str(tmp_path)).exclude_paths == []


def test_false_positive_log(spark, folder, found, tmp_path):
    row = found.where("rule_id = 'FR-PERM-001'").first()
    entry = {"finding_id": "x1", "reason": "public", **{k: row[k] for k in config.FP_FIELDS[1:-1]}}
    log = tmp_path / "fp.yaml"
    log.write_text("false_positives:\n- " + "\n  ".join(f"{k}: '{v}'" for k, v in entry.items()) + "\n")
    kept = tracewright.scan(spark, folder, fp_log=str(log))
    assert kept.count() == found.count() - 1 and kept.where("rule_id = 'FR-PERM-001'").count() == 0
    log.write_text("false_positives:\n- {finding_id: a, rule_id: ''}\n")
    with pytest.raises(ValueError, match="rule_id"):
        config.load_false_positives(spark, str(log))


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main(["scan", str(tmp_path / "nowhere")]) == 2
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.py").write_text("a = 1\n")
    assert cli.main(["scan", str(tmp_path / "empty")]) == 0
    assert cli.main(["scan", folder, "--rule", "FR-HOOK-007", "--output", str(tmp_path / "out")]) == 1
    assert "shop/__init__.py:1 f" in capsys.readouterr().out
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    book, more = str(tmp_path / "book"), ["--rule", "FR-HOOK-007"]
    assert cli.main(["scan", folder, *more, "--ledger", book, "--records", str(tmp_path / "records")]) == 1
    assert cli.main(["scan", folder, *more, "--modules", str(tmp_path / "modules"), "--ledger", book, "--ledger-version", "0"]) == 2  # someone has written since
    assert cli.main(["scan", folder, *more, "--ledger", book, "--ledger-version", "1", "--ledger-files", str(tmp_path / "files")]) == 1
    assert cli.main(["report", book]) == 0 and cli.main(["fp-report", book]) == 0 and len(list((tmp_path / "files").iterdir())) == 1
    store = open_records(spark, str(tmp_path / "records"))
    assert store.scans.read().first().status == "done" and store.findings.read().count() == 1
    assert cli.main(["scan", folder, *more, "--format", "payload", "--output", str(tmp_path / "one")]) == 1
    assert list(whole(tmp_path / "one")) == ["candidates"]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "y.py").write_text("def g(a=[]):\n    pass\ndef h(a={}):\n    pass\n")
    assert cli.main(["scan", folder, str(tmp_path / "other"), str(tmp_path / "empty"), *more, "--format", "payload", "--output", str(tmp_path / "all")]) == 1
    results = whole(tmp_path / "all")["results"]
    assert {k: len(v) for k, v in results.items()} == {os.path.basename(folder): 1, "other": 2, "empty": 0}
    assert cli.main(["fix", folder, "--rule", "FR-PERM-001", "--output", str(tmp_path / "patches")]) == 0
    assert spark.read.json(str(tmp_path / "patches")).count() == 1


def test_changed_files_of_a_repository(spark, folder, tmp_path):
    assert config.changed_files(spark, folder, "no-such-ref") is None
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", ".")
    git("commit", "-m", "first")
    (tmp_path / "a.py").write_text("x = 2\n")
    assert [r.path for r in config.changed_files(spark, str(tmp_path), "HEAD").collect()] == ["a.py"]


# ---- streaming -----------------------------------------------------------------------------------------------
def test_stream(spark, packed, tmp_path):
    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")
    packed({"r": {"a.py": "def f(a=[]):\n    pass\n"}}).coalesce(1).write.parquet(incoming)
    run = lambda: scan_stream(spark, incoming, out, str(tmp_path / "state")).awaitTermination(300)
    assert run()
    assert [r.file for r in latest_findings(spark, out).collect()] == ["a.py"]
    packed({"r": {"a.py": "def f(a=[]):\n    pass\n", "b.py": "def g(a={}):\n    pass\n"}}).coalesce(1).write.mode("append").parquet(incoming)
    assert run()
    assert sorted(r.file for r in latest_findings(spark, out).collect()) == ["a.py", "b.py"]
    # a file that is fixed in a later batch has no finding left
    packed({"r": {"a.py": "def f(a=None):\n    pass\n"}}).coalesce(1).write.mode("append").parquet(incoming)
    assert run()
    assert [r.file for r in latest_findings(spark, out).collect()] == ["b.py"]


def test_stream_knows_the_files_of_earlier_batches(spark, packed, tmp_path):
    """A guard that a helper loses in batch 2 brings back a finding in a file of batch 1."""
    from tracewright.streaming.incremental import findings_table

    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(repos):
        packed(repos).coalesce(1).write.mode("append").parquet(incoming)
        assert scan_stream(spark, incoming, out, str(tmp_path / "state"), parts=4, rules=["FR-PERM-001"]).awaitTermination(300)
        return {(r.repo, r.file) for r in latest_findings(spark, out).collect()}

    helper = lambda name, body: f"{HEAD}def {name}():\n    {body}\n"
    caller = HEAD + "from shop.h import check\n" + ENDPOINT + "def act(q):\n    check()\n    frappe.get_doc('X', q).save()\n"
    guarded = helper("check", "frappe.only_for('Manager')")
    app = {"shop/h.py": guarded, "shop/api.py": caller}
    assert arrive({"r": app, "other": {"shop/api.py": caller, "shop/h.py": helper("check", "pass")}}) == {("other", "shop/api.py")}
    kept = set(findings_table(spark, f"{out}/findings").folders())
    assert arrive({"r": {"shop/h.py": helper("check", "pass")}}) == {("r", "shop/api.py"), ("other", "shop/api.py")}
    # the other repository was neither scanned nor written again
    assert kept & set(findings_table(spark, f"{out}/findings").folders())
    assert arrive({"r": {"shop/h.py": guarded}}) == {("other", "shop/api.py")}
    # a helper that cannot be read guards nothing
    assert arrive({"r": {"shop/h.py": None}}) == {("r", "shop/api.py"), ("other", "shop/api.py")}


def test_contents_are_parsed_once(spark, packed, tmp_path):
    from tracewright.sources.parsed import ParsedModules

    app = {"a.py": "def f(a=[]):\n    pass\n", "b.py": "def g(a={}):\n    pass\n", "empty.py": "", "bad.py": "def (", "p_report/x.py": "def execute():\n    pass\n"}
    app["copy/a.py"] = app["a.py"]

    def files(repos):
        return src.from_table(packed(repos))

    modules = ParsedModules(spark, str(tmp_path / "modules"), parts=4)
    key = lambda df: sorted((r.repo, r.file, r.line, r.rule_id, r.id) for r in df.collect())
    plain = key(tracewright.plans.scan.scan_files(files({"r": app})))
    assert len(plain) == 3 and key(tracewright.plans.scan.scan_files(files({"r": app}), modules=modules)) == plain
    assert modules.add(files({"r": app})) == 0 and modules.table.version() == 1
    # one file changes, and another repository holds copies
    changed = {**app, "b.py": "def g(a={}, b=[]):\n    pass\n"}
    assert modules.add(files({"r": changed, "s": app})) == 1
    want = key(tracewright.plans.scan.scan_files(files({"r": changed, "s": app})))
    assert key(tracewright.plans.scan.scan_files(files({"r": changed, "s": app}), modules=modules)) == want
    rows = syntax_of(files({"r": app}), None), syntax_of(files({"r": app}), modules)
    assert rows[0] == rows[1] and any(kind == "error" for _, _, kind in {r[:3] for r in rows[0]})
    missing = files({"r": {"gone.py": None, **app}})
    assert syntax_of(missing, modules) == syntax_of(missing, None)


def test_known_contents_are_read_once(spark, packed, tmp_path):
    from tracewright.sources.parsed import ParsedModules, parsed_rows

    app = {f"m{i}.py": f"def f{i}(a=[]):\n    pass\n" for i in range(20)}
    given = src.from_table(packed({"r": app}))
    modules = ParsedModules(spark, str(tmp_path / "modules"), parts=4)
    assert modules.add(given) == 20 and modules.add(given) == 0
    reads = spark.sparkContext.accumulator(0)

    def content_of(content):
        reads.add(1)
        return content

    counted = given.withColumn("content", F.udf(content_of, "binary").asNondeterministic()("content"))
    rows = parsed_rows(counted, modules)
    assert reads.value == 20 and modules.table.version() == 1
    assert rows.where("kind = 'def'").count() == 20


def syntax_of(files, modules):
    from tracewright.sources.parsed import parsed_rows
    from tracewright.sources.python_source import syntax_rows

    rows = syntax_rows(files) if modules is None else parsed_rows(files, modules)
    return sorted(((r.path, r.ord, r.kind, *map(repr, r)) for r in rows.collect()))


# ---- registered queries --------------------------------------------------------------------------------------------
def test_registered_queries_match_sql(spark):
    import __spark_entry__ as entry
    import oracle

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no tables")
    con, sql = oracle.connect(sf_dir), entry.oracle_sql()
    assert set(sql) <= set(entry.queries())
    wrong = {}
    for name, run in entry.queries().items():
        state = oracle.compare(spark, con, name, run, sql.get(name), sf_dir)[2]
        if state not in ("ok", "rows only"):
            wrong[name] = state
    assert not wrong
    assert entry.entry(spark).count() > 0
