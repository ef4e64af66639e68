import pytest
from cases import CASES, ORDER
from pyspark.sql import functions as F

from tracewright.operators.findings import by_severity
from tracewright.plans import detectors
from tracewright.plans.scan import ScanInput, build_index, findings
from tracewright.sources.files import from_table

ALL_RULES = [d.rule_id for d in detectors.DETECTORS]


@pytest.fixture(scope="module")
def index(packed):
    return build_index(ScanInput.of_files(from_table(packed({name: files for name, (files, _, _) in CASES.items()}))))


@pytest.fixture(scope="module")
def counts(index):
    rows = findings(index, rules=ALL_RULES).groupBy("repo", "rule_id").count().collect()
    return {(r.repo, r.rule_id): r["count"] for r in rows}


@pytest.mark.parametrize("name", list(CASES))
def test_case(name, counts):
    _, expect, absent = CASES[name]
    found = {rule: counts.get((name, rule), 0) for rule in [*expect, *absent]}
    assert found == {**expect, **{rule: 0 for rule in absent}}


def test_every_detector_has_positive_and_negative_case():
    positive = {rule for _, expect, _ in CASES.values() for rule in expect}
    assert positive == set(ALL_RULES)


def test_default_scan_leaves_disabled_rules_out(index):
    rules = {r.rule_id for r in findings(index).select("rule_id").distinct().collect()}
    assert not rules & {"FR-INJ-005", "FR-WKFL-004"}
    assert rules == {d.rule_id for d in detectors.DETECTORS if d.enabled}


def test_result_does_not_depend_on_partitioning(packed):
    files = packed({name: files for name, (files, _, _) in list(CASES.items())[::3]})
    shapes = []
    for table in (files.coalesce(1), files.orderBy(F.col("path").desc()).repartition(5)):
        found = findings(build_index(ScanInput.of_files(from_table(table)))).drop("emit_ord")
        shapes.append(sorted(map(str, found.collect())))
    assert shapes[0] == shapes[1] and shapes[0]


def test_order_is_by_score_then_location(index):
    rows = findings(index).orderBy(*by_severity()).select("severity.score", "rule_id", "file", "line", "function").collect()
    keys = [(-r.score, r.rule_id, r.file, r.line, r.function) for r in rows]
    assert keys == sorted(keys)


def test_parse_errors_are_reported(index):
    errors = {(r.path, r.message) for r in index.facts.parse_errors.where("repo = 'broken_file'").collect()}
    assert {p for p, _ in errors} == {"shop/bad.py", "shop/bytes.py"}
    assert any("invalid syntax" in m or "expected" in m for _, m in errors)


def test_own_rule(index):
    @detectors.rule("MY-001")
    def named_f(ix):
        return ix.facts.functions.where("name = 'g'").select(
            "repo", F.col("path").alias("file"), F.col("line_start").alias("line"), F.col("func").alias("function"),
            F.col("hash").alias("code_location_hash"), F.lit("a function called g").alias("evidence"))
    try:
        rows = findings(index, rules=["MY-001"]).where("repo = 'nested_function'").collect()
    finally:
        detectors.unregister("MY-001")
    assert [(r.function, r.severity.score) for r in rows] == [("f.g", 22.0)]


def test_failing_view_is_skipped_when_logged(index):
    broken = detectors.Index(index.facts, index.symbols, index.doctypes.drop("is_submittable"), index.handlers,
                             index.permission_hooks, index.document_classes)
    failed = []
    rows = detectors.candidates(broken, log=lambda view, problem: failed.append(view)).select("rule_id").distinct().collect()
    assert "calls" in failed and any(r.rule_id == "FR-HOOK-006" for r in rows)


def test_application_order_of_hooks(packed):
    files = packed({"r": {"a/hooks.py": 'doc_events = {"N": {"e": "a.x"}}\n', "b/hooks.py": 'doc_events = {"N": {"e": "b.x"}}\n'}})
    for order, first in ((None, "a"), (["b"], "b")):
        ix = build_index(ScanInput.of_files(from_table(files)), app_order=order)
        assert [r.app for r in ix.handlers.orderBy("ord").collect()][0] == first


def test_strict_schema_fails(packed):
    files = packed({"r": {"a/x/x.json": "{not json", "a/y/y.json": ORDER}})
    assert build_index(ScanInput.of_files(from_table(files))).doctypes.count() == 1
    with pytest.raises(Exception, match="parse_error"):
        build_index(ScanInput.of_files(from_table(files)), strict_schema=True)
