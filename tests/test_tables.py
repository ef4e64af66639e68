"""Versioned tables, the ledger and the records of scans kept in them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracewright import sinks
from tracewright.operators import records as rc
from tracewright.operators import reports as rp
from tracewright.schemas import LEDGER
from tracewright.tables import StaleVersion, Table, is_table

SCHEMA = "id string, place int, value string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t"), SCHEMA, ["id"], parts=16)


def test_upserts_make_versions(spark, table):
    assert table.version() == 0 and table.read().columns == ["id", "place", "value"] and table.read().isEmpty()
    assert not is_table(spark, table.path)
    assert table.upsert(rows(spark, *((f"k{i}", i, "old") for i in range(100)))) == 1
    first = table.read()
    assert table.upsert(rows(spark, ("k3", 1, "x"), ("k3", 2, "y"), ("new", 1, "z"), (None, 1, "n")), "place") == 2
    got = {r.id: (r.place, r.value) for r in table.read().collect()}
    assert got["k3"] == (2, "y") and got["new"] == (1, "z") and got[None] == (1, "n") and len(got) == 102
    # what was read before stays as it was, by number as well
    assert first.where("id = 'k3'").first().value == "old" and table.read(1).count() == 100
    assert is_table(spark, table.path) and table.versions() == [1, 2]
    assert table.insert_absent(rows(spark, ("k3", 9, "no"), ("k200", 9, "yes"))) == 3
    got = {r.id: r.value for r in table.read().collect()}
    assert got["k3"] == "y" and got["k200"] == "yes"


def test_untouched_parts_keep_their_files(spark, table):
    table.upsert(rows(spark, *((f"k{i}", i, "old") for i in range(200))))
    before = set(table.folders())
    stamps = {f: {n: os.stat(f"{f}/{n}").st_mtime_ns for n in os.listdir(f)} for f in before}
    table.upsert(rows(spark, ("k3", 1, "x"), ("k4", 1, "x")))
    after = set(table.folders())
    assert len(before) == 16 and 14 <= len(before & after) <= 15 and len(after) == 16
    assert all({n: os.stat(f"{f}/{n}").st_mtime_ns for n in os.listdir(f)} == stamps[f] for f in before & after)
    # a lookup reads the parts of its keys only
    found = table.of_keys(spark.createDataFrame([("k3",), ("k3",), ("none",)], "id string"))
    assert content(found) == [("k3", 1, "x")]
    read = {os.path.dirname(f).removeprefix("file://").removeprefix("file:") for f in found.inputFiles()}
    assert 1 <= len(read & after) <= 2


def test_removed_rows_and_empty_parts(spark, table):
    table.upsert(rows(spark, *((f"k{i}", i, "old") for i in range(20))))
    keys = rows(spark, *((f"k{i}", 0, "") for i in range(20)))
    table.merge(keys, lambda old, new: old.join(new.select("id"), ["id"], "left_anti"))
    assert table.read().isEmpty() and table.folders() == [] and table.read(1).count() == 20
    assert table.upsert(rows(spark, ("a", 1, "b"))) == 3 and content(table.read()) == [("a", 1, "b")]
    assert table.replace(rows(spark, ("c", 1, "d"))) == 4 and content(table.read()) == [("c", 1, "d")]
    assert table.upsert(rows(spark)) == 5 and content(table.read()) == [("c", 1, "d")]


def test_the_second_of_two_writers_is_refused(spark, table):
    table.upsert(rows(spark, ("a", 1, "start")))
    base = table.version()
    other = Table(spark, table.path, SCHEMA, ["id"], parts=4)  # keeps the number of parts that the table has
    assert other.upsert(rows(spark, ("a", 2, "other")), base=base) == 2
    with pytest.raises(StaleVersion):
        table.upsert(rows(spark, ("a", 3, "mine")), base=base)
    assert content(table.read()) == [("a", 2, "other")] and table.version() == 2
    # without a version of its own a writer works on the newest
    assert table.upsert(rows(spark, ("a", 3, "mine"))) == 3


def test_a_writer_that_commits_meanwhile(spark, table):
    """Both have read version 1; the change is worked out again, and none is lost."""
    table.upsert(rows(spark, ("n", 0, "")))
    calls = []

    def add_one(old, new):
        calls.append(1)
        if len(calls) == 1:
            Table(spark, table.path, SCHEMA, ["id"]).upsert(rows(spark, ("n", 10, "")))
        return old.select("id", (F.col("place") + 1).alias("place"), "value")

    assert table.merge(rows(spark, ("n", 0, "")), add_one) == 3
    assert content(table.read()) == [("n", 11, "")] and len(calls) == 2


def test_lost_writers(spark, table, tmp_path):
    table.upsert(rows(spark, ("a", 1, "x")))
    (tmp_path / "t" / "versions" / "2.claim").write_text("")  # claimed, never committed
    (tmp_path / "t" / "versions" / "2.tmp").write_text("half")
    assert table.version() == 1 and content(table.read()) == [("a", 1, "x")]
    with pytest.raises(StaleVersion):
        table.upsert(rows(spark, ("a", 2, "y")))
    left = len(os.listdir(tmp_path / "t" / "data"))
    table.release(2)
    (tmp_path / "t" / "versions" / "2.tmp").unlink()
    assert table.upsert(rows(spark, ("a", 2, "y"))) == 2 and left == 1
    table.release(2)  # is complete, stays
    assert content(table.read()) == [("a", 2, "y")]


def test_dealt_rows_are_appended_as_they_are(spark, table):
    some = rows(spark, *((f"k{i}", i, "v") for i in range(400)), (None, 1, "n"))
    for tasks, most in ((5, 4), (16, 1), (40, 1)):  # of 16 parts
        dealt = table.dealt(some, 0, tasks)
        held = dealt.select(F.spark_partition_id().alias("task"), table._part(16).alias("part")).distinct().collect()
        assert tasks <= dealt.rdd.getNumPartitions() <= 3 * 16 and {r.part for r in held} == set(range(16))
        assert max(sum(r.task == task for r in held) for task in {r.task for r in held}) == most
    assert table.append(table.dealt(some, 0, 40), 0, are_dealt=True) == 1 and content(table.read().where("id > ''")) == content(some.where("id > ''"))
    assert table.read().count() == 401 and len(table.folders()) == 16
    # a part of many folders is written anew with what comes
    more = rows(spark, *((f"l{i}", i, "v") for i in range(50)))
    assert table.append(table.dealt(more, 1, 8), 1, most_folders=1, are_dealt=True) == 2
    assert table.read().count() == 451 and len(table.folders()) == 16


def test_vacuum(spark, table):
    for i in range(4):
        table.upsert(rows(spark, (f"k{i}", i, "v")))
    assert table.vacuum(keep=1) == 0  # each version's part is still in use
    table.upsert(rows(spark, ("k0", 9, "w")))
    assert table.vacuum(keep=1) == 1 and table.versions() == [5]
    assert content(table.read()) == [("k0", 9, "w"), ("k1", 1, "v"), ("k2", 2, "v"), ("k3", 3, "v")]


# ---- ledger ----------------------------------------------------------------------------------
def ledger(spark, *ids, status="candidate"):
    kinds = dict(x.strip().split(" ", 1) for x in LEDGER.replace("array<struct<date:string,status:string,proof_tier:int,reproducer_hash:string>>", "HISTORY").split(","))
    made = {"status": status, "rule_id": "FR-X-001", "rule_version": "1.0.0", "repo": "r"}
    full = {n: t.replace("HISTORY", "array<struct<date:string,status:string,proof_tier:int,reproducer_hash:string>>") for n, t in kinds.items()}
    return spark.createDataFrame([(i,) for i in ids], "id string").select(
        *(F.col("id") if n == "id" else F.lit(made.get(n)).cast(t).alias(n) for n, t in full.items()))


def test_ledger_versions(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert sinks.write_ledger(ledger(spark, "a", "b"), path) == 1
    results = spark.createDataFrame([("a", "passed", 2, "h"), ("zz", "passed", 2, "h")], "finding_id string, status string, proof_tier int, reproducer_hash string")
    assert sinks.write_results(spark, path, results, "2026-01-02", base=1) == 2
    # a scan that was derived from version 1 comes too late
    with pytest.raises(StaleVersion):
        sinks.write_ledger(ledger(spark, "c"), path, base=1)
    assert sinks.write_ledger(ledger(spark, "a", "c"), path, base=2) == 3
    got = {r.id: r for r in sinks.read_ledger(spark, path).collect()}
    assert {i: r.status for i, r in got.items()} == {"a": "proven", "b": "candidate", "c": "candidate"}
    assert got["a"].proof_tier == 2 and len(got["a"].status_history) == 1 and got["b"].status_history is None


def test_ledger_folder_problems(spark, tmp_path):
    folder = tmp_path / "ledger"
    folder.mkdir()
    (folder / "good.yaml").write_text("id: A\nstatus: proven\nproof_tier: 2\nstatus_history: [{date: 2026-01-01, proof_tier: x}, 7]\n")
    (folder / "bad.yaml").write_text("a: [1\n")
    (folder / "list.yaml").write_text("- 1\n")
    (folder / "bytes.yaml").write_bytes(b"\xff\xfe\x00\x80")
    (folder / "empty.yaml").write_text("")
    (folder / "gone.yaml").symlink_to(tmp_path / "nowhere")
    assert [(r.id, r.proof_tier, r.status_history[0].proof_tier) for r in sinks.read_ledger(spark, str(folder)).collect()] == [("A", 2, None)]
    problems = {os.path.basename(r.source): r.problem for r in sinks.ledger_problems(spark, str(folder)).collect()}
    assert problems.keys() == {"bad.yaml", "list.yaml", "bytes.yaml", "empty.yaml"}
    assert problems["list.yaml"] == problems["empty.yaml"] == "no mapping" and problems["bad.yaml"].startswith("no YAML")


# ---- records -----------------------------------------------------------------------------------
def test_records_of_scans(spark, tmp_path):
    store = rc.open_records(spark, str(tmp_path / "records"), parts=4)
    scans = spark.createDataFrame([("s1", "/a", 1.0), ("s2", "/b", 2.0)], "scan_id string, repo_path string, started_at double")
    rc.start_scans(store, scans)
    assert rp.latest_scan(store.scans.read()).first().scan_id == "s2"
    found = spark.createDataFrame([("f1", "R", "a.py", 3), ("f2", "R", "b.py", 4)], "id string, rule_id string, file string, line int").withColumn(
        "severity", F.struct(F.lit(12.5).alias("score"), F.struct(F.lit(True).alias("guest")).alias("dims")))
    rc.record_findings(store, rc.finding_rows(found, "s1", 10.0))
    rc.finish_scans(store, spark.createDataFrame([("s1", 5.0, "done"), ("s9", 6.0, "done")], "scan_id string, finished_at double, status string"))
    assert rp.latest_scan(store.scans.read()).first().scan_id == "s1"
    row = store.findings.read().where("finding_id = 'f1'").first()
    assert (row.scan_id, row.status, row.severity_score, row.created_at) == ("s1", "candidate", 12.5, 10.0)
    assert json.loads(row.severity_json) == {"score": 12.5, "dims": {"guest": True}}
    proofs = spark.createDataFrame([("f1", "FAILED", 2, 1.0), ("f1", "PASSED", 2, 2.0), ("f7", "PASSED", 2, 2.0)],
                                   "finding_id string, proof_status string, proof_tier int, proved_at double")
    for f in store.proofs.schema:
        if f.name not in proofs.columns:
            proofs = proofs.withColumn(f.name, F.lit(None).cast(f.dataType))
    rc.record_proofs(store, proofs)
    assert {r.finding_id: (r.status, r.proof_status, r.proof_tier) for r in store.findings.read().collect()} == {
        "f1": ("proven", "PASSED", 2), "f2": ("candidate", None, None)}
    assert store.proofs.read().count() == 2
    # a later scan reports f2 again: it belongs to that one
    rc.record_findings(store, rc.finding_rows(found.where("id = 'f2'"), "s2", 11.0))
    listed = {r.scan_id: r for r in rp.scan_list(store.scans.read(), store.findings.read()).collect()}
    assert (listed["s1"].finding_count, listed["s1"].proven_count, listed["s2"].finding_count) == (1, 1, 1)
