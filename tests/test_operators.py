"""Findings, graph, ledger, report and view operators on small hand-made relations."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scoring, text
from tracewright.operators import findings as fd
from tracewright.operators import graph as gr
from tracewright.operators import ledger as lg
from tracewright.operators import mentions as mn
from tracewright.operators import reports as rp
from tracewright.operators import rules as rl
from tracewright.operators import view as vw

CANDIDATE = "repo string, rule_id string, taxonomy_id string, rule_version string, file string, line int, function string, code_location_hash string"


def candidates(spark, *rows):
    full = [(r.get("repo", "r"), r["rule"], r["rule"], r.get("version", "1.0.0"), r.get("file", "a.py"), r.get("line", 1),
             r.get("function", "f"), r.get("hash", "h")) for r in rows]
    return spark.createDataFrame(full, CANDIDATE)


def column(df, name):
    return sorted(r[name] for r in df.collect())


# ---- scoring -----------------------------------------------------------------------------
GOLDEN = [
    ("FR-SQLI-001", 38, 61.5), ("FR-SQLI-004", 38, 61.5), ("FR-SQLI-002", 26, 43.5), ("FR-SQLI-003", 30, 49.5),
    ("FR-PERM-001", 32, 52.5), ("FR-PERM-002", 32, 52.5), ("FR-PERM-003", 32, 52.5), ("FR-PERM-004", 24, 40.5),
    ("FR-PERM-005", 24, 40.5), ("FR-PERM-006", 28, 46.5), ("FR-WKFL-001", 28, 46.5), ("FR-WKFL-002", 32, 52.5),
    ("FR-WKFL-003", 28, 46.5), ("FR-HOOK-001", 28, 46.5), ("FR-HOOK-005", 28, 46.5), ("FR-INJ-001", 36, 58.5),
    ("FR-INJ-002", 40, 64.5), ("FR-CSRF-001", 38, 61.5), ("FR-SSRF-001", 28, 46.5), ("FR-PATH-001", 28, 46.5),
    ("FR-HOOK-006", 7, 7), ("FR-HOOK-007", 5, 5), ("FR-DATA-001", 7, 7), ("FR-PERF-001", 4, 4), ("FR-I18N-001", 2, 2),
]


def test_severity_table(spark):
    df = spark.createDataFrame([(r, g) for r, _, _ in GOLDEN for g in (False, True)], "rule string, guest boolean")
    rows = df.select("rule", "guest", scoring.severity("rule", F.lit("high"), "guest", F.lit(0))["score"].alias("s")).collect()
    assert {(r.rule, r.guest): r.s for r in rows} == {(rule, g): v for rule, plain, guest in GOLDEN for g, v in ((False, plain), (True, guest))}


def test_severity_tiers_and_read_only_endpoints(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,)], "tier int")
    score = lambda rule, fix="none": scoring.severity(F.lit(rule), F.lit(fix), F.lit(False), "tier")["score"]
    rows = df.select("tier", score("FR-PERM-001", "low").alias("low"), score("FR-PERF-001").alias("perf"), score("FR-I18N-001").alias("text")).collect()
    assert [(r.low, r.perf, r.text) for r in sorted(rows)] == [(24, 4, 2), (25, 5, 2), (27, 7, 2), (29, 9, 2), (24, 4, 2)]


def test_bands(spark):
    df = spark.createDataFrame([(s,) for s in (60.0, 59.9, 40.0, 20.0, 0.5, 0.0, None)], "s double")
    rows = df.select(scoring.band("s").alias("a"), scoring.band("s", zero_is_low=True).alias("b"), scoring.report_level("s").alias("c")).collect()
    assert [tuple(r) for r in rows] == [
        ("CRITICAL", "CRITICAL", "error"), ("HIGH", "HIGH", "warning"), ("HIGH", "HIGH", "warning"), ("MEDIUM", "MEDIUM", "warning"),
        ("LOW", "LOW", "note"), ("—", "LOW", "note"), ("—", "LOW", "note")]


# ---- comments ----------------------------------------------------------------------------------
@pytest.mark.parametrize("comment, rule, kept", [
    ("x = 1  # tracewright: ignore", "FR-A-001", False),
    ("x = 1  #tracewright:ignore FR-A-001", "FR-A-001", False),
    ("x = 1  # tracewright: ignore FR-A-001", "FR-B-001", True),
    ("x = 1  # tracewright: ignore FR-B-001, FR-A-001", "FR-A-001", False),
    ("x = 1  # tracewright: ignore FR-B-001 FR-A-001", "FR-A-001", False),
    ("x  # tracewright: ignore FR-B-001 # tracewright: ignore FR-A-001", "FR-A-001", False),
    ("x  # tracewright: ignore FR-B-001 # tracewright: ignore", "FR-A-001", False),
    ("x  # tracewright: ignore FR-A-0010", "FR-A-001", True),
    ("x  # tracewright: ignore FR-A-00", "FR-A-001", True),
    ("x  # TraceWright : IGNORE", "FR-A-001", False),
    ("x  # tracewright: ignored?", "FR-A-001", False),
    ("x  # tracewrigth: ignore", "FR-A-001", True),
])
def test_nearby_comment(spark, comment, rule, kept):
    lines = spark.createDataFrame([("r", "a.py", 4, comment)], "repo string, file string, line int, text string")
    found = candidates(spark, {"rule": rule, "line": 4}, {"rule": rule, "line": 5}, {"rule": rule, "line": 6}, {"rule": rule, "line": 3})
    assert column(fd.silenced_nearby(found, lines), "line") == ([3, 4, 5, 6] if kept else [3, 6])


@pytest.mark.parametrize("comment, kept", [
    ("x # tracewright:ignore", False), ("x # tracewright:ignore  ", False), ("x # tracewright:ignore FR-A-0010", False),
    ("x # tracewright:ignore FR-B-001", True), ("x # tracewright: ignore", True), ("x #tracewright:ignore", True)])
def test_same_line_comment(spark, comment, kept):
    lines = spark.createDataFrame([("r", "a.py", 4, comment)], "repo string, file string, line int, text string")
    found = candidates(spark, {"rule": "FR-A-001", "line": 4}, {"rule": "FR-A-001", "line": 5})
    assert column(fd.silenced_on_line(found, lines), "line") == ([4, 5] if kept else [5])


# ---- identity -------------------------------------------------------------------------------------
def test_fingerprint_ignores_lines(spark):
    rows = candidates(spark, {"rule": "A"}, {"rule": "A", "line": 9}, {"rule": "A", "hash": "other"}, {"rule": "B"}, {"rule": "A", "file": "b.py"})
    prints = [r.f for r in rows.select(fd.fingerprint().alias("f")).collect()]
    assert prints[0] == prints[1] and len(set(prints)) == 4 and all(len(p) == 32 for p in prints)
    ids = [r.f for r in rows.select(fd.finding_id().alias("f")).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 4 and ids[0].startswith("A-") and len(ids[0]) == 18


def test_known_findings(spark):
    rows = candidates(spark, {"rule": "A"}, {"rule": "B"}, {"rule": "C", "version": "1.1.0"})
    log = spark.createDataFrame([("id1", "A", "1.0.0", "r", "a.py", "f", "h", "x"), ("id2", "C", "1.0.0", "r", "a.py", "f", "h", "x"),
                                 ("id3", "B", "1.0.0", "other", "a.py", "f", "h", "x")],
                                "finding_id string, rule_id string, rule_version string, repo string, file string, function string, code_location_hash string, reason string")
    assert column(fd.drop_false_positives(rows, log), "rule_id") == ["B", "C"]
    assert column(fd.suppressed_ids(rows, log), "finding_id") == ["id1"]
    baseline = rows.where("rule_id = 'B'").select(fd.fingerprint().alias("fingerprint"))
    assert column(fd.drop_known(rows, baseline), "rule_id") == ["A", "C"]


def test_last_of_equal_keys_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, o int, v string")
    assert {r.k: r.v for r in fd.keep_last(df, ["k"], "o").collect()} == {"a": "y", "b": None}
    assert {r.k: r.v for r in fd.keep_first(df, ["k"], "o").collect()} == {"a": "x", "b": None}


def test_changed_files_are_text_suffixes(spark):
    rows = candidates(spark, {"rule": "A", "file": "shop/api.py"}, {"rule": "B", "file": "myapi.py"}, {"rule": "C", "file": "x.py"})
    changed = spark.createDataFrame([("api.py",), ("longer/than/anything/x.py",)], "path string")
    assert column(fd.only_changed(rows, changed), "rule_id") == ["A", "B"]
    assert fd.only_changed(rows, changed.limit(0)).count() == 0


def test_globs(spark):
    rows = candidates(spark, *({"rule": f, "file": f} for f in ("a/b/gen_x.py", "a/tests/t.py", "x.py", "a/deep/er/y.py")))
    assert column(fd.exclude_paths(rows, ["gen_*", "*/tests/*"]), "file") == ["a/deep/er/y.py", "x.py"]
    assert column(fd.exclude_paths(rows, ["a/*y.py"]), "file") == ["a/b/gen_x.py", "a/tests/t.py", "x.py"]


# ---- text ---------------------------------------------------------------------------------------------
def test_python_lines_match_splitlines(spark):
    samples = ["a\nb", "a\nb\n", "", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1ee\x85f\u2028g\u2029h", "\n\n", "x  y z"]
    rows = spark.createDataFrame(list(enumerate(samples)), "n int, t string").select("n", text.python_lines("t").alias("l")).collect()
    assert {r.n: r.l for r in rows} == {n: s.splitlines() for n, s in enumerate(samples)}


def test_small_text_functions(spark):
    one = spark.range(1)
    row = one.select(
        text.spaced_class_name(F.lit("POSInvoiceItem2Go")).alias("a"), text.rule_family(F.lit("FR-A-001")).alias("b"),
        text.last_segment(F.lit("a.b.c")).alias("c"), text.module_keys(F.lit("x/lib/__init__.py")).alias("d"),
        text.module_path(F.lit("x/lib/__init__.py")).alias("e"), text.is_non_runtime_path(F.lit("A\\Tests\\x.py")).alias("f"),
        text.is_non_runtime_path(F.lit("a/test_x.py")).alias("g"), text.is_report_path(F.lit("a/My_Report/x.py")).alias("h"),
        text.is_workflow_path(F.lit("a/workflows/x.py")).alias("i"), text.line_number(F.lit("-4")).alias("j")).first()
    assert row.a == "POS Invoice Item2 Go" and row.b == "FR-A" and row.c == "c" and row.e == "x/lib"
    assert sorted(row.d) == ["__init__", "lib", "lib/__init__", "x/lib", "x/lib/__init__"]
    assert (row.f, row.g, row.h, row.i, row.j) == (True, True, True, False, 1)


def test_paths_sort_by_parts(spark):
    from pathlib import PurePosixPath

    paths = ["a-b/c.py", "a/b.py", "a/b/c.py", "a.py", "a/b-c.py", "A/z.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(text.path_order("p"))
    assert [r.p for r in df.collect()] == [str(p) for p in sorted(map(PurePosixPath, paths))]


def test_mentions_against_brute_force(spark):
    import re

    texts = ["select a from `tabSales Order`", "TABSALES ORDER", "xtabSales Order", "tabSales Order2, tab_x", "tabSales  Order", "a tabNote;tab_x b"]
    names = ["tabSales Order", "tabNote", "tab_x", "tabSales", "tabNo.te"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "k int, t string")
    n = spark.createDataFrame([(x,) for x in names], "n string")
    want = {(i, x) for i, s in enumerate(texts) for x in names if re.search(rf"(?<![A-Za-z0-9_])`?{re.escape(x)}`?(?![A-Za-z0-9_])", s, re.I)}
    assert {(r.k, r.n) for r in mn.mentions(t, n, ["k"], "t", "n", on=[]).collect()} == want
    assert brute_mentions(texts, names) == want
    exact = {(i, x) for i, s in enumerate(texts) for x in names if x in set(re.findall("[A-Za-z0-9_]+", s))}
    assert {(r.k, r.n) for r in mn.exact_mentions(t, n, ["k"], "t", "n", on=[]).collect()} == exact


def brute_mentions(texts, names):
    import re

    return {(i, x) for i, s in enumerate(texts) for x in names if re.search(rf"(?<![A-Za-z0-9_])`?{re.escape(x)}`?(?![A-Za-z0-9_])", s, re.I)}


def test_names_of_any_form_against_brute_force(spark):
    """Names that begin or end with anything, of any number of words, and of no word at all."""
    import random

    rng = random.Random(5)
    piece = lambda n: "".join(rng.choice(["a", "B", "ab", "a_1", " ", "-", "--", ".", "`", "é", ", "]) for _ in range(rng.randrange(1, n)))
    texts = sorted({piece(14) for _ in range(160)}) + ["", "a", "--", "`--`", "a--b", "-- a", "a b c d", "(a b c d)"]
    names = sorted({piece(6) for _ in range(220)} | {"a b c d", "--", "-", "é", ".a", "a.", ".a.b-", "`a`"})
    names = [x for i, x in enumerate(names) if x.lower() not in {y.lower() for y in names[:i]}]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    n = spark.createDataFrame([(x,) for x in names], "n string")
    got = [(r.k, r.n) for r in mn.mentions(t, n, ["k"], "t", "n", on=[]).collect()]
    want = brute_mentions(texts, names)
    assert len(want) > 300 and len(got) == len(set(got)) and set(got) == want


def test_a_second_page_sorts_and_writes_nothing(spark, monkeypatch):
    written = []
    real = vw.materialise
    monkeypatch.setattr(vw, "materialise", lambda df, name: written.append(name) or real(df, name))
    rows = spark.range(1, 1001).select(((F.col("id") * 7919) % 1009).alias("key"), "id")
    want = sorted((r.key, r.id) for r in rows.collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        check_pages(rows, want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert written == ["numbered"] and vw.paged(rows.limit(0), [F.col("id")]).page(1).collect() == []


def check_pages(rows, want):
    pages = vw.paged(rows, [F.col("key"), F.col("id")])
    assert pages.total == 1000 and pages.count(30) == 34 and len(pages.ranges.sizes) > 2
    for number, first in ((1, 0), (2, 30), (17, 480), (34, 990), (99, 990), (-3, 0)):
        shown = pages.page(number, 30)
        assert [tuple(r) for r in shown.collect()] == want[first:first + 30]
        plan = shown._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "PushedFilters: [" in plan and "_part" in plan
    whole = [tuple(r) for n in range(1, 35) for r in pages.page(n, 30).collect()]
    assert whole == want


# ---- rules ------------------------------------------------------------------------------------------------
def test_rules_as_of_versions(spark):
    rules = spark.createDataFrame([("A", "1.2.0", "old"), ("A", "1.10.0", "new"), ("A", "1.10.0", "new again"), ("B", "2.0", "b"), ("C", "x", "c")],
                                  "rule_id string, rule_version string, recipe string")
    found = spark.createDataFrame([(1, "A", "1.9.9"), (2, "A", "1.10.0"), (3, "A", "1.1.0"), (4, "A", "2.0.0"), (5, "B", "2.0"), (6, "D", "1.0.0"), (7, None, "1"),
                                   (8, "A", None), (9, "C", "0.1"), (2, "A", "1.10.0")], "n int, rule_id string, rule_version string")
    got = sorted((r.n, r.recipe) for r in rl.as_of(found, rules, "recipe").collect())
    assert [(n, {"new again": "new"}.get(x, x)) for n, x in got] == [
        (1, "old"), (2, "new"), (2, "new"), (3, None), (4, "new"), (5, "b"), (6, None), (7, None), (8, None), (9, "c")]


def test_registry(spark, tmp_path):
    rows = {r.entry: r for r in rl.taxonomy(spark).collect()}
    assert rows["FR-HOOK"].tier == "core" and (rows["FR-HOOK"].first, rows["FR-HOOK"].last) == (1, 7) and not any(r.is_open for r in rows.values())
    # every detector has its place
    ids = rl.rule_table(spark).withColumnRenamed("rule_id", "taxonomy_id")
    assert rl.placed(ids, rl.taxonomy(spark)).where("problem IS NOT NULL").collect() == []
    path = tmp_path / "registry.yaml"
    path.write_text("core: {FR-A: {range: 001-002}}\nadditional: {FR-B: {range: x, name: TBD}, FR-C: }\nextensions: {FR-A-009: {status: renamed}}\n")
    own = rl.taxonomy(spark, str(path))
    assert {r.entry: r.is_open for r in own.collect()} == {"FR-A": False, "FR-B": True, "FR-C": False, "FR-A-009": False}
    asked = spark.createDataFrame([(x,) for x in ("FR-A-001", "FR-A-003", "FR-A-009", "FR-Z-001", "FR-B-001", None)], "taxonomy_id string")
    assert {r.taxonomy_id: (r.entry, r.problem) for r in rl.placed(asked, own).collect()} == {
        "FR-A-001": ("FR-A", None), "FR-A-003": ("FR-A", "number"), "FR-A-009": ("FR-A-009", None), "FR-Z-001": (None, "unknown"),
        "FR-B-001": ("FR-B", None), None: (None, "unknown")}


# ---- graph ------------------------------------------------------------------------------------------------
def small_graph(spark):
    edges = spark.createDataFrame([("r", s, d) for s, d in
                                   [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "*run"), ("x", "y")]], "repo string, src string, dst string")
    members = spark.createDataFrame([("r", "*run", "e"), ("r", "*run", "f"), ("r", "*idle", "g")], "repo string, hub string, member string")
    return gr.CallGraph(edges, members)


def test_reachability(spark):
    graph = small_graph(spark)
    seed = spark.createDataFrame([("r", "a"), ("r", "alone")], "repo string, symbol_id string")
    hops = [set(column(gr.reach(graph, seed, k), "symbol_id")) for k in range(5)]
    assert hops == [{"a", "alone"}, {"a", "b", "alone"}, {"a", "b", "c", "alone"}, {"a", "b", "c", "d", "alone"},
                    {"a", "b", "c", "d", "e", "f", "alone"}]
    assert set(column(gr.reach_all(graph, seed), "symbol_id")) == hops[4]


def plain_reach(edges, members, seeds):
    found, waiting = set(seeds), list(seeds)
    while waiting:
        x = waiting.pop()
        for s, d in edges:
            if s == x:
                for t in [m for h, m in members if h == d] if d.startswith("*") else [d]:
                    if t not in found:
                        found.add(t)
                        waiting.append(t)
    return found


def graph_of(spark, edges, members):
    rows = lambda pairs, ddl: spark.createDataFrame([("r", *p) for p in pairs], f"repo string, {ddl}")
    return gr.CallGraph(rows(edges, "src string, dst string"), rows(members, "hub string, member string"))


@pytest.mark.parametrize("seed", range(4))
def test_reach_by_chains_against_a_plain_walk(spark, seed):
    """Chains, rings, hubs and branches, and seeds in the middle of all of them."""
    import random

    rng = random.Random(seed)
    edges, n = set(), 0
    for _ in range(12):
        size, kind = rng.randrange(1, 9), rng.choice(["chain", "ring", "star", "loop"])
        nodes = [f"n{n + i}" for i in range(size)]
        edges |= set(zip(nodes, nodes[1:]))
        if kind == "ring" and size > 1:
            edges.add((nodes[-1], nodes[0]))
        if kind == "loop":
            edges.add((nodes[0], nodes[0]))
        if kind == "star" and n:
            edges |= {(nodes[-1], f"n{rng.randrange(n)}"), (f"n{rng.randrange(n)}", nodes[rng.randrange(size)])}
        if rng.random() < 0.4:
            edges.add((nodes[-1], f"*h{rng.randrange(3)}"))
        n += size
    members = {(f"*h{h}", f"n{rng.randrange(n)}") for h in range(4) for _ in range(2)}
    seeds = [f"n{rng.randrange(n)}" for _ in range(2)]
    want = plain_reach(edges, members, seeds)
    graph = gr.stored(graph_of(spark, edges, members), hub_rows=1)
    start = spark.createDataFrame([("r", x) for x in {*seeds}], "repo string, symbol_id string")
    for hops in (0, 1, 3):
        got = column(gr.reach_all(graph, start, plain_hops=hops), "symbol_id")
        assert sorted(got) == sorted(want), hops


def test_long_chains_take_few_rounds(spark, monkeypatch):
    made = []
    real = gr.materialise
    monkeypatch.setattr(gr, "materialise", lambda df, name: made.append(name) or real(df, name))
    at = spark.range(10_000).select(F.lit("r").alias("repo"), F.concat(F.lit("f"), "id").alias("src"), F.concat(F.lit("f"), F.col("id") + 1).alias("dst"))
    graph = gr.CallGraph(at, spark.createDataFrame([], "repo string, hub string, member string"))
    seed = spark.createDataFrame([("r", "f20")], "repo string, symbol_id string")
    assert gr.reach_all(graph, seed).count() == 9981
    rounds = sum(name in ("reach", "chains") for name in made)
    assert rounds <= 20, made


def test_members_of_uncalled_names_are_left_out(spark):
    graph = small_graph(spark)
    kept = gr.stored(graph, hub_rows=1)
    assert {(r.hub, r.member) for r in kept.members.collect()} == {("*run", "e"), ("*run", "f")}
    assert {(r.hub, r.parts) for r in kept.hubs.collect()} == {("*run", 2)} and {r.part for r in kept.members.collect()} <= {0, 1}


def test_flags_within_one_hop(spark):
    flags = spark.createDataFrame([("r", s, s in "fy", s == "b") for s in "abcdefgxy"], "repo string, symbol_id string, check boolean, write boolean")
    starts = spark.createDataFrame([("r", s) for s in "acdx"], "repo string, symbol_id string")
    rows = gr.within_one_hop(small_graph(spark), starts, flags, ("check", "write")).collect()
    assert {r.symbol_id: (r.check, r.write) for r in rows} == {"a": (False, True), "c": (False, False), "d": (True, False), "x": (True, False)}


# ---- ledger --------------------------------------------------------------------------------------------------
def ledger(spark, *rows):
    ddl = ("id string, rule_id string, rule_version string, repo string, taxonomy_id string, status string, proof_tier int, impact_class string, proven string,"
           "reproducer_hash string, upstream_pr string, status_history array<struct<date:string,status:string,proof_tier:int,reproducer_hash:string>>")
    return spark.createDataFrame([(f"i{n}", rule, "1", repo, rule, status, tier, "rce", None, None, None, []) for n, (rule, repo, status, tier) in enumerate(rows)], ddl)


def test_results_change_the_ledger(spark):
    book = ledger(spark, *[("FR-A-001", "r", "candidate", 0)] * 5)
    results = spark.createDataFrame([("i0", "passed", 2, "x"), ("i1", "failed", 1, "y"), ("i2", "dry_run", 2, "z"), ("i3", "skipped", 2, None)],
                                    "finding_id string, status string, proof_tier int, reproducer_hash string")
    rows = {r.id: r for r in lg.apply_results(book, results, "2026-01-02").collect()}
    assert {k: (r.status, r.proof_tier, len(r.status_history), r.proven) for k, r in rows.items()} == {
        "i0": ("proven", 2, 1, "2026-01-02"), "i1": ("false_positive", 0, 1, None), "i2": ("candidate", 0, 0, None),
        "i3": ("candidate", 0, 1, None), "i4": ("candidate", 0, 0, None)}
    again = lg.apply_results(lg.apply_results(book, results, "2026-01-02"), results, "2026-01-03")
    assert [len(r.status_history) for r in again.orderBy("id").collect()] == [2, 2, 0, 2, 0]
    assert column(lg.eligible(again, 2), "id") == ["i0"]


def test_existing_rows_stay(spark):
    book = ledger(spark, ("FR-A-001", "r", "proven", 2))
    both = lg.insert_absent(book, ledger(spark, ("FR-A-001", "r", "candidate", 0), ("FR-B-001", "r", "candidate", 0)))
    assert {r.id: r.status for r in both.collect()} == {"i0": "proven", "i1": "candidate"}


def test_reports(spark):
    book = ledger(spark, *[("FR-PERM-001", "a", s, 0) for s in ("proven", "merged", "false_positive", "candidate", "regressed", "false_positive")],
                  *[("FR-INJ-001", "b", "false_positive", 0)] * 5, ("FR-INJX-001", "b", "candidate", 0))
    precision = {r.rule_id: (r.proven, r.false_positives, r.precision) for r in rp.precision_by_rule(book).collect()}
    assert precision == {"FR-PERM-001": (3, 2, 0.6), "FR-INJ-001": (0, 5, 0.0), "FR-INJX-001": (0, 0, None)}
    rates = {r.rule_id: (r.attempts, r.fp_rate, r.needs_logic_review) for r in rp.fp_rates(book).collect()}
    assert rates == {"FR-PERM-001": (5, 0.4, False), "FR-INJ-001": (5, 1.0, True)}
    assert [r.n for r in rp.status_counts(book).orderBy("position").collect()] == [2, 1, 1, 0, 7, 1]
    assert {r.family: r.n for r in rp.family_coverage(book).collect() if r.n} == {"FR-PERM": 6, "FR-INJ": 6}
    report = "\n".join(r.line for r in rp.in_order(rp.track_record(book)).collect())
    assert "| FR-PERM-001 v1 | 3 | 2 | 60% |" in report and "| FR-INJX-001 v1 | 0 | 0 | N/A |" in report
    assert "| a | 1 | 1 | 1 | 2 |" in report and "| rce | 12 |" in report and "- No merged upstream records." in report


def test_scans(spark):
    scans = spark.createDataFrame([("s1", "done", 1.0, 5.0), ("s2", "running", 9.0, None), ("s3", "done", 2.0, 4.0)],
                                  "scan_id string, status string, started_at double, finished_at double")
    rows = spark.createDataFrame([("s1", "proven"), ("s1", "error"), ("s3", "candidate")], "scan_id string, status string")
    counts = {r.scan_id: (r.finding_count, r.proven_count, r.candidate_count) for r in rp.scan_list(scans, rows).collect()}
    assert counts == {"s1": (2, 1, 0), "s2": (0, 0, 0), "s3": (1, 0, 1)}
    assert rp.latest_scan(scans).first()[0] == "s1" and rp.latest_scan(scans.where("status <> 'done'")).first()[0] == "s2"
    assert rp.proof_summary(rows.limit(0)).first().proven_pct == 0.0
    assert rp.scan_stats(rows, "s1").first().errors == 1


# ---- list ------------------------------------------------------------------------------------------------------
def test_numbers_are_global_and_complete(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.col("id"))
    rows = vw.numbered(df, [F.col("v").desc(), F.col("id")]).collect()
    assert {r.v: r.number for r in rows} == {v: 5000 - v for v in range(5000)}


def test_pages_clamp(spark):
    df = spark.range(60)
    ids = lambda n: [r.id for r in vw.page(df, [F.col("id")], n).collect()]
    assert ids(1) == list(range(25)) and ids(3) == ids(99) == list(range(50, 60)) and ids(0) == ids(1)
    assert vw.page(df.limit(0), [F.col("id")], 2).collect() == []
    deep = spark.range(30000)
    assert [r.id for r in vw.page(deep, [F.col("id")], 1100).collect()] == list(range(27475, 27500))


def test_selection_is_unique(spark):
    rows = spark.createDataFrame([("i1", "a", 1, "R", "f"), ("i2", "b", 2, "R", "g"), (None, "c", 3, "R", "h"), (None, "c", 3, "R", "h")],
                                 "id string, file string, line int, rule_id string, function string")
    ids = spark.createDataFrame([("i1",), ("",)], "id string")
    spots = rows.where("file IN ('a', 'c')")
    assert sorted(r.file for r in vw.select(rows, ids, spots).collect()) == ["a", "c"]


def test_snippets(spark):
    files = spark.createDataFrame([("r", "a.py", "\n".join("abcdef"))], "repo string, file string, text string")
    asked = spark.createDataFrame([("r", "a.py", "2"), ("r", "a.py", "x"), ("r", "none.py", "1")], "repo string, file string, line string")
    rows = vw.snippets(asked, files, before=99, after=1).orderBy("num").collect()
    assert [(r.num, r.code, r.is_error) for r in rows] == [(1, "a", False), (2, "b", True), (3, "c", False)]


def test_each_query_builds_its_own_index(monkeypatch):
    from tracewright.plans import catalog

    built = []
    monkeypatch.setattr(catalog.derived_app, "derived_sources", lambda spark, sf: sf)
    monkeypatch.setattr(catalog, "build_index", lambda given: built.append(given) or object())
    session = type("Session", (), {"sparkContext": type("Context", (), {"applicationId": "a"})})()
    assert catalog.derived_index(session, "x") is not catalog.derived_index(session, "x") and built == ["x", "x"]
