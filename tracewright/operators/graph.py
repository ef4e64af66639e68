"""Call graph as DataFrames, and bounded / unbounded reachability over it.

Dynamic calls (``get_doc(..).method()``) may reach every function of that name.
Listing those pairs grows with callers x functions, so the graph keeps them
factored: an edge leads from the caller to a *hub* ``*name`` and the ``members``
relation lists the functions behind the hub.  Stepping through a hub costs no hop,
so hop counts are those of the plain graph.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_keys, module_path, path_order
from ..session import materialise
from .facts import Facts

c = F.col

DIRECT, STRING, HOOK, DYNAMIC = "direct_call", "string_dispatch", "hook_dispatch", "dynamic_method"
CONFIDENCE = {DIRECT: 1.0, STRING: 0.9, HOOK: 0.85, DYNAMIC: 0.4}
HOOK_ROOT = "__framework_hook_root__"


@dataclass(frozen=True)
class CallGraph:
    """``edges(repo, src, dst, kind, confidence)`` and ``members(repo, hub, member)``."""

    edges: DataFrame
    members: DataFrame
    unresolved: DataFrame | None = None
    is_stored: bool = False
    hubs: DataFrame | None = None

    @property
    def adjacency(self) -> DataFrame:
        """Distinct (repo, src, dst); dst may be a hub."""
        if self.edges.columns == ["repo", "src", "dst"]:
            return self.edges
        return self.edges.select("repo", "src", "dst").distinct()


def hub(name):
    return F.concat(F.lit("*"), name)


def exactly_one(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with a single row, and that row's value."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def _ordinal(path="path"):
    return F.struct(path_order(path).alias("file"), c("ord").alias("ord"))


def import_targets(facts: Facts, functions: DataFrame) -> DataFrame:
    """(repo, path, local_name) -> candidate functions of that import: count and one id.

    A function can be imported under every suffix of its module path; counting per
    (suffix, name) first makes the join with the imports many-to-one.
    """
    imports = facts.imports.groupBy("repo", "path", "local_name").agg(
        F.count("*").alias("n_imports"), F.min("module").alias("module"), F.min("imported_name").alias("name")
    ).where("n_imports = 1 AND module <> ''").withColumn("module_key", F.replace("module", F.lit("."), F.lit("/")))
    wanted = imports.select("repo", "name").distinct()
    offered = (
        functions.join(wanted, ["repo", "name"], "left_semi")
        .select("repo", "name", "symbol_id", F.explode(module_keys("path")).alias("module_key"))
        .groupBy("repo", "module_key", "name")
        .agg(F.count("*").alias("n_targets"), F.min("symbol_id").alias("target"))
    )
    return imports.join(offered, ["repo", "module_key", "name"]).select(
        "repo", "path", "local_name", "n_targets", "target"
    )


def resolve_paths(paths: DataFrame, functions: DataFrame) -> DataFrame:
    """Dotted paths (repo, target) -> function id: by qualified name (the last one
    defined wins), else by exact module path and name (the first one wins)."""
    named = functions.groupBy("repo", c("func").alias("target")).agg(
        F.max_by("symbol_id", _ordinal()).alias("by_name")
    )
    located = functions.groupBy("repo", module_path("path").alias("module"), c("name").alias("last")).agg(
        F.min_by("symbol_id", _ordinal()).alias("by_module")
    )
    split = (
        paths.select("repo", "target").distinct()
        .withColumn("last", F.substring_index("target", ".", -1))
        .withColumn("module", F.when(F.contains("target", F.lit(".")), F.replace(
            F.regexp_replace("target", r"\.[^.]*$", ""), F.lit("."), F.lit("/"))))
    )
    return (
        split.join(named, ["repo", "target"], "left")
        .join(located, ["repo", "module", "last"], "left")
        .select("repo", "target", F.coalesce("by_name", "by_module").alias("dst"))
        .where(c("dst").isNotNull())
    )


def build_call_graph(facts: Facts, handlers: DataFrame | None = None) -> CallGraph:
    functions = facts.functions.select("repo", "path", "ord", "symbol_id", "func", "name")
    calls = facts.calls.select("repo", "path", "symbol_id", "line_start", "callee_name")

    # direct calls: a single function of that name in the file, else a single import
    local = functions.groupBy("repo", "path", c("name").alias("callee_name")).agg(
        F.count("*").alias("n_local"), F.min("symbol_id").alias("local_id")
    )
    imported = import_targets(facts, functions).withColumnRenamed("local_name", "callee_name")
    resolved = (
        calls.join(local, ["repo", "path", "callee_name"], "left")
        .join(imported, ["repo", "path", "callee_name"], "left")
        .withColumn("n", F.coalesce("n_local", "n_targets", F.lit(0)))
        .withColumn("dst", F.when(c("n") == 1, F.coalesce("local_id", "target")))
    )
    direct = resolved.where(c("dst").isNotNull()).select("repo", c("symbol_id").alias("src"), "dst")

    dispatches = facts.string_dispatch_calls.select("repo", c("symbol_id").alias("src"), "target")
    dispatched = dispatches.join(resolve_paths(dispatches, functions), ["repo", "target"]).select("repo", "src", "dst")

    methods = facts.dynamic_method_calls.select("repo", c("symbol_id").alias("src"), hub(c("method_name")).alias("dst"))
    members = functions.select("repo", hub(c("name")).alias("hub"), c("symbol_id").alias("member")).distinct()

    edges = _labelled(direct, DIRECT).unionByName(_labelled(dispatched, STRING)).unionByName(_labelled(methods, DYNAMIC))
    if handlers is not None:
        targets = handlers.select("repo", c("handler").alias("target"))
        hooked = targets.join(resolve_paths(targets, functions), ["repo", "target"]).select(
            "repo", F.lit(HOOK_ROOT).alias("src"), "dst"
        )
        edges = edges.unionByName(_labelled(hooked, HOOK))

    unnamed = facts.unresolved_calls.select("repo", "symbol_id", "line_start", F.lit("dynamic_call").alias("callee_name"))
    unresolved = (
        resolved.where(c("dst").isNull()).select("repo", "symbol_id", "line_start", "callee_name")
        .unionByName(unnamed)
        .select("repo", F.concat_ws(":", "symbol_id", "line_start", "callee_name").alias("call")).distinct()
    )
    return CallGraph(edges, members, unresolved)


#: members of a hub that one task joins; larger hubs are dealt into parts
HUB_ROWS = 20_000


def called_members(graph: CallGraph) -> DataFrame:
    """Members of the hubs that some call leads to; nobody asks for those of other names."""
    called = graph.adjacency.where(c("dst").startswith("*")).select("repo", c("dst").alias("hub")).distinct()
    return graph.members.join(called, ["repo", "hub"], "left_semi")


def hub_parts(members: DataFrame, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(repo, hub, parts): into how many parts each hub is dealt, by its size."""
    return members.groupBy("repo", "hub").agg(F.ceil(F.count(F.lit(1)) / hub_rows).cast("int").alias("parts"))


def dealt(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Members with the part of their hub they belong to: a popular method name may
    hold a large share of all functions and must not be joined in one task."""
    return members.join(hubs, ["repo", "hub"]).select(
        "repo", "hub", "member", F.pmod(F.xxhash64("member"), c("parts")).cast("int").alias("part"))


def stored(graph: CallGraph, hub_rows: int = HUB_ROWS) -> CallGraph:
    """The graph with its distinct edges and the members that calls can lead to written once: a
    traversal joins them in every hop, and should neither plan nor compute them again each time."""
    if graph.is_stored:
        return graph
    adjacency = materialise(graph.adjacency, "adjacency")
    members = materialise(called_members(replace(graph, edges=adjacency)), "members")
    hubs = materialise(hub_parts(members, hub_rows), "hubs")
    return CallGraph(adjacency, materialise(dealt(members, hubs), "members"), graph.unresolved, True, hubs)


def callees(graph: CallGraph) -> DataFrame:
    """(repo, src, callees): the distinct direct callees of each caller, in order."""
    return graph.adjacency.groupBy("repo", "src").agg(F.array_sort(F.collect_set("dst")).alias("callees"))


def _labelled(edges: DataFrame, kind: str) -> DataFrame:
    return edges.select("repo", "src", "dst", F.lit(kind).alias("kind"), F.lit(CONFIDENCE[kind]).alias("confidence"))


# ---- traversal ---------------------------------------------------------------------
FOUND_PARTS = 4
#: hops that are walked one by one before what is left is contracted
PLAIN_HOPS = 8


def _through_hubs(nodes: DataFrame, graph: CallGraph) -> DataFrame:
    """Nodes (repo, hub) with hubs replaced by their members; plain nodes stay.

    A hub is asked once for each of its parts; plain nodes have a single copy."""
    if graph.hubs is None:
        members = called_members(graph)
        hubs = hub_parts(members)
        members = dealt(members, hubs)
    else:
        members, hubs = graph.members, graph.hubs
    asked = nodes.join(hubs, ["repo", "hub"], "left").select(
        "repo", "hub", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    through = asked.join(members, ["repo", "hub", "part"], "left")
    return through.select("repo", F.coalesce("member", "hub").alias("src")).where(~c("src").startswith("*")).distinct()


def reach(graph: CallGraph, seeds: DataFrame, max_hops: int) -> DataFrame:
    """Distinct (repo, symbol_id) within ``max_hops`` of the seeds, seeds included.

    A chain of joins whose length is the hop bound: every step carries the nodes
    found so far along, so no step's plan appears twice.
    """
    found = seeds.select("repo", c("symbol_id").alias("src")).distinct()
    for _ in range(max_hops):
        hop = (
            found.join(graph.adjacency, ["repo", "src"], "left")
            .select("repo", F.explode(F.array("src", "dst")).alias("hub"))
            .where(c("hub").isNotNull()).distinct()
        )
        found = _through_hubs(hop, graph)
    return found.select("repo", c("src").alias("symbol_id"))


def reach_all(graph: CallGraph, seeds: DataFrame, plain_hops: int = PLAIN_HOPS) -> DataFrame:
    """Everything reachable from the seeds (seeds included), cycles allowed.

    The first hops are walked one by one: semi-naive, so each joins only the nodes found last.  Most call graphs
    end there.  What is left of a deeper one is contracted: a chain of functions that only call,
    and are only called by, one other becomes one node (``chains``), in a number of rounds that
    follows the logarithm of its length, and the walk goes on from chain to chain.
    """
    graph = stored(graph)
    found, frontier = _walk(
        lambda nodes: _through_hubs(nodes.join(graph.adjacency, ["repo", "src"]).select("repo", c("dst").alias("hub")).distinct(), graph),
        materialise(seeds.select("repo", c("symbol_id").alias("src")).distinct(), "reach"), plain_hops)
    if frontier is not None:
        found = _by_chains(graph, found, frontier)
    return found.select("repo", c("src").alias("symbol_id"))


def _walk(step, start: DataFrame, hops: int | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Nodes (repo, src) found by repeated steps from ``start``, which ``known`` must not hold, and the last
    ones if ``hops`` did not suffice.

    Every round's new nodes are written once.  What was found is kept in at most ``FOUND_PARTS`` tables,
    merged when there are more, so neither the plan nor the files to read grow with the rounds.
    """
    found, frontier, done = [start], start, 0
    while hops is None or done < hops:
        new = step(frontier).join(_all(found if known is None else [known, *found]), ["repo", "src"], "left_anti")
        new = materialise(new, "reach")
        if new.isEmpty():
            return _all(found), None
        found = [*found, new] if len(found) < FOUND_PARTS else [materialise(_all([*found, new]), "reach")]
        frontier, done = new, done + 1
    return _all(found), frontier


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def chains(links: DataFrame) -> DataFrame:
    """(repo, node, chain, place) of all nodes that are not the first of their chain.

    ``links``: distinct (repo, src, dst).  A link is inner if nothing else leaves its source and nothing else
    enters its target; the links of a chain are inner, so a chain is entered at its first node and
    left at its last one, and only there.  It bears the name of its first node.  Every node points
    at the one before it, and each round makes pointers four times as long, until they meet a
    first node.  Nodes whose pointers never do form rings, which nothing enters or leaves: all
    of a ring's nodes bear the name of the smallest one, at place 0.
    """
    single_out = links.groupBy("repo", "src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst")).where("n = 1 AND src <> dst")
    single_in = links.groupBy("repo", "dst").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    inner = single_out.join(single_in.select("repo", "dst"), ["repo", "dst"], "left_semi")
    points = materialise(inner.select(
        "repo", c("dst").alias("node"), c("src").alias("chain"), F.lit(1).cast("long").alias("place"), c("src").alias("least"),
        F.lit(False).alias("ends")), "chains")
    total, reached = points.count(), 1
    left = total
    while left and reached <= 4 * total:  # a round more than the longest chain needs, to see that it ends
        here = points
        for _ in range(3):  # the pointer's target points further, or is a first node
            ahead = points.select("repo", c("node").alias("chain"), c("chain").alias("further"), c("place").alias("more"), c("least").alias("low"))
            joined = here.join(ahead, ["repo", "chain"], "left")
            here = joined.select(
                "repo", "node", F.coalesce("further", "chain").alias("chain"), (c("place") + F.coalesce("more", F.lit(0))).alias("place"),
                F.least("least", "low").alias("least"), c("further").isNull().alias("ends"))
        points = materialise(here, "chains")
        left, reached = points.where("NOT ends").count(), reached * 4
    return points.select("repo", "node", F.when(c("ends"), c("chain")).otherwise(c("least")).alias("chain"),
                         F.when(c("ends"), c("place")).otherwise(0).alias("place"))


def _by_chains(graph: CallGraph, found: DataFrame, frontier: DataFrame) -> DataFrame:
    """``found`` and all that the frontier reaches, chain by chain.

    Functions that call nothing are left out of the chains and added at the end: calls to them would
    cut a chain at each of its nodes."""
    members = graph.members.select("repo", c("hub").alias("src"), c("member").alias("dst"))
    whole_graph = materialise(graph.adjacency.unionByName(members), "links")
    callers = whole_graph.select("repo", c("src").alias("dst")).distinct()
    links = materialise(whole_graph.join(callers, ["repo", "dst"], "left_semi"), "links")
    last = whole_graph.join(callers, ["repo", "dst"], "left_anti")
    placed = materialise(chains(links), "placed")
    inner = placed.select("repo", c("node").alias("src"), "chain", "place")
    # a link to a node that has no place enters a chain at its first node
    entering = links.join(placed.select("repo", c("node").alias("dst")), ["repo", "dst"], "left_anti")
    between = materialise(entering.join(inner, ["repo", "src"], "left").select(
        "repo", F.coalesce("chain", "src").alias("src"), "dst").distinct(), "between")

    def step(nodes: DataFrame) -> DataFrame:
        return nodes.join(between, ["repo", "src"]).select("repo", c("dst").alias("src")).distinct()

    # of the chains that the frontier stands in, the nodes from there on
    begun = frontier.join(inner, ["repo", "src"], "left").groupBy("repo", F.coalesce("chain", "src").alias("chain")).agg(
        F.min(F.coalesce("place", F.lit(0))).alias("from"))
    begun = materialise(begun, "begun")
    onward = placed.join(begun, ["repo", "chain"]).where(c("place") >= c("from")).select("repo", c("node").alias("src"))
    first = step(begun.select("repo", c("chain").alias("src"))).join(found, ["repo", "src"], "left_anti")
    entered, _ = _walk(step, materialise(first, "entered"), known=found)
    whole = placed.join(entered.select("repo", c("src").alias("chain")), ["repo", "chain"], "left_semi").select("repo", c("node").alias("src"))
    reached = materialise(_all([frontier, onward, entered, whole]).distinct(), "reached")
    ends = reached.join(last, ["repo", "src"]).select("repo", c("dst").alias("src"))
    return _all([found, reached, ends]).where(~c("src").startswith("*")).distinct()


def within_one_hop(graph: CallGraph, starts: DataFrame, flags: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """For each start, whether it or a direct callee carries each flag.

    ``flags``: (repo, symbol_id, *names).  Members of a hub are combined before the
    join with the callers, so a popular method name costs one row.
    """
    either = [F.max(n).alias(n) for n in names]
    own = flags.join(starts, ["repo", "symbol_id"], "left_semi").select("repo", "symbol_id", *names)
    targets = flags.select("repo", c("symbol_id").alias("dst"), *names)
    hubs = (
        graph.members.join(targets, (graph.members["member"] == c("dst")) & (graph.members["repo"] == targets["repo"]))
        .select(graph.members["repo"], c("hub").alias("dst"), *names)
        .groupBy("repo", "dst").agg(*either)
    )
    called = (
        graph.adjacency.join(starts.select("repo", c("symbol_id").alias("src")), ["repo", "src"], "left_semi")
        .join(targets.unionByName(hubs), ["repo", "dst"])
        .select("repo", c("src").alias("symbol_id"), *names)
    )
    return own.unionByName(called).groupBy("repo", "symbol_id").agg(*either)


def one_hop_targets(graph: CallGraph, starts: DataFrame) -> DataFrame:
    """The starts and their direct callees."""
    return reach(graph, starts, 1)
