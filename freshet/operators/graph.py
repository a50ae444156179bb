"""River graph (hybas_id drains to next_down): sums, membership and pairs without walking basin by basin.

All operators double a stride: in round k each node knows the node 2^k steps below it, so a
chain of a hundred thousand basins takes seventeen rounds of joins on one row per node. Rounds
are written to the shared folder, and a round's table is deleted once the next one is there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.sources.staging import Staging

# Parts that the basins above one node are numbered in, so that a node with very many is no hot task.
PARTS = 64


def _links(edges: DataFrame) -> DataFrame:
    links = edges.select(F.col("hybas_id").alias("node"), F.col("next_down").alias("to"))
    return links.filter("node is not null and to is not null and node <> to").distinct()


def _single(links: DataFrame) -> DataFrame:
    """The links; ValueError where a basin drains to more than one."""
    if not links.groupBy("node").count().filter("count > 1").isEmpty():
        raise ValueError("a basin drains to more than one basin")
    return links


def _nodes(links: DataFrame, *others: DataFrame) -> DataFrame:
    """All nodes with the node below each (null at the mouth)."""
    names = links.select("node").union(links.select("to"))
    for other in others:
        names = names.union(other)
    return names.filter("node is not null").distinct().join(links, "node", "left")


def _below(state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """state with far (the node below that below) and the columns of the node below, as below_*."""
    lower = state.select(F.col("node").alias("to"), F.col("to").alias("far"), *[F.col(c).alias(f"below_{c}") for c in columns])
    return state.join(lower, "to", "left")


def _rounds(nodes: DataFrame) -> int:
    """After so many rounds a path of all nodes has ended; one that goes on leads into a cycle."""
    return max(1, nodes.count()).bit_length() + 1


def _merge_cycles(staging: Staging, links: DataFrame, state: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(links with each cycle merged into its least node, node and rep of all cycle nodes).

    state has the nodes after all rounds: those that paths still lead to are the cycles.
    """
    cycle = staging.keep(state.filter("to is not null").select(F.col("to").alias("node")).distinct())
    ring = staging.keep(cycle.join(links, "node").withColumn("rep", F.col("node")))
    for _ in range(rounds):
        ring = staging.replace(
            ring, _below(ring, ["rep"]).select("node", F.col("far").alias("to"), F.least("rep", "below_rep").alias("rep"))
        )
    reps = staging.keep(ring.select("node", "rep"))
    staging.drop(ring, cycle)
    lower = reps.select(F.col("node").alias("to"), "rep")
    merged = links.join(reps.select("node"), "node", "left_anti").join(lower, "to", "left")
    return merged.select("node", F.coalesce("rep", "to").alias("to")), reps


def river_sums(edges: DataFrame, areas: DataFrame, outlets: DataFrame | None = None, value: str = "sub_area") -> DataFrame:
    """Per node: outlet, num_upstream_basins (itself included) and area, the sum of `value` over these.

    edges(hybas_id, next_down), areas(hybas_id, value); outlets(outlet) narrows the result. Every
    node adds its sum to that of the node 2^k below it, so no member pairs are formed and each
    round has one row per node. Nodes of a cycle all drain to each other: the cycle is merged
    into one node first. A node without an area counts but adds nothing; an area is null if no
    upstream basin has one. A basin may drain to one basin only (ValueError).
    """
    staging = Staging(edges.sparkSession, "sums")
    links = staging.keep(_single(_links(edges)))
    named = [outlets.select(F.col("outlet").alias("node"))] if outlets is not None else []
    nodes = staging.keep(_nodes(links, *named))
    per = areas.groupBy(F.col("hybas_id").alias("node")).agg(F.sum(value).alias("area"))
    rounds, reps = _rounds(nodes), None

    def start(nodes: DataFrame, own: DataFrame) -> DataFrame:
        return staging.keep(nodes.join(own, "node", "left").select("node", "to", F.coalesce("n", F.lit(1)).cast("long").alias("n"), "area"))

    def run(state: DataFrame) -> tuple[DataFrame, bool]:
        for _ in range(rounds):
            if state.filter("to is not null").isEmpty():
                return state, True
            added = state.filter("to is not null").groupBy(F.col("to").alias("node")).agg(
                F.sum("n").alias("add_n"), F.sum("area").alias("add_area")
            )
            total = F.coalesce(F.col("area") + F.col("add_area"), "area", "add_area")
            state = staging.replace(
                state,
                _below(state, []).join(added, "node", "left").select(
                    "node", F.col("far").alias("to"), (F.col("n") + F.coalesce("add_n", F.lit(0))).alias("n"), total.alias("area")
                ),
            )
        return state, state.filter("to is not null").isEmpty()

    state, ended = run(start(nodes, per.withColumn("n", F.lit(1))))
    if not ended:
        merged, reps = _merge_cycles(staging, links, state, rounds)
        staging.drop(state)
        # One node stands for a cycle, with the sums of all of it.
        inner = nodes.join(reps, "node", "left").join(per, "node", "left")
        own = inner.groupBy(F.coalesce("rep", "node").alias("node")).agg(F.count("*").alias("n"), F.sum("area").alias("area"))
        state, _ = run(start(_nodes(merged, own.select("node")), own))
        state = reps.select(F.col("node").alias("own"), F.col("rep").alias("node")).join(state, "node").select(
            F.col("own").alias("node"), "to", "n", "area"
        ).union(state.join(reps, "node", "left_anti").select("node", "to", "n", "area"))
    staging.drop(links, nodes)
    out = state.select(F.col("node").alias("outlet"), F.col("n").alias("num_upstream_basins"), "area")
    return out if outlets is None else out.join(outlets.select("outlet").distinct(), "outlet", "left_semi")


def river_labels(edges: DataFrame) -> DataFrame:
    """Interval labels of the river forest: node, tree (its mouth), first, last.

    Nodes are numbered from the mouth upwards, each before all basins above it, so the basins
    upstream of a node are those of its tree with first between its first and last: "drains to"
    is a test of two rows, and no pairs are kept. Nodes of a cycle have the same label.
    """
    staging = Staging(edges.sparkSession, "labels")
    links = staging.keep(_single(_links(edges)))
    sizes = river_sums(edges, edges.select("hybas_id", F.lit(1).alias("sub_area")).limit(0))
    sizes = staging.keep(sizes.select(F.col("outlet").alias("node"), F.col("num_upstream_basins").alias("size")))
    nodes = staging.keep(_nodes(links))
    rounds = _rounds(nodes)
    state = staging.keep(nodes)
    for _ in range(rounds):
        if state.filter("to is not null").isEmpty():
            break
        state = staging.replace(state, _below(state, []).select("node", F.col("far").alias("to")))
    reps = None
    if not state.filter("to is not null").isEmpty():
        merged, reps = _merge_cycles(staging, links, state, rounds)
        merged = staging.keep(merged)
        nodes = staging.keep(_nodes(merged, reps.select(F.col("rep").alias("node"))))
    # The numbers that the basins above one node begin at: parts of them first, then within a part.
    members = nodes.join(sizes, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
    before = Window.partitionBy("to").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = members.filter("to is not null").groupBy("to", "part").agg(F.sum("size").alias("total"))
    parts = parts.select("to", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("to", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    placed = members.filter("to is not null").join(parts, ["to", "part"]).select(
        "node", "to", "size", (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + 1).alias("first")
    )
    mouths = members.filter("to is null").select("node", "to", "size", F.lit(1).cast("long").alias("first"))
    numbered = placed.union(mouths).withColumn("tree", F.coalesce("to", "node"))
    state = staging.replace(state, numbered)
    # A node's number is the sum of the numbers along its way down.
    for _ in range(rounds):
        if state.filter("to is not null").isEmpty():
            break
        state = staging.replace(
            state,
            _below(state, ["first", "tree"]).select(
                "node", F.col("far").alias("to"), "size", (F.col("first") + F.coalesce("below_first", F.lit(0))).alias("first"),
                F.coalesce("below_tree", "tree").alias("tree"),
            ),
        )
    out = state.select("node", "tree", "first", (F.col("first") + F.col("size") - 1).alias("last"))
    if reps is not None:
        same = reps.join(out.withColumnRenamed("node", "rep"), "rep").select("node", "tree", "first", "last")
        out = same.union(out.join(reps, "node", "left_anti"))
    return out


def drains_to(pairs: DataFrame, labels: DataFrame, member: str = "member", outlet: str = "outlet") -> DataFrame:
    """pairs with drains: whether the member drains to the outlet (or is it); false for unknown basins."""
    up = labels.select(F.col("node").alias(member), F.col("tree").alias("_tree"), F.col("first").alias("_at"))
    down = labels.select(F.col("node").alias(outlet), F.col("tree").alias("_mouth"), F.col("first").alias("_lo"), F.col("last").alias("_hi"))
    told = pairs.join(up, member, "left").join(down, outlet, "left")
    inside = (F.col("_tree") == F.col("_mouth")) & F.col("_at").between(F.col("_lo"), F.col("_hi"))
    same = F.col(member) == F.col(outlet)
    return told.select(*[F.col(c) for c in pairs.columns], F.coalesce(inside | same, same, F.lit(False)).alias("drains"))


def upstream_of(edges: DataFrame, outlets: DataFrame) -> DataFrame:
    """member: each basin that drains to any of outlets(outlet), these included.

    A node hands down nothing but whether an outlet is on its way, so there is one row per node.
    """
    staging = Staging(edges.sparkSession, "upstream")
    links = _links(edges)
    ends = outlets.select(F.col("outlet").alias("node")).distinct()
    marked = _nodes(links, ends).join(ends.withColumn("hit", F.lit(True)), "node", "left")
    state = staging.keep(marked.select("node", "to", F.coalesce("hit", F.lit(False)).alias("hit")))
    # A cycle repeats what is known after as many rounds as a path of all nodes takes.
    for _ in range(_rounds(state)):
        if state.filter("to is not null and not hit").isEmpty():
            break
        # A node that has hit needs to know nothing more, but others pass through it.
        state = staging.replace(
            state,
            _below(state, ["hit"]).groupBy("node", F.col("far").alias("to")).agg(
                F.max(F.col("hit") | F.coalesce("below_hit", F.lit(False))).alias("hit")
            ),
        )
    return state.groupBy("node").agg(F.max("hit").alias("hit")).filter("hit").select(F.col("node").alias("member"))


def members_of(basins: DataFrame, members: DataFrame) -> DataFrame:
    """Basins among the members (semi-join; the anti-join is its complement)."""
    return basins.join(members, basins["hybas_id"] == members["member"], "left_semi")


def upstream_closure(edges: DataFrame, outlets: DataFrame) -> DataFrame:
    """All (outlet, member) pairs where the member drains to the outlet, itself included.

    For when the pairs themselves are wanted: counts and sums come from river_sums(),
    membership from upstream_of() and drains_to(). A cycle only repeats pairs that are already
    there and adds none.
    """
    staging = Staging(edges.sparkSession, "closure")
    jump = staging.keep(_links(edges))
    closure = staging.keep(outlets.select("outlet", F.col("outlet").alias("member")).distinct())
    size = closure.count()
    while True:
        found = jump.join(closure, jump["to"] == closure["member"]).select("outlet", F.col("node").alias("member"))
        closure = staging.replace(closure, closure.union(found).distinct())
        grown = closure.count()
        if grown == size:
            staging.drop(jump)
            return closure
        size = grown
        onward = jump.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jump = staging.replace(jump, jump.join(onward, "to").select("node", F.col("far").alias("to")))


def basin_summary(edges: DataFrame, areas: DataFrame, outlets: DataFrame) -> DataFrame:
    """Number of basins upstream of each outlet (itself included) and their total area."""
    return river_sums(edges, areas, outlets)


def gage_upstream_counts(gage_basins: DataFrame, sums: DataFrame, keys: Sequence[str] = ("gage_id",)) -> DataFrame:
    """num_upstream_basins per gage, from the river_sums() of the gage's own basin."""
    counts = sums.select("outlet", "num_upstream_basins")
    return gage_basins.join(counts, gage_basins["hybas_id"] == counts["outlet"], "left").select(
        *keys, "hybas_id", "num_upstream_basins"
    )
