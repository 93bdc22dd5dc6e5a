"""Graph walks by levels: one job a level, arcs, frontiers and visited sets as Parquet in the checkpoint folder."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import kept


def one_hop(edges: DataFrame, node: str, kinds: tuple[str, ...] = ("call",)) -> DataFrame:
    """GRF-1, SET-3: distinct neighbours, each with its direction."""
    own = edges.where(F.col("edge_kind").isin(*kinds))
    out = own.where(F.col("from_symbol") == node).select(F.col("to_symbol").alias("neighbour"), F.lit("callee").alias("direction"))
    return out.unionByName(own.where(F.col("to_symbol") == node).select(F.col("from_symbol").alias("neighbour"), F.lit("caller").alias("direction"))).distinct()


def implementors(edges: DataFrame, interface: str) -> DataFrame:
    """GRF-2."""
    return edges.where((F.col("edge_kind") == "implements") & (F.col("to_symbol") == interface)).select(F.col("from_symbol").alias("implementor")).distinct()


def levels(seeds: DataFrame, arcs: DataFrame, most: int | None = None) -> DataFrame:
    """node, depth: everything within most steps (any number, for None) of seeds (node) along arcs (source, target), at its least depth."""
    arcs = kept(arcs.select("source", "target").distinct())
    seen = frontier = kept(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while most is None or depth < most:
        depth += 1
        reached = frontier.join(arcs, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        frontier = kept(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


@dataclass(frozen=True)
class Path:
    """GRF-3: the nodes of a shortest path, or None; how many nodes were seen; on a miss, up to five nodes where either side stopped."""

    nodes: list[str] | None
    explored: int
    forward: list[str]
    backward: list[str]


def shortest_path(arcs: DataFrame, start: str, end: str, most: int = 8) -> Path:
    """GRF-3: a shortest path from both ends; most counts the steps of either side (1 to 20), the side with fewer open nodes steps first.

    Every open node carries its own path, of 20 nodes at most; of several paths the least is taken.
    """
    if start == end:
        return Path([start], 1, [], [])
    spark, arcs = arcs.sparkSession, kept(arcs.select("source", "target").distinct())
    turned = {"out": arcs, "in": arcs.select(F.col("target").alias("source"), F.col("source").alias("target"))}
    side = {k: kept(spark.createDataFrame([(v, [v])], "node string, path array<string>")) for k, v in (("out", start), ("in", end))}
    front, sizes, seen = dict(side), {"out": 1, "in": 1}, 2
    for _ in range(min(max(most, 1), 20)):
        way = "out" if sizes["out"] <= sizes["in"] else "in"
        if not sizes[way]:
            break
        step = front[way].join(turned[way], F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        step = step.groupBy("node").agg(F.min("path").alias("path"))
        front[way] = kept(step.join(side[way].select("node"), "node", "left_anti"))
        sizes[way] = front[way].count()
        seen += sizes[way]
        side[way] = side[way].unionByName(front[way])
        other = side["in" if way == "out" else "out"].withColumnRenamed("path", "other")
        head, tail = ("path", "other") if way == "out" else ("other", "path")
        whole = F.concat(head, F.reverse(F.slice(tail, F.lit(1), F.size(tail) - 1)))
        met = front[way].join(other, "node").select(whole.alias("whole")).agg(F.min(F.struct(F.size("whole").alias("n"), "whole")).alias("best")).first()["best"]
        if met is not None:
            return Path(list(met["whole"]), seen, [], [])
    five = lambda k: [r["node"] for r in front[k].select("node").orderBy("node").limit(5).collect()]
    return Path(None, seen, five("out"), five("in"))


@dataclass(frozen=True)
class CallTree:
    """GRF-4: tree (parent, node, depth, place, cycle, repeated, omitted), reached (node, depth: all met, shown or not), omitted neighbours in all, and whether the walk stopped short."""

    tree: DataFrame
    reached: DataFrame
    omitted: int
    depth_capped: bool


def _neighbourhood(arcs: DataFrame, root: DataFrame, most: int, fan: int, cap: int | None) -> DataFrame:
    """source, target, nth, n: the neighbours, by name, of all nodes that a walk of most steps meets; each node is looked up once."""
    seen = front = root
    found, by = None, Window.partitionBy("source")
    for depth in range(most + 1):
        own = arcs.join(front.withColumnRenamed("node", "source"), "source", "left_semi").distinct()
        near = kept(own.withColumns({"nth": F.row_number().over(by.orderBy("target")), "n": F.count("*").over(by)}))
        found = near if found is None else found.unionByName(near)
        if depth == most or (cap is not None and seen.count() >= cap):
            break
        front = kept(near.where(F.col("nth") <= fan).select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return found


def _root_state(root: DataFrame, in_cycle: DataFrame) -> DataFrame:
    """node, trail: the root, and itself as its path where it is on a cycle."""
    return root.join(in_cycle, "node", "left").select("node", F.when(F.col("component").isNotNull(), F.array("node")).otherwise(F.array().cast("array<string>")).alias("trail"))


def _with_components(near: DataFrame, in_cycle: DataFrame) -> DataFrame:
    """near (source, target, ...) with the components _from and _to of either end; null where it is on no cycle."""
    at, to = in_cycle.select(F.col("node").alias("source"), F.col("component").alias("_from")), in_cycle.select(F.col("node").alias("target"), F.col("component").alias("_to"))
    return near.join(at, "source", "left").join(to, "target", "left")


def _next_trail() -> Column:
    """What of the path to target, reached from a state by an arc of _with_components, lies in its component."""
    inside = F.col("_to").isNotNull() & F.col("_from").eqNullSafe(F.col("_to"))
    return F.when(inside, F.array_sort(F.concat("trail", F.array("target")))).when(F.col("_to").isNotNull(), F.array("target")).otherwise(F.array().cast("array<string>"))


def call_tree(arcs: DataFrame, root: str, most: int, fan: int | None = None, cap: int | None = None, seeds: list[str] | None = None) -> CallTree:
    """GRF-4: the tree below root along arcs (source, target); seeds stand for the root's own neighbours.

    Each node shows its first fan neighbours by name (all, for None); the rest are omitted, but reached. A node ends
    as cycle where it is on its own path. A node that would show children at a later place again is
    repeated there and has no rows below; places are paths of neighbours' numbers, in the order of a
    walk into depth. The walk stops at most steps, or at the first level before which cap distinct nodes
    were met (never, for None); either way, and if neighbours with steps left to go were omitted, depth_capped says so.

    The walk goes by levels over distinct states: a node, and what of its path lies in its own strongly
    connected component, as only that can close a cycle. Each state keeps its first place and the number
    of its paths, so a diamond costs its nodes and not its paths. A row names its parent; none holds a path of names.
    """
    spark, fan = arcs.sparkSession, sys.maxsize if fan is None else fan
    near = arcs.select("source", "target")
    if seeds is not None:
        near = near.where(F.col("source") != root).unionByName(spark.createDataFrame([(root, x) for x in seeds], "source string, target string"))
    start = spark.createDataFrame([(root,)], "node string")
    near = kept(_neighbourhood(near, start, most, fan, cap))
    in_cycle = kept(_components(near.where(F.col("nth") <= fan).select("source", "target")))
    near = kept(_with_components(near, in_cycle))
    state = kept(_root_state(start, in_cycle).select("node", "trail", F.array().cast("array<int>").alias("place"), F.lit(1).cast("decimal(38,0)").alias("ways")))
    reached, open_states, omitted, capped, stop = None, None, 0, False, most
    met = state.select("node")
    for depth in range(most + 1):
        here = state.select("node").distinct().withColumn("depth", F.lit(depth))
        reached = here if reached is None else reached.unionByName(here)
        step = state.join(near, F.col("node") == F.col("source"))
        if depth == most:
            capped = capped or not step.isEmpty()
            break
        hard = cap is not None and met.count() >= cap
        left_out = kept(step.where(F.lit(hard) | (F.col("nth") > fan)).select("target", "ways"))
        lost = left_out.agg(F.sum("ways").alias("n")).first()["n"]
        if lost:
            omitted, capped = omitted + int(lost), capped or depth + 1 < most
            reached = reached.unionByName(left_out.select(F.col("target").alias("node"), F.lit(depth + 1).alias("depth")).distinct())
        if hard:
            stop = depth
            break
        now = state.withColumn("depth", F.lit(depth))
        open_states = now if open_states is None else open_states.unionByName(now)
        onward = step.where((F.col("nth") <= fan) & ~F.array_contains("trail", F.col("target")))
        onward = onward.select(F.col("target").alias("node"), _next_trail().alias("trail"), F.concat("place", F.array("nth")).alias("place"), "ways")
        state = kept(onward.groupBy("node", "trail").agg(F.min("place").alias("place"), F.sum("ways").cast("decimal(38,0)").alias("ways")))
        if state.isEmpty():
            break
        met = kept(met.unionByName(state.select("node")).distinct())
    # each node shows its children at the first of all its places, if the places above do too
    many = near.select(F.col("source").alias("node"), F.col("n").alias("_n")).distinct()
    none = spark.createDataFrame([], "node string, _n long, first struct<place: array<int>, depth: int, trail: array<string>>")
    first = none
    if open_states is not None:
        first = open_states.join(many, "node").groupBy("node", "_n").agg(F.min(F.struct("place", "depth", "trail")).alias("first"))
    first = kept(first.select("node", "_n", "first.*"))
    above = first.where("depth > 0").select("node", "depth", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda k: F.slice("place", F.lit(1), k))).alias("place"))
    hidden = above.join(first.select("place"), "place", "left_anti").select("node").distinct()
    shown = first.join(hidden, "node", "left_anti")
    below = shown.select(F.col("node").alias("source"), "depth", "trail", "place").join(near.where(F.col("nth") <= fan), "source")
    rows = below.select(F.col("source").alias("parent"), F.col("target").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("place", F.array("nth")).alias("place"), F.array_contains("trail", F.col("target")).alias("cycle"))
    rows = start.select(F.lit(None).cast("string").alias("parent"), "node", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("place"), F.lit(False).alias("cycle")).unionByName(rows)
    rows = rows.join(many, "node", "left").join(first.select("node", F.col("place").alias("_first")), "node", "left")
    opens = ~F.col("cycle") & F.col("_n").isNotNull() & (F.col("depth") < stop)
    cut = F.when(~F.col("cycle") & (F.col("depth") == stop) & F.lit(stop < most), F.col("_n")).when(opens, F.greatest(F.col("_n") - fan, F.lit(0)))
    out = rows.select("parent", "node", "depth", "place", "cycle", (opens & (F.col("_first") != F.col("place"))).alias("repeated"), F.coalesce(cut, F.lit(0)).cast("int").alias("omitted"))
    return CallTree(kept(out), reached.distinct(), omitted, capped)


def blast_radius(arcs: DataFrame, root: str, most: int) -> DataFrame:
    """AGG-23: node, depth: where paths along arcs (source, target) from root end that meet no node twice, by their steps, most at most.

    Every neighbour of every node is followed, and none is numbered, so no node's neighbours meet in one
    task. The walk goes by the states of call_tree; they grow with the paths only within a component.
    """
    start = arcs.sparkSession.createDataFrame([(root,)], "node string")
    arcs = arcs.select("source", "target").distinct()
    near = kept(arcs.join(levels(start, arcs, most - 1).select(F.col("node").alias("source")), "source", "left_semi"))
    in_cycle = kept(_components(near))
    near = kept(_with_components(near, in_cycle))
    state = kept(_root_state(start, in_cycle))
    reached = state.select("node", F.lit(0).alias("depth"))
    for depth in range(1, most + 1):
        step = state.join(near, F.col("node") == F.col("source")).where(~F.array_contains("trail", F.col("target")))
        state = kept(step.select(F.col("target").alias("node"), _next_trail().alias("trail")).distinct())
        if state.isEmpty():
            break
        reached = reached.unionByName(state.select("node", F.lit(depth).alias("depth")))
    return reached.distinct()


def depth_counts(reached: DataFrame) -> DataFrame:
    """AGG-23: distinct nodes by depth; a node counts at every depth it is met at."""
    return reached.groupBy("depth").agg(F.count_distinct("node").alias("nodes"))


def rename_chain(renames: DataFrame) -> DataFrame:
    """GRF-5, SET-2: id, former, depth: everything an id was called before (renames: id, old_id), at its least depth, cycles once.

    Pairs are joined with themselves: those just 2^k renames apart, and from there all that are 2^k apart
    at most, give those up to 2^(k + 1). So rounds grow with the logarithm of the longest chain, and a
    pair is found once for each node halfway.
    """
    ids = renames.select("id").distinct().select("id", F.col("id").alias("former"), F.lit(0).alias("depth"))
    known = kept(renames.where("old_id IS NOT NULL AND id <> old_id").select("id", F.col("old_id").alias("former"), F.lit(1).alias("depth")).distinct())
    reach = 1
    while not (jumps := known.where(F.col("depth") == reach)).isEmpty():
        far = known.select(F.col("id").alias("_mid"), F.col("former").alias("_far"), F.col("depth").alias("_more"))
        longer = jumps.join(far, F.col("former") == F.col("_mid")).where("id <> _far").select("id", F.col("_far").alias("former"), (F.col("depth") + F.col("_more")).alias("depth"))
        known = kept(known.unionByName(longer).groupBy("id", "former").agg(F.min("depth").alias("depth")))
        reach *= 2
    return ids.unionByName(known)


def _trimmed(arcs: DataFrame) -> DataFrame:
    """The arcs left once the nodes that none leads to, or that lead to none, have gone; one layer at either end."""
    inner = arcs.join(arcs.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
    return inner.join(arcs.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")


def _closed(step: DataFrame) -> DataFrame:
    """id, end, last, least, steps, on: where following to (id, to, both strings; one row an id) leads for every id, by doubling.

    end is the first node that isn't an id itself, last the id before it and steps the arcs to it, with
    on false; where none is met, the walk goes round a cycle: on is true and least the cycle's least node.
    """
    ids = step.count()
    inner = step.select(F.col("id").alias("to"), F.lit(True).alias("on"))
    state = kept(step.join(inner, "to", "left").select("id", F.col("to").alias("end"), F.col("id").alias("last"), F.least("id", "to").alias("least"), F.lit(1).cast("long").alias("steps"), F.coalesce("on", F.lit(False)).alias("on")))
    reach = 1
    while reach < 2 * ids and not state.where("on").isEmpty():
        ahead = state.select(F.col("id").alias("end"), *[F.col(c).alias(f"_{c}") for c in ("end", "last", "least", "steps", "on")])
        go = state.where("on").join(ahead, "end").select("id", F.col("_end").alias("end"), F.col("_last").alias("last"), F.least("least", "_least").alias("least"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_on").alias("on"))
        state = kept(state.where("NOT on").unionByName(go))
        reach *= 2
    return state


def _least_origin(arcs: DataFrame) -> DataFrame:
    """node, origin: the least node from which each node can be reached, itself included."""
    state = kept(arcs.select(F.col("source").alias("node")).union(arcs.select("target")).distinct().withColumn("origin", F.col("node")))
    print_of = lambda d: d.agg(F.sum(F.xxhash64("node", "origin").cast("decimal(38,0)"))).first()[0]
    before = print_of(state)
    while True:
        passed = state.join(arcs, F.col("node") == F.col("source")).select(F.col("target").alias("node"), "origin")
        state = kept(state.unionByName(passed).groupBy("node").agg(F.min("origin").alias("origin")))
        now = print_of(state)
        if now == before:
            return state
        before = now


def _components(arcs: DataFrame) -> DataFrame:
    """node, component: the strongly connected component, by its least node, of every node on a cycle.

    Runs of nodes with one arc in and one out become a single arc, by doubling, so that a chain or a ring
    of any length takes rounds in the logarithm of its length; what then has no arc in or no arc out goes.
    Both are repeated until nothing changes. The rest takes the least node that reaches it as its colour,
    and what reaches that node within its colour is its component; the others are coloured anew. Runs
    whose both ends are in one component belong to it.
    """
    arcs = kept(arcs.select("source", "target").distinct())
    left, found, rounds = arcs, [], []
    while True:
        loops = left.where("source = target")
        found.append(loops.select(F.col("source").alias("node"), F.col("source").alias("component")))
        plain = left.where("source <> target")
        one_in = plain.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("_in"), F.first("source").alias("from"))
        one_out = plain.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("_out"), F.first("target").alias("to"))
        run = one_in.join(one_out, "id").where("_in = 1 AND _out = 1").join(loops.select(F.col("source").alias("id")), "id", "left_anti")
        run = kept(run.select("id", "from", "to"))
        if not run.isEmpty():
            ends = _closed(run.select("id", "to"))
            rings = ends.where("on").select(F.col("id").alias("node"), F.col("least").alias("component"))
            found.append(rings)
            whole = ends.where("NOT on").select("id", "last", "steps", F.col("end").alias("tail"))
            heads = whole.join(run.select("id", "from"), "id").groupBy("last").agg(F.max_by("from", "steps").alias("head"))  # a run starts at its farthest id
            through = kept(whole.join(heads, "last").select("id", "head", "tail"))
            rounds.append(through)
            short = through.select(F.col("head").alias("source"), F.col("tail").alias("target")).distinct()
            rest = plain.join(run.select(F.col("id").alias("source")), "source", "left_anti").join(run.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target")
            plain = rest.unionByName(short).distinct()
        before = left
        left = kept(_trimmed(kept(plain)))
        if left.isEmpty():
            break
        if left.count() == before.where("source <> target").count() and left.where("source = target").isEmpty():
            break
    while not left.isEmpty():
        colour = _least_origin(left)
        ends = colour.select(F.col("node").alias("target"), F.col("origin").alias("_o"))
        same = left.join(colour.withColumnRenamed("node", "source"), "source").join(ends, "target").where("origin = _o")
        back = levels(colour.where("node = origin").select("node"), same.select(F.col("target").alias("source"), F.col("source").alias("target")))
        members = kept(back.select("node").join(colour, "node").select("node", F.col("origin").alias("component")))
        found.append(members.join(members.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1"), "component").select("node", "component"))
        gone = members.select("node")
        left = left.join(gone.select(F.col("node").alias("source")), "source", "left_anti").join(gone.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target")
        left = kept(_trimmed(left))
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    known = kept(all_found.groupBy("node").agg(F.min("component").alias("component")))
    for through in reversed(rounds):  # the later runs hold the ends of the earlier ones
        head, tail = known.select(F.col("node").alias("head"), F.col("component").alias("_h")), known.select(F.col("node").alias("tail"), F.col("component").alias("_t"))
        inner = through.join(head, "head", "left").join(tail, "tail", "left").where((F.col("head") == F.col("tail")) | (F.col("_h") == F.col("_t")))
        inner = inner.select(F.col("id").alias("node"), F.coalesce("_h", "head").alias("component"))
        ends = inner.select(F.col("component").alias("node"), "component")
        rest = known.join(inner.select("node"), "node", "left_anti")  # a loop on a run's node made it a component of its own
        known = kept(rest.unionByName(inner).unionByName(ends).groupBy("node").agg(F.min("component").alias("component")))
    least = known.groupBy("component").agg(F.min("node").alias("_least"))
    return known.join(least, "component").select("node", F.col("_least").alias("component"))


def cycles(arcs: DataFrame) -> DataFrame:
    """GRF-6: component (the least node), members (sorted): strongly connected components with a cycle, self-loops included."""
    return _components(arcs).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))


def representative_cycles(arcs: DataFrame) -> DataFrame:
    """GRF-6: component, position (from 0), node: one cycle of each component, from its least node; every step of it is an arc.

    Each node goes on to its least target within the component, so every walk ends in a cycle. Doubling
    finds the nodes on such cycles (the ends of walks longer than all nodes), each cycle's least node and
    each node's place. A component with several cycles shows the one that has the least node.
    """
    inside = kept(_components(arcs))
    there = inside.select(F.col("node").alias("target"), F.col("component").alias("_c"))
    step = arcs.join(inside.withColumnRenamed("node", "source"), "source").join(there, "target").where("component = _c")
    step = kept(step.groupBy(F.col("source").alias("id"), "component").agg(F.min("target").alias("to")))
    on = _closed(step.select("id", "to")).select(F.col("end").alias("id")).distinct()
    round_ = kept(step.join(on, "id", "left_semi"))
    least = _closed(round_.select("id", "to")).select("id", "least")
    shown = round_.join(least, "id").groupBy("component").agg(F.min("least").alias("least"))
    round_ = kept(round_.join(least, "id").join(shown, ["component", "least"]))
    # without the arc that closes it, a cycle is a run, and steps count from its end
    run = _closed(round_.where("to <> least").select("id", "to")).select("id", "steps")
    far = round_.join(run, "id", "left").select("component", F.col("id").alias("node"), F.coalesce("steps", F.lit(0).cast("long")).alias("steps"))
    length = far.groupBy("component").agg(F.max("steps").alias("_most"))
    return far.join(length, "component").select("component", (F.col("_most") - F.col("steps")).alias("position"), "node")


def dependents(arcs: DataFrame, changed: DataFrame, most: int | None = None) -> DataFrame:
    """GRF-7: node, depth: all that depend on the changed (node), which have depth 0; arcs: a source depends on a target."""
    return levels(changed, arcs.select(F.col("target").alias("source"), F.col("source").alias("target")), most)


@dataclass(frozen=True)
class Hierarchy:
    """GRF-8: bases (id, base, depth), interfaces (id, interface, origin: direct or inherited), derived (id, derived)."""

    bases: DataFrame
    interfaces: DataFrame
    derived: DataFrame


def hierarchy(edges: DataFrame) -> Hierarchy:
    """GRF-8: of every type, from edges inherits and implements (from_symbol, to_symbol, edge_kind).

    An interface is what something implements. A type has the interfaces that it, its bases or its
    interfaces name; derived are the types below a class, and those that have an interface.
    """
    own = edges.where(F.col("edge_kind").isin("inherits", "implements")).select(F.col("from_symbol").alias("id"), F.col("to_symbol").alias("old_id"), "edge_kind").distinct()
    above = kept(rename_chain(own.select("id", "old_id")).where("depth > 0 AND id <> former"))
    named = own.where("edge_kind = 'implements'")
    direct = named.select("id", F.col("old_id").alias("interface"), F.lit(True).alias("_direct"))
    every = above.select("id", F.col("former").alias("interface")).join(named.select(F.col("old_id").alias("interface")).distinct(), "interface", "left_semi")
    interfaces = every.join(direct, ["id", "interface"], "left").select("id", "interface", F.when(F.col("_direct"), "direct").otherwise("inherited").alias("origin"))
    bases = rename_chain(own.where("edge_kind = 'inherits'").select("id", "old_id")).where("depth > 0").select("id", F.col("former").alias("base"), "depth")
    return Hierarchy(bases, interfaces, above.select(F.col("former").alias("id"), F.col("id").alias("derived")))


def seeded(edges: DataFrame, references: DataFrame, symbol: str) -> DataFrame:
    """GRF-9: callers of a symbol; without any, the members that refer to its type."""
    callers = edges.where((F.col("to_symbol") == symbol) & (F.col("edge_kind") == "call")).select(F.col("from_symbol").alias("node"))
    none = callers.limit(1).agg(F.count("*").alias("_n")).where("_n = 0")
    fallback = references.where(F.col("type") == symbol).select(F.col("member").alias("node")).join(none).drop("_n")
    return callers.unionByName(fallback).distinct()


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "source string, target string")
