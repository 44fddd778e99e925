"""Connected components by contraction within tasks and star steps between them (G10), strong ones by colours and cycles (G16)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed as saved
from ..sources.scratch import dropped, shares, written

#: Edges that one task contracts by itself.
TASK_EDGES = 1_000_000


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For the nodes 0 to n - 1, the least node that the undirected edges (a, b) reach.

    Trees hook to the least neighbouring tree and are flattened; a turn at least halves the trees that have a neighbour.
    """
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        hooked = root.copy()
        np.minimum.at(hooked, root[a], low)
        np.minimum.at(hooked, root[b], low)
        while not np.array_equal(flat := hooked[hooked], hooked):
            hooked = flat
        if np.array_equal(hooked, root):
            return root
        root = hooked


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's nodes, each with the least node of its component within the partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ends = [pa.chunked_array([b.column(i) for b in held]) for i in (0, 1)]
    nodes = pc.unique(pa.chunked_array([c for e in ends for c in e.chunks]))
    nodes = nodes.take(pc.array_sort_indices(nodes))
    a, b = (pc.index_in(e, nodes).to_numpy().astype(np.int64) for e in ends)
    root = least_reached(a, b, len(nodes))
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], names=["u", "v"])


def connected(edges: DataFrame, most_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component): the least node that each node of the undirected edges (a, b) can reach.

    Each round deals the edges to tasks of about `task_edges`, and each task replaces its edges by one edge from every node to
    the least node that it reaches there.  Edges that one task holds are done by that.  Of more, every node hooks
    its larger neighbours and then its smaller ones to the least of them, so trees of different tasks grow together; the
    rounds end when one changes nothing.  Strings are compared by code point.
    """

    def hooked(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return pairs.join(low, "u")

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    kind = now.schema["u"].dataType.simpleString()
    seen = None
    for _ in range(most_rounds):
        n = shares(now.count(), task_edges)
        forest = (now.coalesce(1) if n == 1 else now.repartition(n, "u")).mapInArrow(_forest, f"u {kind}, v {kind}")
        if n == 1:
            out = written(forest.select(F.col("u").alias("node"), F.col("v").alias("component")))
            dropped(now)
            return out
        both = forest.where("u <> v")
        both = both.union(both.select("v", "u"))
        wide = hooked(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        tight = hooked(wide)
        after = written(tight.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(tight.select("u", F.col("m").alias("v"))).distinct())
        dropped(now)
        now = after
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _ends(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The nodes of directed edges in order, and the edges' ends as numbers of nodes."""
    held = [b for b in batches if b.num_rows]
    ends = [pa.chunked_array([b.column(i) for b in held]) for i in (0, 1)] if held else [pa.chunked_array([pa.array([], pa.int64())])] * 2
    nodes = pc.unique(pa.chunked_array([c for e in ends for c in e.chunks]))
    nodes = nodes.take(pc.array_sort_indices(nodes))
    return (nodes, *(pc.index_in(e, nodes).to_numpy().astype(np.int64) for e in ends))


def strong_numbers(n: int, after: list[list[int]]) -> list[int]:
    """For each node its strongly connected component, named by the node that was met first in it; after[v]: where edges of v lead."""
    met, low, name, stack, turn = [-1] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        if met[root] >= 0:
            continue
        path = [(root, iter(after[root]))]
        met[root] = low[root] = turn
        turn += 1
        stack.append(root)
        while path:
            v, rest = path[-1]
            for w in rest:
                if met[w] < 0:
                    met[w] = low[w] = turn
                    turn += 1
                    stack.append(w)
                    path.append((w, iter(after[w])))
                    break
                if name[w] < 0:
                    low[v] = min(low[v], met[w])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[v])
                if low[v] == met[v]:
                    while True:
                        w = stack.pop()
                        name[w] = v
                        if w == v:
                            break
    return name


def _strong_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's edges to (node, component) of the nodes on cycles; a component is named by its least node."""
    nodes, a, b = _ends(batches)
    after: list[list[int]] = [[] for _ in range(len(nodes))]
    for v, w in zip(a.tolist(), b.tolist(), strict=True):
        after[v].append(w)
    name = np.array(strong_numbers(len(nodes), after), np.int64)
    sizes, least = np.bincount(name, minlength=len(nodes)), np.full(len(nodes), len(nodes))
    np.minimum.at(least, name, np.arange(len(nodes)))
    loops = np.zeros(len(nodes), bool)
    loops[a[a == b]] = True
    on = np.flatnonzero((sizes[name] > 1) | loops) if len(nodes) else np.zeros(0, np.int64)
    if len(on):
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(on)), nodes.take(pa.array(least[name[on]]))], names=["node", "component"])


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows for a join that must not be broadcast: files of nodes are small and hold very many, which would all go through the driver."""
    return rows.hint("merge")


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, colour): `start` carried along the edges (before, after) to every node, the greatest colour that reaches it."""
    now, state = written(start.select("node", "colour")), None
    while True:
        came = now.join(_shuffled(edges.withColumnRenamed("before", "node")), "node").select(F.col("after").alias("node"), "colour")
        later = written(now.unionByName(came).groupBy("node").agg(F.max("colour").alias("colour")))
        dropped(now)
        now, before = later, state
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "colour"))).first()
        if state == before:
            return now


def strong_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) of all nodes on cycles of the directed edges (before, after); a component is named by its least node.

    Edges that one task holds are done there.  Of more, first those go whose nodes lack a way in or a way out, as long as
    that halves them; then colours spread: every node takes the greatest node that reaches it, and what leads back to that
    node within its colour is its component.  Components never cross colours, so only edges of one colour are left.  Colours
    take as many rounds as the longest of the shortest ways between nodes.
    """
    kind = dict(edges.dtypes)["before"]
    now, found = written(edges.select("before", "after").where("before is not null and after is not null").distinct()), None
    while True:
        n = now.count()
        if n <= task_edges:
            here = written(now.repartition(1).mapInArrow(_strong_in_task, f"node {kind}, component {kind}"))
            return here if found is None else found.unionByName(here)
        ways = now.join(_shuffled(now.select(F.col("after").alias("before")).distinct()), "before", "left_semi").join(_shuffled(now.select(F.col("before").alias("after")).distinct()), "after", "left_semi")
        left = written(ways.select("before", "after"))
        dropped(now)
        if 2 * left.count() <= n:
            now = left
            continue
        colour = _spread(left.select(F.col("before").alias("node")).union(left.select("after")).distinct().withColumn("colour", F.col("node")), left)
        of = lambda end: _shuffled(colour.select(F.col("node").alias(end), F.col("colour").alias(f"_{end}")))
        own = written(left.join(of("before"), "before").join(of("after"), "after").where("_before = _after").select("before", "after", F.col("_before").alias("colour")))
        # Backwards from each colour's own node, within the colour.
        back = own.select(F.col("after").alias("before"), F.col("before").alias("after"))
        reached = _spread(own.select(F.col("colour").alias("node"), "colour").distinct(), back)
        inside = own.join(_shuffled(reached.select(F.col("node").alias("before"))), "before", "left_semi").join(_shuffled(reached.select(F.col("node").alias("after"))), "after", "left_semi")
        # A node alone is on a cycle only by an edge to itself, so a component's nodes are those with edges inside.
        members = inside.select("colour", F.col("before").alias("node")).distinct()
        named = written(members.join(_shuffled(members.groupBy("colour").agg(F.min("node").alias("component"))), "colour").select("node", "component"))
        rest = own.join(_shuffled(reached.select(F.col("node").alias("before"))), "before", "left_anti").join(_shuffled(reached.select(F.col("node").alias("after"))), "after", "left_anti")
        now = written(rest.select("before", "after"))
        dropped(left, own, colour, reached)
        found = named if found is None else found.unionByName(named)


def cycles(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, component, size, next_node, on_cycle of the nodes that lie on cycles of the directed edges (before, after).

    `next_node` is the least successor within the component.  Following it from any node ends in one cycle; the nodes of
    such cycles are marked by doubling the step until it is longer than any component, so `on_cycle` rows spell cycles out.
    """
    named = saved(strong_components(edges, task_edges))
    of = lambda end: _shuffled(named.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")))
    inside = edges.select("before", "after").join(of("before"), "before").join(of("after"), "after").where("_before = _after")
    step = written(inside.groupBy(F.col("before").alias("node")).agg(F.min("after").alias("next_node")))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    most, jump = sizes.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0], step.withColumnRenamed("next_node", "far")
    for _ in range(int(most).bit_length()):
        twice = jump.join(_shuffled(jump.select(F.col("node").alias("far"), F.col("far").alias("_far"))), "far").select("node", F.col("_far").alias("far"))
        jump = written(twice)
    ring = jump.select(F.col("far").alias("node")).distinct().withColumn("_ring", F.lit(True))
    return named.join(_shuffled(sizes), "component").join(_shuffled(step), "node").join(_shuffled(ring), "node", "left").select("node", "component", "size", "next_node", F.coalesce("_ring", F.lit(False)).alias("on_cycle"))


def held_up(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node): nodes on cycles and all behind them, which no order can reach."""
    there = strong_components(edges, task_edges).select("node")
    return _spread(there.withColumn("colour", F.lit(0)), edges.select("before", "after").distinct()).select("node")


def acyclic(edges: DataFrame) -> tuple[bool, DataFrame]:
    """Whether the directed edges (before, after) have no cycle, and the edges that lead to nodes on cycles or behind them."""
    left = saved(edges.select("before", "after").join(held_up(edges).withColumnRenamed("node", "after"), "after", "left_semi"))
    return left.isEmpty(), left


def change_errors(changes: DataFrame) -> DataFrame:
    """(name, error, about) of a frame of changes (name, kind, parent, phase, depends_on): what is wrong with them, cycles aside.

    Errors are kind (not umbrella or implementation), parent_of_umbrella, parent (unknown), dependency (unknown) and
    phase (not after a dependency's).
    """
    c = F.col
    known = changes.select(c("name").alias("_known"), c("phase").alias("_phase"))
    error = lambda rows, what, about: rows.select("name", F.lit(what).alias("error"), F.coalesce(about, F.lit("")).alias("about"))
    umbrella = F.coalesce(c("kind") == "umbrella", F.lit(False))
    implementation = F.coalesce(c("kind") == "implementation", F.lit(False))
    kinds = error(changes.where(~umbrella & ~implementation), "kind", c("kind"))
    childish = error(changes.where(umbrella & (F.coalesce("parent", F.lit("")) != "")), "parent_of_umbrella", c("parent"))
    orphans = error(changes.where(implementation & (F.coalesce("parent", F.lit("")) != "")).join(known, c("parent") == c("_known"), "left_anti"), "parent", c("parent"))
    needs = changes.select("name", "phase", F.explode("depends_on").alias("dependency")).join(known, c("dependency") == c("_known"), "left")
    dangling = error(needs.where("_known is null"), "dependency", c("dependency"))
    early = error(needs.where("_known is not null and phase <= _phase"), "phase", c("dependency"))
    return kinds.unionByName(childish).unionByName(orphans).unionByName(dangling).unionByName(early)


def blocked_by(changes: DataFrame) -> DataFrame:
    """(name, blocks): the changes that depend on a known change, sorted."""
    needs = changes.select("name", F.explode("depends_on").alias("dependency"))
    held = needs.join(changes.select(F.col("name").alias("dependency")), "dependency", "left_semi")
    return held.groupBy(F.col("dependency").alias("name")).agg(F.array_sort(F.collect_list("name")).alias("blocks"))
