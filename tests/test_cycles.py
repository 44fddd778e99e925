"""Strong components and cycles, in one task and by colours."""

import random

import pytest
from pyspark.sql import functions as F

from cliploom.operators import graph


def reach(edges, nodes):
    out = {v: set() for v in nodes}
    for v in nodes:
        todo = [v]
        while todo:
            for w in edges.get(todo.pop(), ()):
                if w not in out[v]:
                    out[v].add(w)
                    todo.append(w)
    return out


@pytest.mark.parametrize("task_edges", [graph.TASK_EDGES, 12])
def test_cycles(spark, task_edges):
    rnd = random.Random(7)
    pairs = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(62)} | {(70, 70), (80, 81), (81, 82), (82, 80), (82, 83), (83, 84)}
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    nodes = {x for p in pairs for x in p}
    far = reach(after, nodes)
    component = {v: min(w for w in far[v] if v in far[w]) for v in nodes if v in far[v]}
    frame = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}") for a, b in pairs], "before string, after string").repartition(3)
    got = {int(r.node[1:]): r for r in graph.cycles(frame, task_edges).collect()}
    assert {v: int(r.component[1:]) for v, r in got.items()} == component
    step = {v: min(w for w in after[v] if component.get(w) == component[v]) for v in component}
    for v, r in got.items():
        seen, w = [], v
        while w not in seen:
            seen.append(w)
            w = step[w]
        assert int(r.next_node[1:]) == step[v] and r.on_cycle == (w == v) and r["size"] == sum(c == component[v] for c in component.values())
    held = {int(r.node[1:]) for r in graph.held_up(frame, task_edges).collect()}
    assert held == set(component) | {w for v in component for w in far[v]} and {83, 84} <= held


def test_no_cycles(spark):
    frame = spark.createDataFrame([(i, i + 1) for i in range(14)], "before long, after long")
    for few in (graph.TASK_EDGES, 5):
        assert graph.cycles(frame, few).count() == 0 and graph.strong_components(frame.where("false"), few).count() == 0
    assert graph.acyclic(frame)[0]


def test_nodes_are_not_broadcast(spark):
    """Files of nodes are small and hold very many rows, which a broadcast would send through the driver."""
    n = F.col("id")
    edges = spark.range(300).select(n.alias("before"), F.when(n % 3 == 2, n - 2).otherwise(n + 1).alias("after"))
    found = graph.cycles(edges)
    assert found.where("on_cycle").count() == 300
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
