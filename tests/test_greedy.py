"""Greedy suppression: edges in rounds and stretches, ranges in steps, against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from cliploom.operators import dedup, greedy, intervals


def kept_by_edges(n, edges):
    earlier = {}
    for a, b in edges:
        earlier.setdefault(b, set()).add(a)
    out = set()
    for x in range(n):
        if not earlier.get(x, set()) & (set(range(n)) - out):
            continue
        if any(a not in out for a in earlier[x]):
            out.add(x)
    return out


@pytest.mark.parametrize("task_edges", [greedy.TASK_EDGES, 40])
def test_settled(spark, task_edges):
    rnd = random.Random(5)
    groups = {"sparse": [(a, b) for a in range(80) for b in range(a + 1, 80) if rnd.random() < 0.05], "dense": [(a, b) for a in range(30) for b in range(a + 1, 30) if rnd.random() < 0.7], "chain": [(a, a + 1) for a in range(150)], "one": [(3, 9)]}
    edges = spark.createDataFrame([(g, a, b) for g, e in groups.items() for a, b in e], "group string, before long, after long").repartition(5)
    got = {}
    for r in greedy.settled(edges, task_edges).collect():
        got.setdefault(r.group, set()).add(r.place)
    for g, e in groups.items():
        assert got[g] == kept_by_edges(151, e), g
    assert greedy.settled(edges.where("false"), task_edges).count() == 0


def ratio(a, b):
    overlap = min(a[1], b[1]) - max(a[0], b[0])
    return overlap / min(a[1] - a[0], b[1] - b[0]) if overlap > 0 else 0.0


@pytest.mark.parametrize(("first", "edges"), [(greedy.FIRST_ROWS, 1000), (7, 1000), (7, 5), (1, 1000)])
@pytest.mark.parametrize("limit", [None, 4])
def test_kept_apart(spark, first, edges, limit):
    rnd = random.Random(first)
    rows = [(k, rnd.random(), i, round(a := rnd.uniform(0, 12 if k < 2 else 900), 3), round(a + rnd.uniform(0.2, 30 if i % 9 == 0 else 4), 3)) for k, n in enumerate((90, 40, 120, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, r double, i int, s double, e double").repartition(4)
    got = sorted((r.k, r.i) for r in greedy.kept_apart(df, "k", ["r", "i"], "s", "e", 0.7, limit, first_rows=first, task_edges=edges).collect())
    want = []
    for k in range(4):
        kept = []
        for _, r, i, s, e in sorted(x for x in rows if x[0] == k):
            if all(ratio(x[1], (s, e)) < 0.7 for x in kept) and (limit is None or len(kept) < limit):
                kept.append((i, (s, e)))
        want += [(k, i) for i, _ in kept]
    assert got == sorted(want)


def test_large_group(spark):
    """A group of many rows, dense in one place and sparse elsewhere, by the default limits."""
    n = 12_000
    rows = spark.range(n).selectExpr("1 as k", "id", "cast(case when id % 2 = 0 then (id * 7919 % 3000) / 1000.0 else id * 3.5 end as double) as s").selectExpr("k", "id", "s", "s + 2 + id % 13 / 16 as e")
    got = {r.id for r in greedy.kept_apart(rows, "k", ["id"], "s", "e", 0.9).collect()}
    kept, cells = set(), {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        near = [x for c in range(int(r.s) - 4, int(r.e) + 1) for x in cells.get(c, ())]
        if all(ratio(x, (r.s, r.e)) < 0.9 for x in near):
            kept.add(r.id)
            cells.setdefault(int(r.s), []).append((r.s, r.e))
    assert got == kept and len(kept) < n


def test_leaders(spark):
    rnd = random.Random(8)
    items = [(g, i, rnd.choice([1.0, 2.0, 3.0])) for g in (1, 2, 3) for i in range(40)]
    pairs = [(g, a, b, rnd.random()) for g in (1, 2, 3) for a in range(40) for b in range(40) if a != b and rnd.random() < 0.2]
    got = dedup.leaders(spark.createDataFrame(items, "g int, i int, score double"), spark.createDataFrame(pairs, "g int, a int, b int, similarity double"), "g", "i", "score", 0.5).collect()
    near = {(g, a, b) for g, a, b, s in pairs if s >= 0.5}
    for g in (1, 2, 3):
        order, leader, heads = [i for _, i, _ in sorted((x for x in items if x[0] == g), key=lambda x: (-x[2], x[1]))], {}, []
        for lead in order:
            if lead not in leader:
                heads.append(lead)
                leader[lead] = lead
                for other in order:
                    if other not in leader and (g, lead, other) in near:
                        leader[other] = lead
        assert {(r.i, r.leader, r.dedup_group, r.deduplicated) for r in got if r.g == g} == {(i, x, heads.index(x), i != x) for i, x in leader.items()}


def test_seed_regions(spark):
    """The first of equal ranges stays; seeds under a second stay; no frames, no peaks; nothing at all, the whole clip."""
    clips = spark.createDataFrame([(1, 44.0), (2, 44.0), (3, 0.4), (4, 20.0)], "asset_id int, duration_sec double")
    scenes = spark.createDataFrame([(1, 0, 0.0, 5.5), (1, 1, 30.0, 30.4), (2, 0, 0.0, 5.5), (4, 0, 25.0, 30.0)], "asset_id int, pos int, start_sec double, end_sec double")
    seen = spark.createDataFrame([(1, 0.0, 5.5), (2, 10.0, 15.5)], "asset_id int, start_sec double, end_sec double")
    heard = spark.createDataFrame([(1, 20.0, 20.5), (2, 7.0, 8.0)], "asset_id int, start_sec double, end_sec double")
    got = intervals.seed_regions(scenes, seen, heard, clips, framed=clips.where("asset_id <> 2")).collect()
    assert sorted(map(tuple, got)) == [(1, 0.0, 5.5, "scene", 0.55), (1, 20.0, 20.5, "audio-peak", 0.68), (2, 0.0, 5.5, "scene", 0.55), (3, 0.0, 0.4, "fallback", 0.3), (4, 0.0, 20.0, "fallback", 0.3)]


def test_short_groups_are_read_once(spark):
    """Without a long group nothing is ordered by windows: rows are written, counted by key and folded."""
    rows = spark.range(400).select((F.col("id") % 40).alias("k"), F.col("id").alias("n"), (F.col("id") / 40).alias("a"), (F.col("id") / 40 + 2).alias("b"))
    kept = greedy.kept_apart(rows, "k", ["n"], "a", "b", 0.5)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Range (" not in plan and plan.count("Relation") == 1
    longer = greedy.kept_apart(rows, "k", ["n"], "a", "b", 0.5, first_rows=3)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, longer.collect()))
