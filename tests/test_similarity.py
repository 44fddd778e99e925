"""Threshold joins of histograms and vectors against all pairs."""

import pathlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cliploom.operators import dedup
from cliploom.operators.graph import least_reached
from cliploom.sources.scratch import shared_folder


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.85, 1.0])
def test_histogram_join(spark, threshold):
    rnd = random.Random(4)
    rows = []
    for g in (1, 2):
        for i in range(60):
            base = rnd.randrange(5) * 7
            weights = {base + rnd.randrange(6): rnd.randrange(1, 90) for _ in range(rnd.randrange(1, 6))} | {99: rnd.choice([1, 5, 300])}
            rows += [(g, i, b, w) for b, w in weights.items()]
        rows += [(g, 100, b, w) for gg, i, b, w in rows if gg == g and i == 3] + [(g, 101, 55, 0)]
    bins = spark.createDataFrame(rows, "g int, i int, bin int, weight long").repartition(3)
    every = dedup.intersections(bins, "g", "i").where(f"similarity >= {threshold}")
    pruned = dedup.intersections(bins, "g", "i", threshold)
    assert pruned.columns == every.columns
    want = sorted(map(tuple, every.collect()))
    assert sorted(map(tuple, pruned.collect())) == want and any(r[1:3] == (3, 100) for r in want)


def test_shared_bin_makes_no_pairs(spark):
    """A bin that all hold with a little mass leaves no pair to verify."""
    rows = [(1, i, 0, 10) for i in range(300)] + [(1, i, 1 + i, 90) for i in range(300)]
    found = dedup.intersections(spark.createDataFrame(rows, "g int, i int, bin int, weight long"), "g", "i", 0.5)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def planted(n, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 3
    v = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * rng.choice([0.05, 0.3, 2.0], n)[:, None]
    v[1], v[2] = v[0] * 5, 0  # one direction, no length
    return v


@pytest.mark.parametrize(("threshold", "cell", "block"), [(0.95, 20, 4000), (0.95, 20, 7), (0.5, 30, 50), (0.99, 1000, 4000), (-1.0, 40, 30)])
def test_vector_pairs(spark, threshold, cell, block):
    v = planted(260)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>").repartition(5)
    got = dedup.vector_pairs(df, "id", "v", threshold, cell_vectors=cell, block_vectors=block).collect()
    length = np.linalg.norm(v, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = np.floor((v @ v.T) / np.outer(length, length) * 1e6 + 0.5) / 1e6
    want = {(i, j) for i in range(260) for j in range(i + 1, 260) if 2 not in (i, j) and cosine[i, j] >= threshold}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and (0, 1) in want
    assert all(abs(r.cosine - cosine[r.a, r.b]) < 2e-6 for r in got)


def test_vector_cells_are_pruned(spark):
    n = 400
    df = spark.createDataFrame([(f"x{i}", x.tolist()) for i, x in enumerate(planted(n))], "id string, v array<double>")
    own, guests = dedup.vector_cells(df, "id", "v", 0.95, cell_vectors=20)
    cells = own.select("cell").distinct().count()
    # All to all would be half of n x cells copies.
    assert own.count() == n - 1 and cells > 5 and guests.count() < n * cells / 6
    assert dedup.vector_pairs(df.where("false"), "id", "v").count() == 0
    assert dedup.vector_pairs(df, "id", "v", 0.95, cell_vectors=20).where("a >= b").count() == 0


def test_any_similarity(spark):
    items = spark.createDataFrame([(1, "a", 3.0, 10), (1, "b", 2.0, 11), (1, "c", 1.0, 30), (2, "d", 1.0, 10)], "g int, i string, score double, tone int")
    near = dedup.compared(items, "g", "i", lambda x, y: 1 / (1 + F.abs(x["tone"] - y["tone"])))
    got = {r.i: (r.leader, r.deduplicated) for r in dedup.leaders(items, near, "g", "i", "score", 0.5).collect()}
    assert got == {"a": ("a", False), "b": ("a", True), "c": ("c", False), "d": ("d", False)}


def test_vector_batches_are_bounded():
    """At wide angles every vector goes to every cell, and of equal vectors all pairs count: neither is made at once."""
    v = np.eye(64)[np.arange(3_000) % 64]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3_000)), pa.array(v.tolist()), pa.array([63] * 3_000, pa.int32()), pa.array([0.0] * 3_000)], names=["item", "v", "cell", "angle"])
    copies = list(dedup._guests(np.eye(64), np.full(64, 4.0), 4.0)(iter([batch])))
    assert sum(b.num_rows for b in copies) == 3_000 * 63 and max(b.num_rows for b in copies) <= dedup.MOST_COPIES
    block = pa.RecordBatch.from_arrays([pa.array(range(3_000)), pa.array(np.ones((3_000, 4)).tolist()), *(pa.array([0] * 3_000, pa.int32()) for _ in range(4))], names=["item", "v", "cell", "block", "lo", "hi"])
    pairs = list(dedup._block_pairs(0.9)(iter([block])))
    assert sum(b.num_rows for b in pairs) == 3_000 * 2_999 // 2 and max(b.num_rows for b in pairs) <= dedup.MOST_PAIRS


def held(folder):
    return sum(f.stat().st_size for f in pathlib.Path(folder.removeprefix("file:")).rglob("*") if f.is_file())


def wide(spark, n, dims=16):
    v = np.random.default_rng(7).normal(size=(n, dims))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")


def test_wide_angles_write_no_copies(spark):
    """Of vectors that all cells could meet, what is kept grows with the vectors and not with their cells."""
    n = 1_200
    df = wide(spark, n)
    folder = shared_folder(spark)
    before = held(folder)
    found = dedup.vector_pairs(df, "id", "v", 0.4, cell_vectors=20, block_vectors=100)
    # Vectors of 16 doubles: some 200 bytes a row; copies for half of 60 cells would be 30 times as much.
    assert held(folder) - before < 6 * 200 * n
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    u = np.array([r.v for r in df.orderBy("id").collect()])
    u /= np.linalg.norm(u, axis=1)[:, None]
    cosine = np.floor(u @ u.T * 1e6 + 0.5) / 1e6
    want = {(i, j) for i, j in np.argwhere(cosine >= 0.4).tolist() if i < j}
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("threshold", "task", "name"), [(0.4, 30, "int"), (0.97, 40, "string"), (0.9999, 15, "int")])
def test_vector_links(spark, threshold, task, name):
    """The components of all pairs from edges that are fewer than the vectors, in several parts."""
    v = planted(260)
    df = spark.createDataFrame([(i + 100, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>").withColumn("id", F.col("id").cast(name)).repartition(3)
    links = [(int(r.a) - 100, int(r.b) - 100) for r in dedup.vector_links(df, "id", "v", threshold, block_vectors=7, task_vectors=task).collect()]
    length = np.linalg.norm(v, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = np.floor((v @ v.T) / np.outer(length, length) * 1e6 + 0.5) / 1e6
    pairs = np.argwhere(np.triu(cosine >= threshold, 1))
    want = least_reached(*pairs.T, 260)
    assert len(links) < 260 and (least_reached(*np.array(links).T, 260) == want).all()
    assert len(links) < len(pairs) / 10 or threshold > 0.4
    assert len({*want.tolist()}) > 12 or threshold < 0.97


def test_vector_links_of_copies_and_of_none(spark):
    copies = spark.createDataFrame([(i, [1.0, float(i % 3 == 0)]) for i in range(300)] + [(300, [-1.0, 0.0]), (301, [0.0, 0.0]), (302, [float("nan"), 1.0]), (None, [1.0, 0.0])], "id int, v array<double>")
    links = dedup.vector_links(copies, "id", "v", 0.9, block_vectors=20, task_vectors=40)
    # 100 and 200 equal vectors, linked as two stars; no other vector has a partner.
    root = least_reached(*np.array(links.collect()).T, 302)
    assert links.count() == 298 and root.tolist() == [int(i % 3 > 0) for i in range(300)] + [300, 301]
    assert dedup.vector_links(copies.where("false"), "id", "v", 0.9).count() == 0
    assert dedup.vector_links(copies.where("id >= 299"), "id", "v", 0.9).count() == 0
