"""Sharding: the permutation, its inverse, the law, and edge cases."""

import zlib

import numpy as np
import pytest

from cliploom.llm import sharding

from .conftest import EDGES


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4096, 70_001])
def test_permutation(n):
    rows = np.arange(n)
    places = sharding.permuted(rows, n)
    assert sorted(places) == list(rows) and (sharding.row_at(places, n) == rows).all()
    if n > 100:
        assert (places == rows).mean() < 0.05 and (places != sharding.permuted(rows, n, seed=99)).mean() > 0.9
        assert abs(np.corrcoef(rows, places)[0, 1]) < 0.1


def test_wide_numbers():
    n = 3 * 10**15
    rows = np.array([0, 1, 2, n - 1, n // 2, 10**15])
    places = sharding.permuted(rows, n)
    assert len(set(places)) == len(rows) and places.max() < n and (sharding.row_at(places, n) == rows).all()


def checked(rows, got, shards=sharding.SHARDS):
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted(repr((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in rows)
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in got) == want


def test_sharded(spark, docs_of):
    rows = [(i, f"text {i} é") for i in range(500)] + [(7, "hot")] * 300 + [(None, None)] * 40 + [(7, "other")]
    docs = docs_of(rows)
    got = sharding.sharded(docs).collect()
    checked(rows, got)
    assert sorted(r.row for r in got) == list(range(len(rows)))
    # Numbers follow the order of the rows; other partitions change nothing.
    by_row = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in sorted(got, key=lambda r: r.row)]
    assert by_row == sorted(by_row)
    again = sharding.sharded(docs.repartition(9)).collect()
    assert sorted(repr(tuple(r)) for r in again) == sorted(repr(tuple(r)) for r in got)
    # A shard is known without the table.
    held = {(r.slot, r.row) for r in got if r.shard == 5}
    assert {tuple(r) for r in sharding.shard_rows(spark, len(rows), 5).collect()} == held


def test_edges(edges, empty, docs_of, spark):
    checked(EDGES, sharding.sharded(edges).collect())
    assert sharding.digest(empty).count() == 0 and sharding.shard_rows(spark, 3, 5).count() == 0
    assert sharding.digest(edges).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    texts = spark.createDataFrame([("b", "x"), ("a", None)], "doc_id string, text string")
    assert {r.doc_id: r.row for r in sharding.sharded(texts).collect()} == {"a": 0, "b": 1}
