"""The Jaccard join against all pairs by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cliploom.llm import ngram_join
from cliploom.llm.shingles import shingle_sets

from .conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            common = len(x & y)
            if i != j and x and y and 100 * common >= 75 * len(x | y):
                links.add((min(i, j), max(i, j)))
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}, {i: len(s) for i, s in sets}, links


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 8, 40, 120, 400]))]
        for _ in range(rnd.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rnd.randrange(0, 1 + len(own) // 40)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append(own)
            rows += [own] * rnd.choice([0, 0, 3])
    rows += [passage + [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 30))] for _ in range(40)]
    return [(i, " ".join(x if rnd.random() < 0.9 else x.upper() for x in w)) for i, w in enumerate(rows)]


def test_against_brute_force(docs_of, corpus):
    rows = corpus + [(9001, None), (9002, ""), (9003, " \n")]
    want, sizes, links = brute(rows)
    out, found = ngram_join.join(docs_of(rows), sketch_bits=16)
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    names = {}
    for i, r in got.items():
        names.setdefault(r["class"], set()).add(i)
    for a, b in found.collect():
        i, j = min(names[a]), min(names[b])
        assert (min(i, j), max(i, j)) in links
    assert any(i != c for i, c in want.items()) and len(links) > 50


def test_every_link(docs_of, corpus):
    want, _, links = brute(corpus)
    out, found = ngram_join.join(docs_of(corpus), sketch_bits=16)
    names = {}
    for r in out.collect():
        names.setdefault(r["class"], []).append(r.doc_id)
    pairs = found.collect()
    between = {(min(i, j), max(i, j)) for a, b in pairs for i in names[a] for j in names[b]}
    equal = {(i, j) for ids in names.values() for i in ids for j in ids if i < j}
    assert between | equal == links and len(pairs) == len(set(pairs)) and not between & equal
    # The shortcut of the digest has the same components.
    assert {r.doc_id: r.component_id for r in ngram_join.digest(docs_of(corpus)).collect()} == want


def test_hot_lists_and_turns(docs_of, corpus, monkeypatch):
    """Lists dealt by class, and turns that go on to the last pair."""
    want, _, _ = brute(corpus)
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 0)
    monkeypatch.setattr(ngram_join, "HEADS", 2)
    assert {r.doc_id: r.component_id for r in ngram_join.digest(docs_of(corpus), hot_classes=3).collect()} == want


def test_keep_one(docs_of, corpus):
    want, _, _ = brute(corpus)
    docs = docs_of(corpus + [(None, "no id"), (0, corpus[0][1])])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_edges(edges, empty, docs_of):
    rows = ngram_join.digest(edges).collect()
    assert len(rows) == len(EDGES) and all(r.component_id == r.doc_id for r in rows) and {r.n_shingles for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert ngram_join.digest(empty).count() == 0
    # Rows that share an id are one node, whatever their texts.
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = {(r.doc_id, r.component_id) for r in ngram_join.digest(docs_of([(5, a), (5, b), (3, b), (8, a)])).collect()}
    assert got == {(5, 3), (3, 3), (8, 3)}


def test_shingle_sets_are_stable():
    texts = [b"A b c d E f", b"a B C D e F", b"", b"\xc3\x89 a", None, b"x " * 50_000]
    one = [s.tolist() for s in shingle_sets(texts, 5)]
    assert one[0] == one[1] and len(one[0]) == 2 and one[2] == one[4] == [] and len(one[3]) == 1 and len(one[5]) == 1
    assert one == [s.tolist() for t in texts for s in shingle_sets([t], 5)]


def test_ids_of_any_type(spark, docs_of):
    texts = [" ".join(f"w{(i // 3) * 100 + j}" for j in range(40)) + (" more" if i % 3 == 2 else "") for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(20, None), (None, texts[0])]
    plain = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.digest(docs_of(rows)).collect()}
    name = lambda i: None if i is None else f"d{i:02d}"
    named = docs_of(rows).withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.format_string("d%02d", "doc_id")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.digest(named).collect()}
    assert got == {name(i): (n, name(c)) for i, (n, c) in plain.items()} and plain[2][1] == 0
    kept = {r.doc_id for r in ngram_join.keep_one(named).collect()}
    assert kept == {name(r.doc_id) for r in ngram_join.keep_one(docs_of(rows)).collect()} and "d01" not in kept
