"""Source divergence: tries, exact shares, brute force and edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cliploom.llm import divergence

from .conftest import EDGES, LONG


def test_trie():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 7))).encode() for _ in range(3000)]
    whole, one, two = divergence.Trie(), divergence.Trie(), divergence.Trie()
    want = defaultdict(Counter)
    for i, w in enumerate(words):
        for trie in (whole, (one, two)[i % 2]):
            trie.add(np.array([trie.leaf(w)] * 2), np.array([trie.source(f"s{i % 3}"), 0]), np.array([1, 1]))
        want[w][f"s{i % 3}"] += 1
    one.merge(two)
    for trie in (whole, one):
        assert [t for t, _ in trie.leaves()] == sorted(want) and trie.size == len(want)
        got = [r for b in trie.rows("x") for r in b.to_pylist()]
        assert [r["term"] for r in got] == sorted(want) and trie.counters == sum(len(c) + 1 for c in want.values())
        assert all(dict(zip(r["sources"], r["counts"], strict=True)) == want[r["term"]] and r["docs"] == want[r["term"]].total() for r in got)
        assert {r["term"] for b in trie.rows("x", 3) for r in b.to_pylist()} == {w for w, c in want.items() if c.total() >= 3}


def test_shares():
    counts, totals = [0, 2, 10**12, 7, 5 * 10**15], [3, 2, 9 * 10**15, 10**9 + 7, 5 * 10**15 + 1]
    assert divergence.shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * c // n for c, n in zip(counts, totals, strict=True)]
    p, q = np.array([10**9 + 1, 5]), np.array([1, 5])
    assert divergence.divergence(p, q).tolist() == [10**18 // (10**9 + 2), 0]


def brute(rows):
    """Rows of (lang, source, text)."""
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t in seen if seen[t] >= 10), key=str.encode)
        counts = defaultdict(Counter)
        for _, source, ws in own:
            counts[source].update(w for w in ws if seen[w] >= 10)
        total = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (total[t] + 2) // (total.total() + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            marks = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(marks)[:10])):
                out |= {(lang, s, part, item, -value, i) for i, (value, _, item) in enumerate(found, 1)}
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    pool = [f"{a}{b}{c}" for a in ("The", "É", "𝒳", "x_") for b in "abc" for c in ("", "Q", "ü", "7z")]
    out = []
    for i in range(300):
        source = rnd.choice(["a", "b", "é", None, "ab", "hot", "hot", "hot"])
        out.append((rnd.choice(["en", "en", "de", None]), source, " ".join(rnd.choice(pool[hash(source or "") % 3 :: 2] if i % 2 else pool) for _ in range(rnd.randrange(0, 40)))))
    return [*out, ("xx", "one", "rare words only"), ("xx", "two", None), ("yy", "alone", "nothing"), *[("en", "hot", "same copy of text")] * 50]


@pytest.mark.parametrize("limits", [{}, {"TRIE_COUNTERS": 40, "TRIE_LEAVES": 9, "TEXT_BYTES": 300, "BLOCK_TERMS": 7, "_ROWS": 3}])
def test_brute(spark, monkeypatch, rows, limits):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame([(*r, 1, "v", "x") for r in rows], "lang string, source string, text string, rank int, value string, block string").repartition(7)
    got = divergence.audit(docs, tile=2 if limits else 64).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_edges(edges, empty):
    assert divergence.audit(empty).count() == 0
    assert divergence.audit(edges).count() == 0  # one source, no term in ten documents
    got = {r.item: r for r in divergence.audit(edges, min_docs=1).collect()}
    assert not any(r.part == "pair" for r in got.values()) and not got  # of one source every p equals its language's
    assert max(map(len, divergence.terms(LONG.encode()))) >= 1 and divergence.terms(None) == [] and len(EDGES) == 9
