"""Collocations: brute force under small limits, filters that thin out, edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cliploom.llm import collocations

from .conftest import EDGES

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count, share=80, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        covered = set()
        for p, b in candidates.items():
            inner = {p[i : i + m] for m in range(2, len(p)) for i in range(len(p) - m + 1)}
            covered |= {q for q in inner if 100 * b >= share * f[q]}
        found = []
        for p, a in candidates.items():
            if p not in covered:
                score, cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed=1, n=400):
    rnd = random.Random(seed)
    fixed = ["New York City", "a b a b", "x x x x", "é ü ñ ç", "The\tquick fox now", "one-two three"]
    words = ["the", "of", "É", "zz", "a", "b", "x", "K", "\x1cq", "10%"]
    rows = []
    for i in range(n):
        bits = [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(words) for _ in range(rnd.randrange(0, 30))]
        rows.append((rnd.choice(["en", "en", "de", None, "und"]), "".join(b + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\n", "? "]) for b in bits) if i % 19 else None))
    return rows


@pytest.mark.parametrize(("limits", "bits"), [({}, None), ({"CHUNK_BYTES": 200, "HELD_PHRASES": 5, "BLOCK": 16}, 5), ({"BLOCK": 8}, 10)])
def test_brute(spark, monkeypatch, limits, bits):
    for name, value in limits.items():
        monkeypatch.setattr(collocations, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, text string, phrase string, rank int, n long").repartition(5)
    for least in (30, 4):
        got = collocations.mined(docs, min_count=least, bits=bits).collect()
        assert sorted(map(tuple, got)) == brute(rows, least)


def test_top_and_cover(spark):
    rows = [("en", "p q r. " * 40 + "p q. " * 11), ("en", "q r " * 50)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for share, top in ((80, 2000), (70, 2000), (100, 1)):
        got = collocations.mined(docs, share=share, top=top).collect()
        assert sorted(map(tuple, got)) == brute(rows, 30, share, top)


def test_filters(spark):
    """Buckets and known parts leave few phrases to count exactly, and leave out none that is frequent."""
    rnd = random.Random(3)
    rows = [("en", " ".join(f"w{rnd.randrange(3000)}" for _ in range(200)) + " same four words here" * 2) for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    texts = docs.select("lang", "text")
    first = texts.mapInArrow(collocations._passed(1, 16, None, None, False), collocations._ROWS)
    frequent = first.where("block is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where("f >= 30")
    buckets = collocations._bitmap(first.where("block is not null"), 16, 30)
    known = collocations._bitmap(frequent.select("lang", F.col("phrase").cast("string")).mapInArrow(collocations._hashed_phrases(1, 16), collocations._ROWS), 16, 1)
    second = texts.mapInArrow(collocations._passed(2, 16, known, buckets, True), collocations._ROWS).where("block is null").groupBy("phrase").agg(F.sum("n").alias("f")).collect()
    assert {bytes(r.phrase): r.f for r in second if r.f >= 30} == {b"same four": 400, b"four words": 400, b"words here": 400, b"here same": 200} and len(second) < 500


def test_edges(edges, empty, docs_of):
    assert collocations.mined(empty).count() == 0
    got = collocations.mined(edges, min_count=2).collect()
    assert sorted(map(tuple, got)) == brute([("en", t) for _, t in EDGES], 2)
    with pytest.raises(ValueError):
        collocations.mined(edges, min_count=300)
