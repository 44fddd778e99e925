"""Toxicity, HTML extraction, decontamination, token counts and quality rules."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cliploom.llm import decontaminate, html_extract, quality, token_counts, toxicity
from cliploom.llm.columns import segments, spans, text_of, unmarked

from .conftest import EDGES

FOLD = {c: c + 32 for c in range(65, 91)}


def test_decontamination(spark, docs_of):
    rnd = random.Random(3)
    items = [(i, " ".join(f"Q{rnd.randrange(60)}," for _ in range(rnd.choice([0, 3, 10, 25])))) for i in range(12)] + [(None, "null id words go here and on"), (77, None)]
    rows = []
    for i in range(80):
        w = [f"q{rnd.randrange(60)}" for _ in range(rnd.randrange(0, 60))]
        if i % 3 == 0:
            part = items[rnd.randrange(12)][1].split()
            k = rnd.randrange(0, 1 + max(0, len(part) - 12))
            w[5:5] = part[k : k + 12]
        rows.append((i, ("é😀 " if i % 5 == 0 else "") + "; ".join(w)))
    rows.append((500, None))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = [(str(i) if i is not None else "", w[k : k + 10]) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - 9) if w else 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(rows)
    one = {r.doc_id: r for r in decontaminate.digest(docs, bench).collect()}
    spanned = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    for i, t in rows:
        own, hit, names = words(t), set(), set()
        for name, w in windows:
            for k in range(len(own) - len(w) + 1):
                if own[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    names.add(name)
        told = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (one[i].n_words, one[i].n_hit, one[i].n_items, one[i].items_sha256, one[i].contaminated) == (len(own), len(hit), len(names), told, bool(hit))
        assert sum(len(words(t[s.start : s.end])) for s in spanned[i].spans) == len(hit)
    blocks = decontaminate.digest(docs, bench, block_chars=200).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, one.values()))
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in one.items() if not r.contaminated}
    assert sorted(map(repr, decontaminate.clean(docs, bench, block_chars=200).collect())) == sorted(map(repr, kept.collect()))
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id: r.n_hit for r in decontaminate.digest(named, bench).collect()} == {f"d{i}": r.n_hit for i, r in one.items()}


def test_decontamination_edges(spark, edges, empty):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.digest(edges, bench).collect()}
    assert got[4].contaminated and not got[1].contaminated and got[6].n_words == 60_000
    assert decontaminate.digest(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.digest(edges, bench.where("false")).collect())


def test_quality_counts(docs_of):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice(["a ", "b ", "c ", "#", "\n", "d. ", "| ", "é\t", "!\x0b"]) for _ in range(rnd.randrange(0, 300)))) for i in range(120)] + [(500, None)]
    got = {r.doc_id: r for r in quality.digest(docs_of(rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and (r.kept <= (not r.base_failed))


def test_quality_verdicts(docs_of, spark, sf_dir):
    rnd = random.Random(12)
    prose = "\n".join(" ".join(f"word{rnd.randrange(500)}" for _ in range(9)) + ", so it ends." for _ in range(12))
    rows = [(1, prose), (2, prose + "\nHome | About | Contact\nAll rights reserved."), (3, "\n".join(f"Home{i} | About{i} | Contact{i} | More{i}" for i in range(30)))]
    docs = docs_of(rows)
    assert {r.doc_id: r.kept for r in quality.digest(docs).collect()} == {1: True, 2: True, 3: False}
    clean = quality.clean(docs)
    assert clean.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {1: (prose, len(prose)), 2: (prose, len(prose))}
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.digest(real).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in judged) >= 0.95 * len(judged)


def test_quality_edges(edges, empty):
    assert quality.digest(edges).count() == len(EDGES) and quality.digest(empty).count() == 0 and quality.clean(empty).count() == 0
    assert not any(r.kept for r in quality.digest(edges).collect() if r.doc_id != 6)


def test_token_counts_after_random_edits():
    with open(token_counts.VOCABULARY, "rb") as f:
        counter = token_counts.Counter(f.read())
    rnd = random.Random(5)
    letters = "ab 'l ve\n\t1,.éß  s😀"
    text_of_ = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    for _ in range(400):
        tree = token_counts.Tree(counter, text_of_(rnd.randrange(0, 600)))
        for _ in range(5):
            a = rnd.randrange(0, len(tree.text) + 1)
            tree.edit(a, a + rnd.choice([0, 1, 40]), text_of_(rnd.choice([0, 1, 90])))
            assert tree.total == len(counter.encoding.encode_ordinary(tree.text)) and tree.pieces == len(counter.pattern.findall(tree.text))
            if rnd.random() < 0.3:  # stored and read again
                tree = token_counts.Tree(counter, tree.text, tree.leaves)
    # Blocks of one sort of characters, and edits at their borders.
    for unit in ("a", " ", "\n ", "1,", "ab "):
        tree = token_counts.Tree(counter, unit * 3_000)
        for k in (0, 1, 64, 128, 2_999, 3_000):
            tree.edit(k, k + 64, "x")
            assert tree.total == len(counter.encoding.encode_ordinary(tree.text))
        tree.edit(0, 10**6, "")
        assert (tree.total, tree.text, tree.leaves) == (0, "", [])
    long = token_counts.Tree(counter, text_of_(60_000))
    before = long.encoded
    long.edit(30_000, 30_005, "edited")
    assert long.total == len(counter.encoding.encode_ordinary(long.text)) and long.encoded - before < 200
    with pytest.raises(ValueError):
        token_counts.apply_edits(long, [(0, 5, "x"), (3, 8, "y")])


def test_token_counts_query(docs_of, edges, empty):
    rows = [(1, "call 12345678 and 999999 now"), (2, "nothing here"), (3, None), (4, "")]
    found = spans(segments(unmarked(text_of()), r"[0-9]{6,}"))
    got = {r.doc_id: r for r in token_counts.digest(docs_of(rows), found, "0").collect()}
    with open(token_counts.VOCABULARY, "rb") as f:
        counter = token_counts.Counter(f.read())
    for i, t in rows:
        plain, edited = (len(counter.encoding.encode_ordinary(x)) for x in (t or "", re.sub(r"[0-9]{6,}", "0", t or "")))
        assert (got[i].n_tokens, got[i].n_tokens_after) == (plain, edited)
    assert got[1].n_edits == 2 and 0 < got[1].n_reencoded
    # Trees go on from call to call; nothing is encoded for texts without edits, and a missing tree gives nulls.
    docs = docs_of(rows)
    first = token_counts.recount(docs, token_counts.grow(docs), F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("0").alias("new"))))
    edited = docs_of([(i, re.sub(r"[0-9]{6,}", "0", t) if t else t) for i, t in rows])
    trees = first.join(edited.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")), "doc_id").select("doc_id", "text_hash", "tree")
    more = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("Say ").alias("new")))
    second = {r.doc_id: r for r in token_counts.recount(edited, trees, F.when(F.col("doc_id") < 3, more)).collect()}
    for i, t in rows:
        plain = re.sub(r"[0-9]{6,}", "0", t or "")
        after = "Say " + plain[2:] if i < 3 else plain
        assert (second[i].n_tokens, second[i].n_tokens_after) == tuple(len(counter.encoding.encode_ordinary(x)) for x in (plain, after)) and (second[i].n_reencoded > 0) == (i < 3)
    assert {r.n_tokens for r in token_counts.recount(docs, trees.where("false"), F.lit(None)).collect()} == {None}
    assert token_counts.digest(edges, found, "0").count() == len(EDGES) and token_counts.digest(empty, found, "0").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="side-bar">Links</div>%s<form><input value="x"><p>Search</p></form>
<section id="comments"><p>First!</p></section><footer>&copy; Us</footer><script>var t="</p>";</script></body></html>"""


def test_html():
    article = "<article><h1>A &amp; B</h1><p><b>One\n two<br>three<p>Caf&eacute;&nbsp;x<ul><li>i<li>ii</ul><aside>ad</aside><div class='share'>Share</div></article>"
    assert html_extract.main_text(PAGE % article)[0] == "A & B\nOne two three\nCafé x\ni\nii"
    assert html_extract.main_text(PAGE % "<div class='text'><p>Plain page</p><p>Two</p></div>")[0] == "Plain page\nTwo"
    assert html_extract.main_text("<body><article><p>cut <b>off")[0] == "cut off"
    assert html_extract.main_text("a < b and c")[0] == "a < b and c"
    assert html_extract.main_text("<p title='a > b'>x</p><!-- <p>gone</p> --><p hidden>h</p>")[0] == "x"
    # All that ends a comment.
    for comment in ("<!-->", "<!--->", "<!-- x --!>", "<!---->", "<!-- a > b -- c -->", "<!--->-->"):
        want = "a-->b\nc" if comment == "<!--->-->" else "ab\nc"
        assert html_extract.main_text(f"<p>a{comment}b</p><p>c</p>")[0] == want, comment
    for odd in (None, "", "<html></html>", "<script>x", "<!-- never closed <p>x</p>", "</p></div>"):
        assert html_extract.main_text(odd) == ("", False)
    for kept in ("layout has-sidebar", "header-fixed page", "form-factor-review", "blog-posts", "downloads"):
        assert html_extract.main_text(f"<div class='{kept}'><p>Real text</p></div>")[0] == "Real text"
    for gone in ("sidebar-inner", "site-footer", "siteFooter", "related-posts", "cookie-notice", "main-nav", "share-buttons", "comment-12", "ad_box", "side-bar left"):
        assert html_extract.main_text(f"<div class='{gone}'>Noise</div><p>Real text</p>")[0] == "Real text"
    assert html_extract.main_text('<p>a</p><svg width="3"/><p>b</p><svg><text>no</text></svg><math a="/"/><p>c</p>')[0] == "a\nb\nc"
    long = [f"Paragraph {i} of a very long page." for i in range(30_000)]
    assert html_extract.main_text("<article>" + "".join(f"<p>{x}</p>" for x in long) + "</article>")[0] == "\n".join(long)


def test_site_style_tree(spark):
    page = lambda i, host: (i, f"http://{host}/p{i}", f"<html><body><div class='top{i}'><span>Welcome to the site</span></div><div class='box'><p>Article {i} says {'x' * (i + 1)} things</p></div><div class='low'><p>Call us today</p></div></body></html>")
    rows = [page(i, "a.example.com") for i in range(12)] + [page(100 + i, "b.example.com") for i in range(2)] + [(200, None, None), (201, "::", ""), (0, *page(0, "a.example.com")[1:])]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, removed int")
    got = {}
    for r in html_extract.digest(pages).collect():
        got.setdefault(r.page_id, []).append(r)
    for i in range(12):
        assert {r.text for r in got[i]} == {f"Article {i} says {'x' * (i + 1)} things"}
    # Too few pages to judge: nothing is taken for a template.
    assert got[100][0].text == f"Welcome to the site\nArticle 100 says {'x' * 101} things\nCall us today"
    assert got[200][0].text == "" and got[201][0].text == "" and got[200][0].n_chars == 0 and len(got[0]) == 2
    assert html_extract.digest(pages.where("false")).count() == 0


def site(host, n, page):
    return [(i, f"https://{host}/{i}", page(i)) for i in range(n)]


COLUMNS = "page_id long, url string, html string"


def test_tree_within_the_article(spark):
    """Templates inside the article go where the host has enough pages, and stay where it has not."""
    page = lambda i: f"<body><article><h1>Title {i}</h1><h2>Summary</h2><p>Text of page {i}.</p><div class='end'><p>Read our letter</p></div><p>We were founded in 1901.</p></article></body>"
    for n, want in ((20, "Title {0}\nSummary\nText of page {0}."), (3, "Title {0}\nSummary\nText of page {0}.\nRead our letter\nWe were founded in 1901.")):
        rows = html_extract.digest(spark.createDataFrame(site("a.example.com", n, page), COLUMNS)).collect()
        assert {r.page_id: r.text for r in rows} == {i: want.format(i) for i in range(n)} and {r.by_tree for r in rows} == {n == 20}


def test_tree_beside_the_article(spark):
    """Without an article element the tree finds the main branch; a page without it falls back to what is not noise."""
    page = lambda i: f"<body><div class='a'><h1>Title {i}</h1></div><h1>Story {i}</h1><div class='teasers'><p>Short {i}</p></div><div class='wide'><div class='text'><h2>On {i}</h2><p>{f'Text of page {i}. ' * 20}</p></div></div></body>"
    rows = site("b.example.com", 12, page) + [(99, "https://b.example.com/x", "<body><div class='other'><p>Another kind of page</p></div></body>")]
    got = {r.page_id: (r.text, r.by_tree) for r in html_extract.digest(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {i: (f"Story {i}\nOn {i}\n" + " ".join([f"Text of page {i}."] * 20), True) for i in range(12)} | {99: ("Another kind of page", False)}


def test_tree_by_brute_force(spark):
    rnd = random.Random(3)
    part = lambda i: rnd.choice([f"<p>own {i} {rnd.random()}</p>", "<p>same</p>", "<div class='x'><p>box</p></div>", f"<div class='y'><h2>t{i % 3}</h2><b>{i % 5}</b></div>", "<ul><li>one</ul>"])
    rows = [(i, f"https://{'ab'[i % 2]}.example.com/{i}", f"<body>{''.join(part(i) for _ in range(rnd.randrange(6)))}<article>{''.join(part(i) for _ in range(rnd.randrange(4)))}</article></body>") for i in range(60)]
    rows += rows[:7]
    pages = spark.createDataFrame(rows, COLUMNS)
    seen = {}
    for _, url, page in rows:
        for path, copy, what, value, _ in html_extract.page_nodes(page):
            seen.setdefault((url[8], path), {}).setdefault(what, set()).add((copy, value))
    want = {}
    for (host, path), by in seen.items():
        ent = []
        for what in (html_extract.STYLE, html_extract.CONTENT):
            counts = Counter(v for _, v in by[what])
            m = sum(counts.values())
            ent.append(-sum(c / m * math.log(c / m, m) for c in counts.values()) if m > 1 else 1.0)
        want[(f"{host}.example.com", path)] = (len(by[html_extract.CONTENT]), 0.1 * ent[0] + 0.9 * ent[1])
    got = {(r.host, r.path): (r.pages, r.importance) for r in html_extract.style_tree(html_extract.node_counts(pages)).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_copies_are_no_template(spark):
    page = "<html><body><article><h1>News</h1><p>The very same article text.</p></article></body></html>"
    pages = spark.createDataFrame([(i, "http://h.example.com/", page) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.digest(pages).collect()} == {"News\nThe very same article text."}


def test_toxicity(spark, docs_of):
    rnd = random.Random(8)
    calm = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(700):
        parts = [" ".join(rnd.choice(calm) for _ in range(12)) for _ in range(rnd.randrange(1, 9))]
        bad = i % 6 == 0
        if bad:
            k = rnd.randrange(len(parts))
            parts[k] += " " + rnd.choice(["grumbly", "snarkful", "vexostem" + rnd.choice(["a", "en", "ig"])])
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, 1, int(bad)))
    docs, marks = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    unseen = [r for r in got.values() if r.held_out]
    assert len(unseen) > 80 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in unseen) >= 0.97 * len(unseen)
    found = {r.doc_id: r.sentences for r in toxicity.offending(docs, model).collect()}
    texts = dict(rows)
    hits = [texts[i][s.start : s.end] for i in range(0, 700, 6) for s in found[i]]
    assert len(hits) > 90 and sum(bool(re.search("grumbly|snarkful|vexostem", x)) for x in hits) >= 0.97 * len(hits)


def test_toxicity_of_long_clean_texts():
    model = toxicity.Model({"snarkful": 14.0}, toxicity.BIAS)
    clean = "a calm line of words\n" * 20_000
    assert model.document(clean) == 0 and model.sentence("a calm line") == 0
    assert model.document(clean + "snarkful") == pytest.approx(model.sentence("snarkful")) and model.sentence("snarkful") > 0.9
    # Slight evidence in every one of 100,000 sentences is no witness.
    slight = toxicity.Model({"calm": 4.0, "snarkful": 14.0}, toxicity.BIAS)
    assert slight.document("a calm line of words. " * 100_000) == 0 and slight.document("a calm line. " * 100_000 + "snarkful") > 0.9


def test_toxicity_by_brute_force():
    rnd = random.Random(9)
    weights = {f: rnd.uniform(-2, 9) for f in ("abcd*", "abcde", "xy", "grumb*", "grumbly", "éclat", "snark*", "snar*")}
    model = toxicity.Model(weights, toxicity.BIAS)
    words = ["abcde", "abcd", "xy", "Grumbly", "grumbling", "Éclat", "snarkful", "plain", "word", "12", "a1b"]
    for _ in range(300):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", ". ", "!", "\n", "? "]) for _ in range(rnd.randrange(40)))
        clean = 1.0
        for part in re.split(r"[.!?…。！？\n]", text.lower()):
            found = set()
            for w in re.findall(r"[^\W\d_]+", part):
                found |= {w} | {w[:n] + "*" for n in (4, 5, 6) if len(w) >= n}
            held = [weights[f] for f in found if f in weights]
            p = 1 / (1 + math.exp(-(toxicity.BIAS + sum(held)))) if held else 0.0
            clean *= 1 - p if p >= toxicity.WITNESS else 1
        assert model.document(text) == pytest.approx(1 - clean)


def test_toxicity_training_is_bounded_and_stable(spark, docs_of):
    rows = [(i, f"{'snarkful' if i % 3 == 0 else 'calm'} text number {'x' * (i % 7)}") for i in range(200)] + [(i, "another text of the id") for i in range(50)] + [(300, None)]
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)] + [(300, 1, 0)], "doc_id long, quality int, toxic int")
    one, two = (toxicity.train(docs_of(r), marks) for r in (rows, rows[::-1]))
    assert one.weights == two.weights and one.weights
    assert toxicity.train(docs_of(rows), marks, max_bytes=0).weights == {}
    # Labelled texts too long for the bound are passed over, wherever they stand in the order.
    long = [(i, "snarkful and calm " * 2000) for i in range(400, 410)]
    more = marks.union(spark.createDataFrame([(i, 1, 1) for i, _ in long], "doc_id long, quality int, toxic int"))
    assert toxicity.train(docs_of(long + rows), more, max_bytes=200_000).weights == one.weights


def test_toxicity_edges(spark, edges, empty):
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.digest(edges, marks).collect()
    assert len(got) == len(EDGES) and not any(r.predicted for r in got)
    assert toxicity.digest(empty, marks.where("false")).count() == 0


def test_toxicity_on_real_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.digest(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang = 'en'").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)


def test_html_beyond_the_broadcast(spark):
    page = lambda i: (i, "http://a.example.com/", f"<body><div class='box'><p>Article {i} is about {i * 3}</p></div><div class='low'><p>Call us today</p></div></body>")
    pages = spark.createDataFrame([page(i) for i in range(9)], "page_id long, url string, html string")
    small, large = (sorted(map(tuple, html_extract.extract(pages, broadcast_chars=n).collect())) for n in (10_000, 0))
    assert small == large and all("Call" not in r[2] for r in small)
