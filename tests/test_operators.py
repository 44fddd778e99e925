"""Operators against plain Python twins and the numeric cases of the survey."""

import math
import random
import time

from pyspark.sql import functions as F

from cliploom.config import EngineConfig
from cliploom.functions import numeric, text
from cliploom.operators import assembly, dedup, graph, intervals, media, scoring, selection, sequence, signals, speech, views


def ratio(a, b):
    overlap = min(a[1], b[1]) - max(a[0], b[0])
    return overlap / min(a[1] - a[0], b[1] - b[0]) if overlap > 0 else 0.0


def one(df):
    return df.first()[0]


def value(spark, column):
    return one(spark.range(1).select(column))


def test_turns(spark):
    spans = spark.createDataFrame([(1, 1.0, 1.8, "a"), (1, 2.0, 3.1, "b"), (1, 5.0, 6.2, "c")], "asset_id int, start_sec double, end_sec double, text string")
    rows = speech.turns(spans).orderBy("turn").collect()
    assert [(r.turn_id, r.start_sec, r.end_sec, r.text) for r in rows] == [("turn-01", 1.0, 3.1, "a b"), ("turn-02", 5.0, 6.2, "c")]


def test_spoken_structure(spark):
    spans = spark.createDataFrame([(1, 1.0, 2.0, "Where do we start?"), (1, 3.0, 5.0, "Right here."), (2, 0.0, 1.0, "One."), (2, 1.5, 2.0, "Two.")], "asset_id int, start_sec double, end_sec double, text string")
    rows = {r.asset_id: r for r in speech.spoken_structure(spans, "asset_id").collect()}
    assert rows[1].question_answer_flow == 0.9 and rows[1].monologue_continuity == 0.0
    assert rows[2].question_answer_flow == 0.0 and rows[2].monologue_continuity == 0.82


def test_speech_gate(spark):
    rows = [("low", r, i != 3, float(i)) for i, r in enumerate((0.003, 0.004, 0.005, 0.004))] + [("high", r, False, float(i)) for i, r in enumerate((0.055, 0.038, 0.074, 0.047))]
    got = {r.asset_id: r for r in speech.speech_gate(spark.createDataFrame(rows, "asset_id string, rms_energy double, is_silent boolean, t double")).collect()}
    assert not got["low"].request and got["low"].probe_after_skip and got["high"].request and got["high"].without_probe


def test_dedupe_keeps_the_shortest(spark):
    rnd = random.Random(3)
    rows = [(k, round(a := rnd.uniform(0, 30), 3), round(a + rnd.uniform(0.5, 9), 3), 32.0) for k in range(12) for _ in range(10)]
    got = intervals.deduped_ranges(spark.createDataFrame(rows, "k int, s double, e double, d double"), "k", "s", "e", "d").collect()
    for k in range(12):
        cut = sorted(((round(min(e, 32.0) - s, 3), s, min(e, 32.0)) for kk, s, e, _ in rows if kk == k and min(e, 32.0) - s >= 1))
        kept = []
        for _, s, e in cut:
            if all(ratio(x, (s, e)) < 0.9 for x in kept):
                kept.append((s, e))
        assert sorted((r.s, r.e) for r in got if r.k == k) == sorted(kept)


def test_peak_windows(spark):
    rnd = random.Random(4)
    rows = [(k, round(rnd.uniform(0, 40), 3), round(rnd.random(), 4), 40.0) for k in range(8) for _ in range(12)]
    got = intervals.peak_windows(spark.createDataFrame(rows, "k int, t double, x double, d double"), "k", "t", ["x"], "d", 3).collect()
    for k in range(8):
        kept = []
        for _, t in sorted((-x, t) for kk, t, x, _ in rows if kk == k):
            s = round(max(0.0, t - 2.5), 3)
            w = (s, round(min(40.0, s + 5.0), 3))
            if w[1] - w[0] >= 1.5 and len(kept) < 3 and all(ratio(x, w) < 0.7 for x in kept):
                kept.append(w)
        mine = [(round(r.start_sec, 2), round(r.end_sec, 2)) for r in sorted(got, key=lambda r: r.pos) if r.k == k]
        assert mine == [(round(a, 2), round(b, 2)) for a, b in kept]


def test_fallback_scenes(spark):
    got = intervals.fallback_scenes(spark.createDataFrame([(1, 22.0), (2, 5.0), (3, 9.0)], "k int, d double"), "k", "d").collect()
    assert sum(r.k == 1 for r in got) >= 3
    assert [(r.start_sec, r.end_sec) for r in got if r.k == 2] == [(0.0, 6.0)]


def test_leaders(spark):
    rnd = random.Random(5)
    scores = {(g, i): rnd.randrange(100) for g in range(6) for i in range(9)}
    sim = {(g, a, b): round(rnd.random(), 3) for g in range(6) for a in range(9) for b in range(9) if a != b}
    items = spark.createDataFrame([(g, i, s) for (g, i), s in scores.items()], "g int, i int, s int")
    pairs = spark.createDataFrame([(g, a, b, x) for (g, a, b), x in sim.items()], "g int, a int, b int, similarity double")
    got = {(r.g, r.i): (r.leader, r.dedup_group) for r in dedup.leaders(items, pairs, "g", "i", "s", 0.7).collect()}
    for g in range(6):
        seen, number = {}, 0
        for i in sorted(range(9), key=lambda i: (-scores[g, i], i)):
            if i not in seen:
                seen[i] = (i, number)
                for j in range(9):
                    if j not in seen and sim[g, i, j] >= 0.7:
                        seen[j] = (i, number)
                number += 1
        assert {i: got[g, i] for i in range(9)} == seen


def test_leader_threshold_zero(spark):
    items = spark.createDataFrame([("x", 0, 0.9), ("x", 1, 0.5), ("x", 2, 0.7)], "g string, i int, s double")
    pairs = spark.createDataFrame([("x", a, b, 0.0) for a in range(3) for b in range(3) if a != b], "g string, a int, b int, similarity double")
    rows = dedup.leaders(items, pairs, "g", "i", "s", 0.0).collect()
    assert [r.i for r in rows if not r.deduplicated] == [0] and {r.dedup_group for r in rows} == {0}


def test_histogram(spark):
    rows = [("same", 1, 0.5, 0.4), ("same", 2, 0.5, 0.4), ("far", 1, 0.2, 0.4), ("far", 2, 0.8, 0.4)]
    bins = dedup.histograms(spark.createDataFrame(rows, "g string, i int, brightness double, distinctiveness double"), ["g", "i"])
    got = {(r.g, r.a, r.b): r.similarity for r in dedup.intersections(bins, "g", "i").collect()}
    assert got == {("same", 1, 2): 1.0, ("same", 2, 1): 1.0}


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "a int, b int")
    for task_edges in (graph.TASK_EDGES, 100):  # one task; stars between tasks
        assert {r.node: r.component for r in graph.connected(frame, task_edges=task_edges).collect()} == {x: find(x) for x in parent}


def test_acyclic(spark):
    make = lambda e: spark.createDataFrame(e, "before string, after string")
    assert graph.acyclic(make([("a", "b"), ("b", "c"), ("a", "c")]))[0]
    assert not graph.acyclic(make([("a", "b"), ("b", "c"), ("c", "b")]))[0]


def test_split(spark):
    seg = spark.createDataFrame([(1, 7, 0.0, 9.0, 0.9)], "asset_id int, segment_id int, start_sec double, end_sec double, boundary_confidence double")
    spans = spark.createDataFrame([(1, 0.5, 3.0, "a"), (1, 5.5, 8.0, "b")], "asset_id int, start_sec double, end_sec double, text string")
    scenes = spark.createDataFrame([], "asset_id int, pos int, start_sec double, end_sec double")
    dividers = assembly.split_dividers(seg, speech.turns(spans), spans, scenes)
    assert [tuple(r) for r in dividers.collect()] == [(1, 7, 4.25, "turn-break")]
    parts = assembly.split(seg, dividers).orderBy("part").collect()
    assert [(r.start_sec, r.end_sec, r.boundary_confidence) for r in parts] == [(0.0, 4.25, 0.828), (4.25, 9.0, 0.828)]


SEG = "asset_id int, segment_id string, start_sec double, end_sec double, analysis_mode string, transcript_excerpt string, seed_sources array<string>, source string, boundary_confidence double"
SPAN, TURN, SCENE = "asset_id int, start_sec double, end_sec double, text string", "asset_id int, turn int, start_sec double, end_sec double", "asset_id int, pos int, start_sec double, end_sec double"


def chain_rules(spark, cases):
    """Rule families of pairs of segments: each case is ((range, mode, excerpt, sources, source) twice, spans, turns, scenes)."""
    seg, spans, turns, scenes = [], [], [], []
    for k, (left, right, said, spoken, seen) in enumerate(cases):
        seg += [(k, f"{k}{x}", a, b, mode, excerpt, sources, source, 0.5) for x, ((a, b), mode, excerpt, sources, source) in zip("lr", (left, right))]
        spans += [(k, a, b, "t") for a, b in said]
        turns += [(k, i + 1, a, b) for i, (a, b) in enumerate(spoken)]
        scenes += [(k, i, a, b) for i, (a, b) in enumerate(seen)]
    near = assembly.continuity(spark.createDataFrame(seg, SEG), spark.createDataFrame(spans, SPAN), spark.createDataFrame(turns, TURN), spark.createDataFrame(scenes, SCENE))
    found = {}
    for r in assembly.merged_chains(near, assembly.merge_rule()).orderBy("asset_id", "chain").collect():
        found.setdefault(r.asset_id, []).append((r.n, r.rule_family))
    return [found[k][0][1] if len(found[k]) == 1 else None for k in range(len(cases))]


def test_merge_rules(spark):
    say = lambda a, b, text="we go on", source=None: ((a, b), "speech", text, ["scene"], source)
    see = lambda a, b, seed="scene", source=None: ((a, b), "visual", "", [seed], source)
    none, cut = [], [(0.0, 4.2), (4.2, 20.0)]
    cases = [
        (say(0.0, 4.0, "why?"), say(5.0, 8.0), none, none, none, "question-answer-flow"),
        (say(0.0, 4.0, "why?"), say(5.0, 8.0), none, none, cut, None),  # a scene boundary between
        (say(0.0, 4.0, "why?"), say(5.2, 8.0), none, [(0.0, 3.7), (5.1, 8.0)], none, None),  # a break of 1.4 s between consecutive turns
        (say(0.0, 4.0), say(4.9, 8.0), none, none, none, "monologue-continuity"),
        (say(0.0, 4.0), say(5.0, 8.0), none, none, none, None),
        (say(0.0, 4.0), say(5.0, 8.0), none, [(0.0, 9.0)], none, "turn-continuity"),  # one turn over both
        (see(0.0, 4.0), see(5.0, 8.0, "audio-peak"), none, [(0.0, 4.2), (4.7, 8.0)], none, "turn-continuity"),  # consecutive turns, .5 s apart
        (see(0.0, 4.0), see(5.0, 8.0), none, [(0.0, 4.2), (4.9, 8.0)], none, None),  # .7 s apart
        (see(0.0, 4.0), see(5.0, 8.0), [(0.0, 3.9), (4.7, 6.0)], none, none, "transcript-continuity"),
        (see(0.0, 4.0), see(5.0, 8.0), [(0.0, 3.9), (4.9, 6.0)], none, none, None),
        (see(0.0, 4.0), see(4.3, 7.5), none, none, none, "structural-continuity"),
        (see(0.0, 4.0), see(4.3, 7.6), none, none, none, None),  # over 7.5 s together
        (see(0.0, 7.6), see(4.3, 5.0), none, none, none, None),  # the left one ends last
        (say(0.0, 4.0, "why?"), see(4.3, 7.0, "audio-peak"), none, none, none, "structural-continuity"),  # either speaks
        (say(0.0, 4.0, source="x"), say(4.0, 8.0, source="x"), none, none, none, None),  # parts of one split
        (say(0.0, 4.0, source="x"), say(4.0, 8.0, source="y"), none, none, none, "monologue-continuity"),
        (see(0.0, 4.0), see(5.3, 6.0), [(0.0, 3.9), (4.0, 6.0)], [(0.0, 9.0)], none, None),  # over 1.25 s
    ]
    assert chain_rules(spark, [c[:5] for c in cases]) == [c[5] for c in cases]


def test_assembled(spark):
    """Split at a turn break; the second part joins its neighbour; a question is answered; ids are new."""
    seg = spark.createDataFrame([(1, "a", 0.0, 9.0, ["scene"], "scene-snap", 0.9), (1, "b", 9.2, 11.0, ["audio-peak"], "audio-snap", 0.74), (1, "c", 20.0, 22.0, ["scene"], "scene-snap", 0.62)], "asset_id int, segment_id string, start_sec double, end_sec double, seed_sources array<string>, boundary_strategy string, boundary_confidence double")
    spans = spark.createDataFrame([(1, 0.5, 3.0, "so it is"), (1, 5.5, 8.0, "and why"), (1, 8.5, 11.0, "because")], SPAN)
    scenes = spark.createDataFrame([], SCENE)

    def describe(rows):
        said = intervals.overlapping_ranges(rows.select("asset_id", "segment_id", "start_sec", "end_sec"), spans.select("asset_id", F.col("start_sec").alias("a"), F.col("end_sec").alias("b"), "text"), ["asset_id"], ("start_sec", "end_sec"), ("a", "b"), None)
        said = said.groupBy("asset_id", "segment_id").agg(speech.ordered_text("a", "b").alias("transcript_excerpt"))
        out = rows.join(said, ["asset_id", "segment_id"], "left").withColumn("transcript_excerpt", F.coalesce("transcript_excerpt", F.lit("")))
        return out.withColumn("analysis_mode", F.when(F.col("transcript_excerpt") != "", "speech").otherwise("visual"))

    got = assembly.assembled(seg, spans, speech.turns(spans), scenes, describe).orderBy("start_sec").collect()
    assert [(r.segment_id, r.start_sec, r.end_sec, r.operation, r.boundary_strategy, r.boundary_confidence, r.source_ids, r.seed_sources) for r in got] == [
        ("1-segment-01", 0.0, 4.25, "split", "assembly-split:turn-break", 0.828, ["a"], ["scene"]),
        ("1-segment-02", 4.25, 11.0, "merge", "assembly-merge:monologue-continuity", 0.784, ["a-split-2", "b"], ["scene", "audio-peak"]),
        ("1-segment-03", 20.0, 22.0, "", "scene-snap", 0.62, ["c"], ["scene"]),
    ]
    assert [r.transcript_excerpt for r in got] == ["so it is", "and why because", ""]


def test_validated(spark):
    seg = spark.createDataFrame([(1, "x", 0.0, 8.0, 20.0), (1, "y", 9.0, 12.0, 20.0)], "asset_id int, segment_id string, start_sec double, end_sec double, duration_sec double")
    results = spark.createDataFrame([("x", "split", None, None, 4.0, True), ("y", "extend", 2.0, 12.5, None, False)], "segment_id string, decision string, new_start double, new_end double, split_at double, supported boolean")
    rows = assembly.validated(seg, results).orderBy("start_sec").collect()
    assert [(r.segment_id, r.start_sec, r.end_sec, r.applied) for r in rows] == [("1-segment-01", 0.0, 4.0, True), ("1-segment-02", 4.0, 8.0, True), ("1-segment-03", 7.5, 12.5, True)]


def slow_story_order(takes):
    """The sequence by comparing all takes that are left at each step."""
    units = lambda x: math.floor(x * 10000 + 0.5)
    n, visual, role = len(takes), [t["mode"] == "visual" for t in takes], [t["role"] for t in takes]
    full = [not v and t["turn"] >= 0.85 for v, t in zip(visual, takes, strict=True)]
    opener = [units(t["score_total"] + t["prompt"] + 0.03 * (t["hook"] >= 0.7) + (0.09 + 0.04 * (t["novelty"] >= 0.7) + 0.02 * (t["prompt"] > 0) if v else 0.03 - 0.03 * t["blank"])) for t, v in zip(takes, visual, strict=True)]
    release = [units(t["score_total"] + min(0.05, t["prompt"]) + 0.03 * (t["story"] >= 0.7) + (0.08 + 0.04 * (t["motion"] <= 0.55) if v else 0.03 * (t["turn"] >= 0.85))) for t, v in zip(takes, visual, strict=True)]
    follow = [units(t["score_total"] + min(0.06, t["prompt"]) + (0.02 if f else 0)) for t, f in zip(takes, full, strict=True)]
    left = list(range(n))
    out = [max(left, key=lambda i: (opener[i], -i))]
    left.remove(out[0])
    last = max([i for i in left if visual[i]] or left, key=lambda i: (release[i], -i)) if n >= 3 else None
    if last is not None:
        left.remove(last)
    scores = [opener[out[0]]]
    while left:
        a, b = out[-1], out[-2] if len(out) > 1 else out[-1]

        def score(i, a=a, b=b):
            s = follow[i] + ((1300 if visual[i] else 1200) if visual[i] != visual[a] else -400) + (400 if role[i] != role[a] else -300)
            s += 100 * (takes[i]["score_total"] >= 0.75 and takes[a]["score_total"] >= 0.75)
            return s - 500 * (visual[i] == visual[a] == visual[b]) - 400 * (role[i] == role[a] == role[b])

        best = max(left, key=lambda i: (score(i), -i))
        scores.append(score(best))
        out.append(best)
        left.remove(best)
    if last is not None:
        out.append(last)
        scores.append(release[last])
    return list(zip(out, scores, strict=True))


def test_story_order_by_classes():
    rnd = random.Random(12)
    for n in (2, 3, 4, 7, 40, 150):
        for roles in (1, 2, 9, 60):
            pick = lambda *x: rnd.choice(x)
            takes = [{"score_total": pick(0.5, 0.7, 0.74, 0.75, 0.8, round(rnd.random(), 4)), "mode": pick("visual", "speech"), "role": f"r{rnd.randrange(roles)}", "prompt": pick(0.0, 0.02, 0.08), "novelty": rnd.random(), "hook": rnd.random(), "motion": rnd.random(), "story": rnd.random(), "turn": rnd.random(), "blank": rnd.random() < 0.5} for _ in range(n)]
            assert sequence.story_order(takes) == slow_story_order(takes)


def test_long_story_order():
    rnd = random.Random(2)
    takes = [{"score_total": round(rnd.random(), 4), "mode": "visual" if i % 3 else "speech", "role": f"r{i % 50}", "prompt": 0.0, "novelty": 0.0, "hook": 0.0, "motion": 0.5, "story": 0.0, "turn": 0.9, "blank": False} for i in range(100_000)]
    start = time.time()
    order = sequence.story_order(takes)
    assert len({i for i, _ in order}) == 100_000 and time.time() - start < 30


def test_story_order():
    take = lambda mode, score, **x: {"score_total": score, "mode": mode, "role": x.get("role", mode), "prompt": 0.0, "novelty": 0.5, "hook": 0.5, "motion": x.get("motion", 0.6), "story": 0.5, "turn": 0.5, "blank": False}
    takes = [take("speech", 0.8), take("visual", 0.75), take("visual", 0.7, motion=0.4), take("speech", 0.7)]
    order = [i for i, _ in sequence.story_order(takes)]
    assert order[0] == 1 and order[-1] == 2 and sorted(order) == [0, 1, 2, 3]
    assert sequence.story_order([]) == []


def test_proxy_match(spark):
    rows = [("/a/Originals/C1.mov", "source", "C1", "C1", "mov", 10.0, 24.0), ("/a/Proxy/C1.mov", "proxy", "C1", "C1", "mov", 10.0, 24.0), ("/a/Proxy/C2_proxy.mov", "proxy", "C2", "C2_proxy", "mov", None, None), ("/a/Originals/C3.mov", "source", "C3", "C3", "mov", None, None)]
    got = {r.source_path: r for r in media.match_media(spark.createDataFrame(rows, "path string, role string, clip_key string, stem string, ext string, duration_sec double, fps double")).collect()}
    assert got["/a/Originals/C1.mov"].confidence >= 0.85 and got["/a/Proxy/C2_proxy.mov"].confidence == 0.45 and got["/a/Originals/C3.mov"].confidence == 1.0


def test_views_join_items_to_takes_first(spark):
    """Segments without a take have no take_id: joined by it, they would all meet in one task."""
    segments = spark.createDataFrame([(1, i) for i in range(4)], "asset_id long, segment_id long")
    found = views.segment_views(segments, spark.createDataFrame([(1, "a")], "asset_id long, asset_name string"), spark.createDataFrame([(0, "t0"), (1, "t1")], "segment_id long, take_id string"), spark.createDataFrame([("t1", True)], "take_id string, on_timeline boolean"))
    assert sorted((r.segment_id, r.take_id, r.on_timeline) for r in found.collect()) == [(0, "t0", None), (1, "t1", True), (2, None, None), (3, None, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter, (segment_id") < plan.index("Join LeftOuter, (take_id")


def test_match_media_pairs_classes(spark):
    """Files of one key that score alike never meet one by one."""
    rows = spark.range(4_000).select(F.format_string("/m/%05d", "id").alias("path"), F.when(F.col("id") % 2 == 0, "source").otherwise("proxy").alias("role"), F.lit("k").alias("clip_key"), F.lit("k").alias("stem"), F.lit("mov").alias("ext"), (F.col("id") % 4 / 2).alias("duration_sec"), F.lit(None).cast("double").alias("fps"))
    found = media.match_media(rows)
    assert {tuple(r) for r in found.groupBy("proxy_path", "confidence").count().collect()} == {("/m/00001", 0.9, 2_000)}
    # Pairs of files would be ranked for each source; classes are brought to their best by aggregates.
    assert "Window [row_number" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_scores(spark):
    base = dict.fromkeys(scoring.METRICS, 0.9)
    row = {"asset_id": 1, "segment_id": 1, "has_speech": False, "transcript_excerpt": "", **base}
    rows = scoring.with_scores(spark.createDataFrame([row, {**row, "segment_id": 2, "has_speech": True, "transcript_excerpt": "hello there"}])).orderBy("segment_id").collect()
    assert rows[0].analysis_mode == "visual" and rows[1].analysis_mode == "speech"
    assert abs(rows[0].score_technical - 0.9 * 1.0 / 1.22) < 1e-4 and rows[0].score_semantic == 0.9 and rows[0].score_story == 0.9


def test_null_metrics_count_as_zero(spark):
    assert value(spark, numeric.clamp(F.lit(None).cast("double"))) == 0.0
    assert value(spark, numeric.weighted_average([(F.lit(None).cast("double"), 1.0), (F.lit(0.5), F.lit(None).cast("double"))])) == 0.0


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(text.slugify(F.lit("  My Clip! 2"))) == "my-clip-2" and v(text.slugify(F.lit("--"))) == "project"
    assert v(text.human_join(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b, and c"
    assert v(text.clip_key(F.lit("A_001-proxy"))) == "A001" and v(text.media_role(F.lit("/x/Proxies/a.mov"))) == "proxy" and v(text.media_role(F.lit("/x/optical.mov"))) == "source"
    assert v(text.timecode_of(F.lit("2025-08-10T15:22:18+0300"))) == "15:22:18:00"
    assert v(text.timecode_seconds(F.lit("01:00:02:12"), F.lit(24.0))) == 3602.5 and v(text.timecode_seconds(F.lit("bad"), F.lit(24.0))) == 0.0
    assert v(numeric.parsed_float(F.lit("30000/1001"))) is not None and v(numeric.parsed_float(F.lit("0/0"))) is None
    assert v(text.repaired_json(F.lit('noise {"a": 1, "b": [1, 2'))) == '{"a": 1, "b": [1]}'
    assert v(text.rational_time(F.lit(0.5))) == "1/2s" and v(text.rational_seconds(F.lit("1001/24000s"))) == 1001 / 24000
    assert v(text.is_placeholder(F.lit("Item  3"))) and not v(text.is_placeholder(F.lit("a dog")))


def test_budget_and_targets(spark):
    rows = [(1, 10, 1, 0.7, 0.5), (1, 11, 2, 0.9, 0.5), (2, 20, 1, 0.5, 0.5), (2, 21, 2, 0.3, 0.5)]
    seg = spark.createDataFrame(rows, "asset_id int, segment_id int, pos int, ambiguity double, score_total double")
    got = selection.drained(selection.ambiguity_targets(seg), most=1).orderBy("run_rank").collect()
    assert [(r.segment_id, r.target_reason, r.status) for r in got] == [(11, "threshold", "pending"), (10, "threshold", "over_budget"), (20, "floor", "over_budget")]


def test_frames(spark):
    image = b"P5\n# note\n4 4\n255\n" + bytes(range(0, 160, 10))
    rows = spark.createDataFrame([(1, 0.0, bytearray(image)), (1, 1.0, bytearray(image)), (1, 2.0, bytearray(b"P5 4 4 255\nxx"))], "asset_id int, timestamp_sec double, content binary")
    got = signals.measured_signals(signals.decoded_frames(rows)).orderBy("timestamp_sec").collect()
    assert [r.motion_energy for r in got] == [0.32, 0.0] and got[0].brightness > 0


def test_status_and_reason(spark):
    rows = spark.createDataFrame([("active",), ("degraded",), ("partial",)], "s string")
    assert one(rows.agg(views.worst_status(F.col("s")))) == "degraded"
    assert value(spark, views.strategy_label(F.lit("assembly-merge:turn-continuity"))) == "Assembly merged (turn continuity)"


def test_config():
    c = EngineConfig.of({"mode": "fast", "budget_pct": "250", "floor_threshold": 0.9, "max_adjustment": "x", "dedup": "off"})
    assert c.max_segments_per_asset == 1 and c.budget_pct == 100 and c.floor_threshold == c.ambiguity_threshold and c.max_adjustment == 1.5 and not c.dedup
