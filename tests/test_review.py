"""Model results, review texts and provenance."""

from pyspark.sql import functions as F

from cliploom.functions import text
from cliploom.operators import intervals, model, review


def test_resolved(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    of = lambda *rows: spark.createDataFrame(list(rows), "cache_key string, result string")
    rows = model.resolved(tasks, of(("a", "old")), of(("a", "new"), ("b", "new")), of(("a", "f"), ("b", "f"), ("c", "f")))
    assert {r.cache_key: (r.result, r.status) for r in rows.collect()} == {"a": ("old", "cached"), "b": ("new", "live"), "c": ("f", "fallback")}
    assert tuple(model.run_stats(rows).first()) == (1, 1, 1, 3)


def test_normalised(spark):
    fallback = F.struct(*(F.lit("f").alias(n) for n in ("shot_type", "camera_motion", "mood", "keep_label")), *(F.array(F.lit("f")).alias(n) for n in ("story_roles", "quality_findings", "risk_flags")), F.lit(0.5).alias("confidence"))
    raw = ['{"shot_type": "wide", "mood": "label", "keep_label": "KEEP", "confidence": "1.7", "story_roles": ["opener", "none"]}', "garbage"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").select("i", model.normalised(F.col("raw"), fallback).alias("n")).orderBy("i").collect()
    n = rows[0].n
    assert (n.shot_type, n.mood, n.keep_label, n.confidence, n.story_roles, n.risk_flags) == ("wide", "f", "keep", 1.0, ["opener"], ["f"])
    assert rows[1].n.keep_label == "f" and rows[1].n.confidence == 0.5


def test_attempted_sees_each_asset_whole(spark):
    """More rows than a batch, nulls in one asset only, results left out and failures; one frame from many assets in a task."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.when(F.col("id") < 20_000, 0).otherwise(F.floor(F.col("id") / 4))).alias("asset_id"), "id", F.when(F.col("id") != 29_999, F.col("id") * 2).alias("n"))

    def work(batch):
        if batch["asset_id"].iat[0] == 5_001:
            raise ValueError("no")
        assert list(batch.index) == list(range(len(batch))) and batch["asset_id"].nunique(dropna=False) == 1
        assert batch["n"].dtype == ("float64" if batch["id"].max() == 29_999 else "int64")
        return batch[["id"]].assign(size=len(batch), n=batch["n"])

    found, states = model.attempted(rows, work, "id long, size int, n long")
    want = rows.where("asset_id is null or asset_id <> 5001").groupBy("asset_id").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    got = found.groupBy("asset_id").agg(F.max("size").cast("long").alias("size"), F.sum("n").alias("n"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert [tuple(r) for r in states.where("error is not null").collect()] == [(5001, 0, "ValueError: no")]
    # One process reads many assets: far fewer groups reach Python than there are.
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString() and found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_an_answer_is_parsed_once(spark):
    rules = F.struct(*(F.lit("f").alias(n) for n in ("shot_type", "camera_motion", "mood", "keep_label")), *(F.array(F.lit("f")).alias(n) for n in ("story_roles", "quality_findings", "risk_flags")), F.lit(0.5).alias("confidence"))
    plan = spark.range(9).select(F.concat(F.lit("{"), "id").alias("raw")).select(model.normalised(F.col("raw"), rules).alias("n")).select("n.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_lines_of_an_answer_are_read_once(spark):
    rows = spark.createDataFrame([('Decision : "SPLIT"\nconfidence: 0.5\nReason: a: b\nreason: null',), ("confidence: 1_0",), ("x",), (None,)], "raw string")
    found = rows.select(model.boundary_payload(F.col("raw"), F.lit(None).cast("string")).alias("p")).select("p.decision", "p.reason", "p.confidence")
    assert [tuple(r) for r in found.collect()] == [("SPLIT", None, 0.5), (None, None, 10.0), (None, None, None), (None, None, None)]
    asked = model.boundary_payload(F.col("raw"), F.lit(None).cast("string"))
    assert rows.select(asked.alias("p"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2


def test_repaired_json_of_texts_that_begin_as_none(spark):
    raw = [None, "", "nothing", "{", ' \n{"a": 1}', '[{"a": 1}]', 'x {"a": 1}', '"{"', "5 {}", 'true, {"a": [1', "-{}"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string")
    assert [r.x for r in rows.select("i", text.repaired_json("raw").alias("x")).orderBy("i").collect()] == [None, None, None, None, ' \n{"a": 1}', None, '{"a": 1}', None, None, None, "{}"]


def test_normalised_boundary(spark):
    rows = [("split", 0.8, 0.0, 10.0), ("split", 0.9, 0.0, 10.0), ("trim", 0.9, 0.0, 10.0), ("odd", 0.9, 0.0, 10.0)]
    nothing = F.lit(None).cast("double")
    df = spark.createDataFrame(rows, "d string, c double, s double, e double")
    got = [r.x for r in df.select(model.normalised_boundary(F.col("d"), F.col("c"), F.col("s"), F.col("e"), nothing, nothing, nothing).alias("x")).collect()]
    assert [x.decision for x in got] == ["keep", "split", "trim", "keep"] and got[1].split_at == 5.0 and (got[2].new_start, got[2].new_end) == (0.75, 9.25)


def test_review(spark):
    rows = spark.createDataFrame([("s1", True, False, None, True, None, 0.4, False, False, "scene-snap", 0.62)], "segment_id string, shortlisted boolean, clip_gated boolean, budget_capped boolean, deduplicated boolean, dedup_group int, clip_score double, understood boolean, validated boolean, boundary_strategy string, boundary_confidence double")
    r = review.review_state(rows).first().review
    assert r.blocked_reason == "duplicate" and r.boundary == "Scene snapped" and r.path == "screened -> shortlisted -> vector scored -> deduplicated"


def test_refined_by_transcript(spark):
    seeds = spark.createDataFrame([(1, 1, 1.0, 2.0, 30.0), (1, 2, 20.0, 22.0, 30.0)], "asset_id int, seed_id int, start_sec double, end_sec double, duration_sec double")
    turns = spark.createDataFrame([(1, 0.8, 2.4, "Why is that?"), (1, 3.5, 6.0, "Because of this.")], "asset_id int, start_sec double, end_sec double, text string")
    got = intervals.refined_by_transcript(seeds, turns, turns).collect()
    assert [(r.seed_id, r.refined.start, r.refined.end, r.refined.strategy) for r in got] == [(1, 0.8, 6.0, "turn-snap")]


def test_gathered(spark):
    rows = spark.createDataFrame([("g", 2, "s2", ["b", "a"], []), ("g", 1, "s1", ["a"], None)], "g string, pos int, id string, x array<string>, y array<string>")
    r = review.gathered(rows, ["g"], ["x", "y"], "pos", "id").first()
    assert (r.x, r.y) == (["a", "b"], ["s1", "s2"])
