"""Registered queries of derived columns: texts, lists, states, gates and records of segments."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import assembly, evaluate, graph, intervals, media, model, review, scoring, selection, sequence, signals, views
from ..sources import artifacts
from ..sources.scratch import shared_folder
from . import adapters
from .queries import _clips_of, _doubtful, _takes, joined, query

def _id() -> Column:
    return F.col("segment_id")


def _one_of(n: Column, *values: str | None) -> Column:
    """The value that n names, from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful segments with all that a review record tells of."""
    rows = _doubtful(spark, sf_dir)
    no = F.array().cast("array<string>")
    duplicate = _id() % 13 == 0
    return rows.withColumns(
        {
            "shortlisted": _id() % 7 != 0,
            "filtered_before_vlm": _id() % 7 == 0,
            "clip_score": F.when(_id() % 5 != 0, F.col("visual_novelty")),
            "clip_gated": _id() % 11 == 0,
            "deduplicated": duplicate,
            "dedup_group_id": F.when(duplicate, (_id() % 10).cast("int")),
            "vlm_budget_capped": _id() % 17 == 0,
            "provider": _one_of(_id(), None, "deterministic", "local"),
            "keyframe_count": F.when(_id() % 3 > 0, (_id() % 2 + 3).cast("int")),
            "source_ids": F.when(F.col("operation") == "", no).otherwise(F.array(F.concat(F.lit("s"), _id().cast("string")), F.lit("t"))),
            "seed_ids": F.when(_id() % 4 == 1, no).otherwise(F.array(F.lit("a"), F.lit("b"))),
            "seed_sources": F.array(F.lit("scene"), F.lit("audio-peak")),
            "validation_status": _one_of(_id(), "validated", "fallback", "skipped", None),
            "validation_decision": _one_of(_id(), "keep", "trim", "split"),
            "validation_confidence": F.col("stability"),
            "validation_reason": F.lit("Cut Inside"),
            "skip_reason": F.when(_id() % 8 == 2, "over_budget"),
            "transcript_runtime": _one_of(_id(), "ready", "fallback", "disabled", "partial"),
            "looked_up": _id() % 5 != 0,
            "structure_label": _one_of(_id(), "question-answer-flow", "monologue-continuity", ""),
            "structure_cues": F.when(_id() % 2 == 0, F.array(F.lit("asks_first"), F.lit("short_pause"), F.lit("one_voice"), F.lit("more"))).otherwise(no),
        }
    )


@query
def review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).withColumn("review", review.review_record()).select("asset_id", "segment_id", "review.*")


@query
def segment_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doubtful(spark, sf_dir)
    return rows.select("segment_id", review.description(F.col("asset_name"), F.col("start_sec"), F.col("end_sec"), F.col("analysis_mode"), F.col("transcript_excerpt")).alias("description"))


@query
def take_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _takes(spark, sf_dir).withColumns({"drivers": _one_of(_id(), "sharpness", "stability and duration fit"), "limiting": _one_of(_id(), "", "motion energy", "")})
    return rows.select("segment_id", selection.reason(F.col("drivers"), F.col("limiting")).alias("reason"))


@query
def sequence_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doubtful(spark, sf_dir).withColumn("story_roles", F.when(_id() % 5 == 0, F.array(F.lit("opener"), F.lit("bridge"))).otherwise(F.array().cast("array<string>")))
    role = scoring.visual_role(F.col("visual_novelty"), F.col("motion_energy"), F.col("subject_clarity"))
    return rows.select("segment_id", role.alias("visual_role"), sequence.story_role().alias("story_role"), numeric.rounded(sequence.suggested_duration(), 4).alias("duration"), numeric.rounded(numeric.divided(F.col("end_sec") - F.col("start_sec"), _id() % 3), 4).alias("part"))


@query
def clip_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doubtful(spark, sf_dir)
    entries = F.when(_id() % 5 == 0, F.create_map(F.lit("score"), F.col("sharpness"))).when(_id() % 5 < 4, F.create_map(F.lit("score"), F.col("sharpness"), F.lit("clip_score"), F.col("visual_novelty")))
    return rows.select("segment_id", scoring.clip_score(entries).alias("clip_score"))


@query
def validation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doubtful(spark, sf_dir)
    s, e = F.col("start_sec"), F.col("end_sec")
    seeds = F.array(F.struct((s - 1.0).alias("start"), (e + 0.5).alias("end")), F.struct((s + 2.0).alias("start"), (s + 2.0 + (_id() % 3).cast("double")).alias("end")))
    first = F.col("targeted_x")
    rows = rows.withColumns({"targeted": _id() % 3 == 0}).withColumn("targeted_x", selection.initial_validation(True, True)).withColumn("unavailable_x", selection.initial_validation(True, False))
    return rows.select(
        "segment_id",
        numeric.rounded(selection.seed_drift(s, e, seeds), 4).alias("drift"),
        first["status"].alias("status"),
        F.col("unavailable_x")["status"].alias("status_without_model"),
        F.col("unavailable_x")["skip_reason"].alias("skip_without_model"),
        selection.clamped_range_value(s + (_id() % 9 - 4).cast("double"), s, F.lit(0.0), F.col("duration_sec")).alias("moved_start"),
        F.coalesce(selection.split_supported(), F.lit(False)).alias("split_supported"),
    )


@query
def label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.table(spark, sf_dir, "part")
    items = F.concat(F.split("p_name", " "), F.array(F.lit(""), F.upper(F.element_at(F.split("p_name", " "), 1)), F.element_at(F.split("p_name", " "), 1)))
    some = F.slice(text.dedupe_labels(items), F.lit(1), (F.col("p_partkey") % 4).cast("int"))
    return p.select("p_partkey", text.human_join(some).alias("told"), joined(text.dedupe_labels(items)).alias("labels"), joined(text.distinct_ignoring_case(items)).alias("spellings"))


@query
def text_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.table(spark, sf_dir, "documents")
    label = F.when(F.col("doc_id") % 6 == 0, " Short  Sentence ").when(F.col("doc_id") % 6 == 1, "item 7").when(F.col("doc_id") % 6 == 2, "").when(F.col("doc_id") % 6 == 3, "short walk").otherwise(F.col("source"))
    return d.select("doc_id", text.detects_text("text").alias("has_text"), text.is_placeholder(label).alias("placeholder"), text.model_matches(F.col("source"), F.concat(F.lit("org/"), F.upper("source"), F.lit("-4bit"))).alias("same_model"), text.model_matches(F.col("source"), F.col("lang")).alias("other_model"))


@query
def json_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    n = F.col("event_id") % 6
    whole = F.concat(F.lit('{"k": "'), F.col("k"), F.lit('", "list": [1, 2], "text": "a, b"}'))
    raw = (
        F.when(n == 0, whole)
        .when(n == 1, F.concat(F.lit("Here it is: "), whole, F.lit(" as asked")))
        .when(n == 2, F.concat(F.lit('{"k": "'), F.col("k"), F.lit('", "list": [1, 2')))
        .when(n == 3, F.concat(F.lit("k: "), F.col("k"), F.lit("\nnote: none")))
        .when(n == 4, "no object here")
        .otherwise(F.concat(F.lit('{"k": "'), F.col("k"), F.lit('", "list": [1, 2], "text": "cut')))
    )
    # What has no object is read as 'key: value' lines, as answers about boundaries are.
    found = e.withColumns({"found": text.repaired_json(raw), "lines": text.key_values(raw, ("k",))})
    told = F.coalesce(F.col("lines.k.text"), text.told_number(F.col("lines.k.number")))
    k = F.when(F.col("found").isNotNull(), F.get_json_object("found", "$.k")).otherwise(told)
    return found.select("event_id", k.alias("k"), F.get_json_object("found", "$.list").alias("list"), F.get_json_object("found", "$.text").alias("text"))


@query
def rational_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 5000).cast("double") / F.lit(48.0)).alias("seconds"))
    told = e.withColumn("told", text.rational_time("seconds"))
    return told.select("event_id", "told", numeric.rounded(text.rational_seconds("told"), 6).alias("seconds"))


def _ranges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.spans(spark, sf_dir)
    return rows.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_sec").alias("start"), F.col("end_sec").alias("end")))).alias("ranges"))


@query
def pause_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranges_of(spark, sf_dir).withColumn("gaps", intervals.gap_stats(F.col("ranges")))
    ends = F.transform(intervals.scene_boundaries(F.col("ranges")), lambda x: numeric.fixed3(x))
    return rows.select("asset_id", F.col("gaps.largest").alias("largest"), F.col("gaps.mean").alias("mean"), joined(ends).alias("boundaries"))


@query
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.segments(spark, sf_dir).select("segment_id", F.posexplode(numeric.keyframe_timestamps(F.col("start_sec"), F.col("end_sec"))).alias("pos", "t"))


@query
def runtime_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per order; the worst state, and how warm the caches were, by priority."""
    o = adapters.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select("o_orderkey", "o_orderpriority", views.runtime_status(k % 5 != 0, k % 97 == 0, k % 3, k % 2).alias("status"), views.cache_activity(k % 3, k % 4).alias("cache"))
    worst = rows.groupBy("o_orderpriority").agg(views.worst_status(F.col("status")).alias("worst"))
    return rows.join(worst, "o_orderpriority").select(F.col("o_orderkey").alias("run_id"), "status", "cache", "worst")


@query
def boundary_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doubtful(spark, sf_dir)
    given = F.when(_id() % 2 == 0, F.col("start_sec") + 0.3)
    x = model.normalised_boundary(_one_of(_id(), "keep", "TRIM", "extend", "split", "odd"), F.col("stability") + 0.1, F.col("start_sec"), F.col("end_sec"), given, F.lit(None).cast("double"), F.lit(None).cast("double"))
    return rows.withColumn("x", x).select("segment_id", "x.*")


@query
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doubtful(spark, sf_dir).withColumn("rules", scoring.understanding())
    good = F.concat(F.lit('{"shot_type": " wide ", "camera_motion": "short label", "mood": "calm", "story_roles": ["opener", "item 1"], "quality_findings": [], "keep_label": "KEEP", "confidence": "1.5", "risk_flags": ["n/a"]}'))
    raw = F.when(_id() % 3 == 0, good).when(_id() % 3 == 1, F.concat(F.lit("Sure: "), good)).otherwise("nothing")
    x = rows.withColumn("x", model.normalised(raw, F.col("rules")))
    return x.select("segment_id", "x.shot_type", "x.camera_motion", "x.mood", "x.keep_label", "x.confidence", *(joined(F.col(f"x.{c}")).alias(c) for c in ("story_roles", "quality_findings", "risk_flags")))


@query
def task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of cached, live and fallback results by asset."""
    tasks = adapters.segments(spark, sf_dir).select("asset_id", _id().cast("string").alias("cache_key"), "segment_id")
    result = lambda rows, label: rows.select("cache_key", F.concat(F.lit(label), F.col("cache_key")).alias("result"))
    done = model.resolved(tasks, result(tasks.where(_id() % 3 == 0), "c"), result(tasks.where(_id() % 3 <= 1), "l"), result(tasks, "f"))
    one = model.run_stats(done).select(F.lit(-1).cast("long").alias("asset_id"), F.col("live_count").alias("live"), F.col("cached_count").alias("cached"), F.col("fallback_count").alias("fallback"), "requests", F.lit("").alias("first"))
    each = done.groupBy("asset_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("live", "cached", "fallback")), F.count(F.lit(1)).alias("requests"), F.min("result").alias("first"))
    return each.unionByName(one)


@query
def evidence_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.segments(spark, sf_dir).select("asset_id", "segment_id", "pos", "start_sec", "end_sec", "prefilter_score")
    before = rows.where(_id() % 4 != 0).select("segment_id", F.when(_id() % 3 == 0, F.col("start_sec") + 1).otherwise(F.col("start_sec")).alias("start_sec"), "prefilter_score")
    return review.evidence_reuse(review.evidence(rows), before, compared=("start_sec", "prefilter_score")).select("segment_id", "context_start", "context_end", "reused")


@query
def gathered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.segments(spark, sf_dir).select("asset_id", "segment_id", "pos", F.floor(F.col("pos") / 3).alias("chain"))
    no = F.array().cast("array<string>")
    rows = rows.withColumns({"seeds": F.when(F.col("pos") % 2 == 0, F.array(_one_of(_id(), "scene", "audio-peak"), F.lit("clip"))).otherwise(no), "sources": F.when(F.col("chain") % 2 == 0, F.array(_one_of(_id(), "x", "y", "z"))).otherwise(no)})
    found = review.gathered(rows, ["asset_id", "chain"], ["seeds", "sources"], "pos", "segment_id")
    return found.select("asset_id", "chain", joined(F.col("seeds")).alias("seeds"), joined(F.col("sources")).alias("sources"))


@query
def set_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = adapters.segments(spark, sf_dir).where("start_sec < 6").groupBy("asset_id").agg(F.collect_set(_one_of(_id(), "opener", "bridge", "payoff", "detail")).alias("seen"))
    x = evaluate.set_checks(F.array(F.lit("opener"), F.lit("bridge")), F.when(F.col("asset_id") % 2 == 0, F.array(F.lit("payoff"), F.lit("odd"))).otherwise(F.array().cast("array<string>")), F.col("seen"))
    return seen.withColumn("x", x).select("asset_id", joined(F.col("x.missing")).alias("missing"), joined(F.col("x.unwanted")).alias("unwanted"), "x.passed")


@query
def validated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.segments(spark, sf_dir).where("prefilter_score is not null and end_sec > start_sec").select("asset_id", "segment_id", "start_sec", "end_sec", "duration_sec")
    s, e = F.col("start_sec"), F.col("end_sec")
    answers = rows.where(_id() % 6 != 0).select(
        "segment_id",
        _one_of(_id(), "keep", "trim", "extend", "split").alias("decision"),
        (s + (_id() % 5 - 2).cast("double") * 0.75).alias("new_start"),
        F.when(_id() % 7 != 0, e + (_id() % 3 - 1).cast("double") * 2).alias("new_end"),
        ((s + e) / 2).alias("split_at"),
        (_id() % 8 != 3).alias("supported"),
    )
    return assembly.validated(rows, answers).select("asset_id", "segment_id", "start_sec", numeric.rounded("end_sec", 3).alias("end_sec"), "applied")


@query
def seed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of a quarter of the clips lie beyond their end, and a seventh of the clips has no frames."""
    clips = adapters.assets(spark, sf_dir)
    n = F.col("asset_id")
    peaks = lambda test, start, width: clips.where(test).select("asset_id", start.cast("double").alias("start_sec"), (start.cast("double") + width).alias("end_sec"))
    scenes = intervals.fallback_scenes(clips, "asset_id", "duration_sec").join(clips.select("asset_id", "duration_sec"), "asset_id")
    shift = F.when(n % 4 == 0, F.col("duration_sec")).otherwise(F.lit(0.0))
    scenes = scenes.select("asset_id", "pos", (F.col("start_sec") + shift).alias("start_sec"), (F.col("end_sec") + shift).alias("end_sec"))
    # Equal to the first scene of long clips; under a second; much and little overlap; beyond the end.
    seen = peaks(n % 3 == 0, F.lit(0), 5.5).unionByName(peaks(n % 3 == 1, n % 5, 3.0))
    heard = peaks(n % 3 == 1, n % 5, 0.5).unionByName(peaks(n % 3 == 0, n % 5, 3.25)).unionByName(peaks(n % 15 == 2, n % 40, 8.0))
    return intervals.seed_regions(scenes, seen, heard, clips, framed=clips.where(n % 7 != 0))


@query
def segment_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame means of windows of four seconds; empty ones take the nearest frame."""
    clips = adapters.assets(spark, sf_dir)
    named = clips.select(F.col("asset_id").alias("id"), F.col("asset_name").alias("name"), F.col("asset_name").alias("source_path"), F.col("asset_name").alias("proxy_path"), F.col("asset_name").alias("interchange_reel_name"), "duration_sec")
    windows = clips.select("asset_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration_sec") / 4).cast("int"))).alias("segment_id")).withColumns({"start_sec": _id() * 4.0, "end_sec": _id() * 4.0 + 3.0})
    matched = intervals.inside_or_nearest(signals.seeded_signals(named), windows, "asset_id", "segment_id", "timestamp_sec", "start_sec", "end_sec")
    found = signals.frame_aggregates(matched, ["asset_id", "segment_id"])
    return found.select("asset_id", "segment_id", "mean_score", "mean_sharpness", "mean_distinctiveness", "mean_motion_energy", "mean_brightness", "mean_contrast", "subject_clarity", "stability", F.size("sampled_sec").alias("n"), F.get("top_sec", 0).alias("best_sec"))


@query
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviewed(spark, sf_dir)
    return views.run_counters(rows.withColumn("r", review.review_record()), budget_pct=40.0)


@query
def runtime_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's counters with its timings, rates and modes."""
    from ..config import EngineConfig

    return evaluate.runtime_record(run_counters(spark, sf_dir), {"per_asset_analysis": 1195.0, "take_selection": 4.25, "timeline_assembly": 1.75}, EngineConfig(concurrency=2), provider="lmstudio")


@query
def runtime_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as runs: how long each took, and against the run before."""
    rows = _clips_of(adapters.spans(spark, sf_dir))
    before = rows.select((F.col("asset_id") + 1).alias("asset_id"), F.col("duration_sec").alias("before"))
    rows = evaluate.compared(rows.join(before, "asset_id"), "duration_sec", "before")
    return rows.select("asset_id", text.runtime_text(F.col("duration_sec") * 60).alias("runtime"), text.delta_text(F.col("delta"), F.when(F.col("asset_id") % 2 == 0, F.col("delta_pct"))).alias("told"))


@query
def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two runs stored in a cache table and looked up: the later run's count, keys that no run wrote are missing."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = adapters.segments(spark, sf_dir).select("segment_id", artifacts.artifact_key(F.col("asset_id"), F.col("asset_name")).alias("asset_key"), "prefilter_score")
    rows = rows.withColumn(artifacts.KEY, F.concat_ws("|", "asset_key", _id().cast("string")))
    artifacts.store(rows.where(_id() % 3 != 0).withColumn("answer", F.concat(F.lit("first "), _id().cast("string"))), path, 1)
    artifacts.store(rows.where(_id() % 3 == 1).withColumn("answer", F.concat(F.lit("second "), _id().cast("string"))), path, 2)
    found = artifacts.looked_up(spark, path, rows.where(_id() % 2 == 0))
    return found.select("segment_id", "asset_key", "prefilter_score", "answer")


@query
def screening_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rows as an artifact: of the right version and key, without assets that have a malformed row, rounded again."""
    rows = adapters.audio(spark, sf_dir).select("asset_id", "event_id", (F.col("t") / 7).alias("timestamp_sec"), "rms_energy")
    n = F.col("event_id")
    rows = rows.withColumns({"schema_version": F.when(n % 50 == 0, 2).otherwise(1), "compatibility_key": F.when(n % 40 == 1, "old").otherwise("now"), "rms_energy": F.when(n % 701 == 0, None).otherwise(F.col("rms_energy") / 3)})
    return artifacts.screening_rows(rows, "now", ["rms_energy"]).select("asset_id", "event_id", "timestamp_sec", "rms_energy")


@query
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of all, and the latest of a dataset that a fixture set was evaluated on."""
    o = adapters.table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("completed_at"), F.col("o_orderpriority").alias("dataset_fingerprint"), F.col("o_orderstatus").alias("fixture_set"))
    every = artifacts.last_row(rows, "completed_at")
    own = evaluate.last_match(rows, "2-HIGH", "completed_at", fixture_set="P")
    return every.withColumn("what", F.lit("last")).unionByName(own.withColumn("what", F.lit("evaluated"))).select("what", "run_id", "dataset_fingerprint", "fixture_set")


@query
def asset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset ids in order of their source path."""
    m = adapters.media(spark, sf_dir).select(F.col("path").alias("source_path"))
    return media.with_asset_ids(m)


@query
def model_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.table(spark, sf_dir, "part")
    name = F.concat(F.lit(" org/"), F.col("p_name"), F.lit(":"), F.col("p_size").cast("string"), F.lit(" "))
    return p.select("p_partkey", text.model_slug(name).alias("slug"), text.model_key(name, F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("")).alias("key"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as changes that depend on one a little later, and on one far on that may not be there."""
    n = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    return adapters.table(spark, sf_dir, "part").select(
        name(n).alias("name"),
        _one_of(n, "umbrella", "implementation", "implementation", "odd").alias("kind"),
        F.when(n % 3 == 0, name(n * 2)).alias("parent"),
        (F.col("p_size") % 7).cast("int").alias("phase"),
        F.array(name(n + 1), name(n + F.col("p_size") * 9)).alias("depends_on"),
    )


@query
def change_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.change_errors(_changes(spark, sf_dir))


@query
def change_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.blocked_by(_changes(spark, sf_dir)).select("name", joined(F.col("blocks")).alias("blocks"))


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as changes: chains of ten, some of them bent back into cycles, some joined."""
    p = F.col("p_partkey")
    tens, first = F.floor(p / 10), p % 10 == 0
    needs = {
        "chain": (p % 10 != 0, p - 1),
        "ring": (first & (tens % 7 == 0), p + 4),
        "knot": (first & (tens % 11 == 0), p + 2),
        "second ring": ((p % 10 == 6) & (tens % 11 == 0), p + 3),
        "loop": ((p % 10 == 5) & (tens % 13 == 0), p),
        "joined": (p % 100 == 10, p - 10),
    }
    rows = adapters.table(spark, sf_dir, "part")
    every = F.array(*(F.when(test, other) for test, other in needs.values()))
    edges = rows.select(p.alias("after"), F.explode(F.array_compact(every)).alias("before"))
    # Not broadcast: a file of parts is small and has very many keys, which would all go through the driver.
    return edges.join(rows.select(p.alias("before")).hint("merge"), "before", "left_semi").select("before", "after")


@query
def change_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes on cycles, with a successor on their cycle."""
    return graph.cycles(_dependencies(spark, sf_dir))


@query
def changes_held_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.held_up(_dependencies(spark, sf_dir))
