"""Registered queries of what is detected, decoded, written and read: scenes, frames, timelines, documents, histories, answers."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import numeric
from ..operators import dedup, model, review, scenes, signals, summary
from ..sources import documents, files, histories, timeline_xml
from ..sources.scratch import checkpointed, shared_folder
from . import adapters
from .queries import _doubtful, _labelled, _scored, _timeline, joined, query


@query
def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of their users: scenes of an hour or more between jumps of energy, fallback windows without one."""
    frames = adapters.audio(spark, sf_dir).select("asset_id", "t", F.col("rms_energy").alias("change"))
    clips = frames.groupBy("asset_id").agg((F.floor(F.max("t")) + 7200.0).alias("duration_sec"))
    return scenes.scenes(frames, clips, floor=0.2, ratio=1.5, reach=3, least=3600.0)


@query
def frame_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as gray images of 8 x 8, decoded and measured as the frames of their label."""
    rows = adapters.table(spark, sf_dir, "embeddings")
    pixel = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5).cast("int")))
    pixels = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(pixel(x)), 2, "0")), ""))
    images = rows.select(F.col("label").alias("asset_id"), F.col("vec_id").cast("double").alias("timestamp_sec"), F.concat(F.encode(F.lit("P5\n# a vector\n8 8\n255\n"), "UTF-8"), pixels).alias("content"))
    found = signals.measured_signals(signals.decoded_frames(images))
    return found.drop("source")


@query
def timeline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timelines of all scopes, written as XML and read again."""
    n = F.col("asset_id")
    items = _timeline(spark, sf_dir).select("scope", "take_id", "order_index", "trim_in_sec", "trim_out_sec", "label", "segment_id", "asset_id", "start_sec")
    items = checkpointed(items)
    clips = adapters.assets(spark, sf_dir).select(
        "asset_id", F.col("asset_name").alias("name"), F.concat(F.lit("/media/a & b/"), "asset_name", F.lit(".mov")).alias("source_path"),
        F.when(n % 9 > 0, F.concat(F.lit("reel-"), (n % 9).cast("string"))).otherwise("").alias("interchange_reel_name"),
        F.concat_ws(":", F.lit("00"), F.concat(F.lit("0"), (n % 6).cast("string")), F.concat(F.lit("1"), (n % 10).cast("string")), F.concat(F.lit("0"), (n % 8).cast("string"))).alias("source_timecode"),
        F.lit(24.0).alias("fps"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), "duration_sec", "has_speech",
    )
    rows = timeline_xml.clips(items.select("scope", "take_id", "order_index", "trim_in_sec", "trim_out_sec", "label"), items, items, clips)
    found = timeline_xml.parsed(timeline_xml.exported(rows, "cut"))
    return found.select("scope", "pos", "name", "asset_uid", *(numeric.rounded(c, 6).alias(c) for c in ("offset_sec", "start_sec", "duration_sec")))


@query
def project_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip as a project document with its segments and takes, written as JSON and read again."""
    clips = adapters.assets(spark, sf_dir)
    # Segments and takes are of the same rows, which are made once.
    segments = checkpointed(adapters.segments(spark, sf_dir).select("asset_id", "segment_id", "pos", "start_sec", "end_sec", "transcript_excerpt", "sharpness", "stability", "prefilter_score"))
    project, asset = F.col("asset_id").alias("project_id"), F.col("asset_id").cast("string")
    name = F.concat(F.lit("s"), F.col("segment_id").cast("string"))
    metrics = F.create_map(*(x for c in ("sharpness", "stability") for x in (F.lit(c), F.col(c))))
    metrics = F.when(F.col("sharpness").isNotNull() & F.col("stability").isNotNull(), metrics).otherwise(F.map_filter(metrics, lambda _, v: v.isNotNull()))
    frames = {
        "project": clips.select(project, F.concat(F.lit("p"), asset).alias("id"), F.col("asset_name").alias("name"), F.lit("done").alias("status"), F.array(F.lit("/media")).alias("media_roots"), F.concat(F.lit('the "story" of\n'), "asset_name").alias("story_summary")),
        "assets": clips.select(project, F.lit(0).alias("pos"), asset.alias("id"), F.col("asset_name").alias("name"), "duration_sec", "has_speech"),
        "segments": segments.select(project, "pos", name.alias("id"), asset.alias("asset_id"), "start_sec", "end_sec", "transcript_excerpt", metrics.alias("quality_metrics")),
        "takes": segments.select(project, "pos", F.concat(F.lit("t"), "segment_id").alias("id"), name.alias("candidate_segment_id"), (F.col("pos") == 1).alias("is_best_take"), F.col("prefilter_score").alias("score_total")),
    }
    found = documents.projects(documents.project_documents(frames))
    takes = found["takes"].select("project_id", F.col("candidate_segment_id").alias("id"), F.col("pos").alias("take_pos"), "is_best_take", "score_total")
    rows = documents.flat_metrics(found["segments"], ("sharpness", "stability")).join(takes, ["project_id", "id"]).drop("asset_id")
    heads = found["project"].select("project_id", F.col("name").alias("project_name"), "story_summary").join(found["assets"].select("project_id", "duration_sec", "source_timecode", "has_proxy"), "project_id")
    return heads.join(rows, "project_id", "left").select("project_id", "project_name", "story_summary", "duration_sec", "source_timecode", "has_proxy", F.col("id").alias("segment"), "pos", "take_pos", "start_sec", "end_sec", "transcript_excerpt", "sharpness", "stability", "is_best_take", "score_total")


@query
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a priority and year as a run: all runs written, some once more, every second year evaluated later."""
    o = adapters.table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    runs = o.groupBy(F.concat_ws(" ", "o_orderpriority", F.col("year").cast("string")).alias("run_id"), "year").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("total_runtime_sec"))
    runs = checkpointed(runs)
    path, schema = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}", "run_id string, year int, n_orders long, total_runtime_sec double, fixture_set string, passed boolean"
    histories.write_runs(runs, path)
    histories.write_runs(runs.where("year % 3 = 0"), path)
    checked = runs.where("year % 2 = 0").select("run_id", F.lit("story").alias("fixture_set"), (F.col("n_orders") % 2 == 0).alias("passed"))
    histories.evaluate_runs(spark, path, checked.unionByName(spark.range(1).select(F.lit("no such run").alias("run_id"), F.lit("story").alias("fixture_set"), F.lit(True).alias("passed"))), schema)
    return histories.runs(spark, path, schema)


@query
def evidence_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier evidence that differs in one field of eleven, or in none, or isn't there."""
    n = F.col("segment_id")
    metrics = F.create_map(F.lit("sharpness"), F.coalesce("sharpness", F.lit(0.0)), F.lit("stability"), F.coalesce("stability", F.lit(0.0)))
    rows = _scored(spark, sf_dir).select(
        "asset_id", "segment_id", "pos", "start_sec", "end_sec", F.concat(F.lit("/media/"), "asset_name").alias("media_path"), "transcript_excerpt", F.lit("a story").alias("story_prompt"), "analysis_mode",
        F.lit("ready").alias("transcript_status"), F.lit("").alias("speech_mode_source"), metrics.alias("metrics"),
    )
    wanted = review.evidence(rows, keyframes=3)
    turned = F.create_map(F.lit("stability"), F.col("metrics")["stability"], F.lit("sharpness"), F.col("metrics")["sharpness"] + F.when(n % 13 == 9, 1.0).otherwise(0.0))
    change = {
        "media_path": F.lit("/other"), "transcript_excerpt": F.lit("other"), "story_prompt": F.lit("other"), "analysis_mode": F.lit("other"), "transcript_status": F.lit("other"), "speech_mode_source": F.lit("other"),
        "keyframe_sec": F.array(F.lit(0.5)), "context_start": F.col("context_start") + 1, "context_end": F.col("context_end") + 1, "metrics": turned, "keyframe_max_width": F.lit(0),
    }
    old = wanted.where(n % 13 != 12)
    old = old.select("segment_id", *((turned if c == "metrics" else F.when(n % 13 == i, v).otherwise(F.col(c))).alias(c) for i, (c, v) in enumerate(change.items())))
    found = review.evidence_reuse(wanted, old)
    return found.select("segment_id", "context_start", "context_end", F.array_join(F.transform("keyframe_sec", lambda t: t.cast("string")), "|").alias("keyframes"), F.coalesce(F.array_join("differs", "|"), F.lit("")).alias("differs"), "reused")


@query
def boundary_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about boundaries as JSON, within other text, cut off, as lines, and as neither."""
    n = F.col("segment_id")
    sure = ((n % 10).cast("double") / 10).cast("string")
    whole = F.concat(F.lit('{"decision": "trim", "reason": "late start", "confidence": '), sure, F.lit(', "suggested_start_sec": 1.5}'))
    raw = (
        F.when(n % 7 == 0, whole)
        .when(n % 7 == 1, F.concat(F.lit("Sure: "), whole))
        .when(n % 7 == 2, F.concat(F.lit('{"decision": "extend", "confidence": '), sure, F.lit(', "reason": "cut here')))
        .when(n % 7 == 3, F.concat(F.lit('Decision : "SPLIT"\nconfidence: '), sure, F.lit("\nShot Type: wide\nreason: null\nReason: two: parts")))
        .when(n % 7 == 4, '{"a": 1, "b": {"c": , "d": "x')
        .when(n % 7 == 5, "[1, 2]")
        .otherwise("nothing: at all")
    )
    rows = checkpointed(_doubtful(spark, sf_dir).select("segment_id", "start_sec", "end_sec", "duration_sec", raw.alias("raw")))
    rows = model.with_objects(rows, "raw", "found")
    rows = rows.withColumn("p", model.boundary_payload(F.col("raw"), F.col("found")))
    x = model.normalised_boundary(F.col("p.decision"), F.coalesce("p.confidence", F.lit(0.0)), F.col("start_sec"), F.col("end_sec"), F.col("p.suggested_start_sec"), F.col("p.suggested_end_sec"), F.col("p.split_point_sec"), duration=F.col("duration_sec"))
    rows = rows.withColumn("x", x)
    return rows.select("segment_id", F.get_json_object("found", "$.a").alias("salvaged"), F.col("p").isNotNull().alias("answered"), F.col("p.reason").alias("reason"), "x.*")


def _run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("segment_id"), F.col("asset_id")
    one_of = lambda *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    segments = _doubtful(spark, sf_dir).select(
        "asset_id", "segment_id", "analysis_mode", "transcript_excerpt", "ambiguity", (n % 13 == 0).alias("deduplicated"), F.when(n % 13 < 2, (n % 10).cast("int")).alias("dedup_group_id"), (n % 7 != 0).alias("shortlisted"),
        (n % 7 == 0).alias("filtered_before_vlm"), ((n % 3 == 0) & (n % 7 != 0)).alias("targeted"), F.when(n % 5 != 0, F.col("visual_novelty")).alias("clip_score"), (n % 11 == 0).alias("clip_gated"),
        one_of("threshold", "floor", "", None).alias("target_reason"), one_of("validated", "fallback", "skipped", None).alias("validation_status"), (n % 8 == 0).alias("validation_applied"),
        one_of("live", "cached", "fallback").alias("ai_status"), one_of("question-answer-flow", "monologue-continuity", "").alias("structure_label"),
    )
    flags = {
        "has_audio_signal": k % 3 != 0, "transcript_targeted": k % 2 == 0, "transcript_skipped": k % 5 == 1, "transcript_probed": k % 4 == 0, "transcript_probe_rejected": k % 8 == 0, "transcribed": k % 6 == 0,
        "transcript_failed": k % 50 == 0, "transcript_cached": k % 12 == 0, "preprocessing_cached": k % 7 != 0,
    }
    assets = adapters.assets(spark, sf_dir).select("asset_id", *(v.alias(name) for name, v in flags.items()))
    spoken = F.col("analysis_mode") == "speech"
    items = _labelled(spark, sf_dir).select((F.col("scope") * 100_000 + F.col("order_index")).alias("order_index"), "analysis_mode", F.when(F.col("order_index") == 0, "setup").otherwise("development").alias("sequence_group"), F.when(spoken, "spoken beat").otherwise("visual bridge").alias("sequence_role"), "drivers", "tradeoffs")
    facts = {"transcript_provider_configured": "auto", "transcript_provider_effective": "local", "transcript_status": "ready", "transcript_available": True, "transcript_enabled": True, "transcript_model_size": "small", "ai_live_request_count": 17}
    return summary.analysis_summary(segments, assets, adapters.audio(spark, sf_dir), items, EngineConfig(budget_pct=40.0), facts, {"per_asset_analysis": 1195.0, "take_selection": 4.25, "timeline_assembly": 1.75})


@query
def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of a run in one row."""
    found = _run_summary(spark, sf_dir)
    return found.withColumns({c: joined(F.col(c)) for c in ("runtime_degraded_reasons", "runtime_intentional_skip_reasons")})


@query
def stability_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.stability_record(_run_summary(spark, sf_dir), "lmstudio", EngineConfig(budget_pct=40.0))
    return found.withColumns({c: joined(F.col(c)) for c in ("degraded_reasons", "intentional_skip_reasons")})


@query
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stability record as lines of a log."""
    return summary.log_lines(stability_record(spark, sf_dir))


@query
def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that show the image of a vector, most of them the same as others, scored against five prompts."""
    vectors = adapters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.col("embedding").cast("array<double>").alias("vector"))
    shown = adapters.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 97).alias("image"))
    prompt = lambda k: [1.0 if i % (k + 2) == 0 else -0.5 for i in range(64)]
    return dedup.image_scores(shown, vectors.where("image % 10 <> 3"), [prompt(k) for k in range(3)], [prompt(k) for k in range(3, 5)]).select("doc_id", "image", "clip_score")


@query
def screened_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of a sound log, read as samples and silences, at a grid of times."""
    n = F.col("event_id")
    t = F.round((n % 400) * 0.25, 2)
    rows = adapters.audio(spark, sf_dir).where("event_id % 400 < 396")
    # A user's log is in the order of time; of one time only the first event counts.
    first = rows.groupBy("asset_id", t.alias("at")).agg(F.min("event_id").alias("event_id"))
    level = F.when(n % 17 == 0, "-inf").otherwise((-(n % 60)).cast("string"))
    silence = F.when(n % 5 == 0, F.array(F.concat(F.lit("silence_start: "), F.col("at").cast("string")), F.concat(F.lit("silence_end: "), (F.col("at") + 0.75).cast("string")))).otherwise(F.array().cast("array<string>"))
    told = F.concat(silence, F.array(F.concat(F.lit("pts_time:"), F.col("at").cast("string")), F.concat(F.lit("RMS_level="), level)))
    log = first.select("asset_id", "at", F.posexplode(told).alias("i", "line")).select("asset_id", (F.col("at") * 100 + F.col("i")).cast("long").alias("line_no"), "line")
    silences, samples = files.silence_rows(checkpointed(log))
    grid = first.select("asset_id").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(98), F.lit(7)))).withColumn("t", F.col("t") + 0.125)
    return signals.audio_rows(samples, silences, grid)


@query
def transcriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations transcribed, some from a cache, some failing, each with its state, number of spans and last end."""
    path = F.concat(F.lit("/media/"), F.col("asset_id").cast("string"), F.lit(".mov"))
    key = documents.span_cache_key(path, F.col("asset_id") * 1000 + 7, F.col("asset_id") % 100, F.lit("small"))
    rows = adapters.spans(spark, sf_dir).select("asset_id", key.alias("cache_key"), "start_sec", "end_sec", "text")
    cached = rows.where("asset_id % 4 = 0").groupBy("cache_key").agg(F.array_sort(F.collect_list(F.struct("start_sec", (F.col("end_sec") + 1).alias("end_sec"), "text"))).alias("spans"))

    def transcribe(batch: pd.DataFrame) -> pd.DataFrame:
        if batch["asset_id"].iat[0] % 11 == 3:
            raise ValueError("no sound")
        return batch.assign(text=batch["text"].where(batch["start_sec"] < 20, " "))

    spans, states, fresh = model.transcribed(rows, cached, transcribe)
    ends = spans.groupBy("asset_id").agg(F.max("end_sec").alias("last_end"))
    keys = rows.select("asset_id", "cache_key").distinct()
    stored = fresh.select("cache_key", F.size("spans").cast("long").alias("n_stored"))
    return states.join(ends, "asset_id", "left").join(keys, "asset_id").join(stored, "cache_key", "left")


@query
def analyzed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments answered by one call per clip; clips whose call fails and rows that it leaves out fall back."""
    tasks = adapters.segments(spark, sf_dir).select("asset_id", "segment_id", "pos")

    def analyze(batch: pd.DataFrame) -> pd.DataFrame:
        if batch["asset_id"].iat[0] % 9 == 4:
            raise RuntimeError("busy")
        said = batch[batch["pos"] % 5 != 2]
        return pd.DataFrame({"segment_id": said["segment_id"], "result": [f"{p} of {len(batch)}" for p in said["pos"]]})

    return model.analyzed(tasks, analyze, "string", F.concat(F.lit("rule "), F.col("pos").cast("string")))
