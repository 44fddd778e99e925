"""The registered queries: callables of (spark, sf_dir), one per operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import assembly, dedup, evaluate, intervals, media, scoring, selection, sequence, signals, speech, views
from ..sources.scratch import checkpointed as saved
from ..sources.scratch import written
from . import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(items: Column) -> Column:
    return F.array_join(items, "|")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_scores(adapters.segments(spark, sf_dir))


def _takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ranked_takes(_scored(spark, sf_dir))


@query
def score_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("asset_id", "segment_id", "analysis_mode", "mode_source", "score_technical", "score_semantic", "score_story", "score_total")


@query
def take_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _takes(spark, sf_dir).select("asset_id", "asset_name", "segment_id", "take_id", "analysis_mode", "score_total", "within_asset_rank", "score_gap", "outcome", "is_selected")


@query
def best_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _takes(spark, sf_dir).where("is_selected").select("asset_id", "segment_id", "outcome", "score_total")


@query
def score_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.contributions(_scored(spark, sf_dir)).where("contribution > 0")


@query
def top_driver_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_drivers(scoring.with_shares(_scored(spark, sf_dir))).select("asset_id", "segment_id", joined(F.col("labels")).alias("labels"))


@query
def limiting_factor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = scoring.with_shares(_takes(spark, sf_dir))
    found = scoring.limiting_factors(takes, takes.where("within_asset_rank = 1"))
    return found.select("asset_id", "segment_id", joined(F.col("labels")).alias("labels"))


@query
def rule_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("u", scoring.understanding())
    lists = ("story_roles", "quality_findings", "risk_flags")
    return rows.select("segment_id", "u.confidence", "u.keep_label", "u.shot_type", "u.camera_motion", "u.mood", *(joined(F.col(f"u.{c}")).alias(c) for c in lists))


@query
def shortlist_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.shortlist(adapters.segments(spark, sf_dir).where("prefilter_score is not null"), limit=3).select("asset_id", "segment_id", "prefilter_score")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).where("prefilter_score is not null")
    return rows.withColumns({"shortlisted": F.col("segment_id") % 7 != 0, "gated": F.col("segment_id") % 11 == 0, "deduplicated": F.col("segment_id") % 13 == 0, "clip_score": F.when(F.col("segment_id") % 5 != 0, F.col("visual_novelty"))})


@query
def three_stage_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.staged_targets(_flagged(spark, sf_dir), limit=4, budget_pct=50.0).select("asset_id", "segment_id", "gate_score", "gate_rank", "stage")


def _doubtful(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).where("prefilter_score is not null")
    strategy = F.element_at(F.array(*map(F.lit, ("legacy", "turn-snap", "transcript-snap", "audio-snap", "scene-snap", "assembly-merge:structural-continuity"))), (F.col("segment_id") % 6 + 1).cast("int"))
    operation = F.when(F.col("segment_id") % 6 == 5, "merge").when(F.col("segment_id") % 4 == 0, "split").otherwise("")
    rows = rows.withColumns({"boundary_strategy": strategy, "operation": operation, "drift": (F.col("segment_id") % 5) * 0.25, "boundary_confidence": F.col("stability")})
    rows = rows.withColumns({"rule_family": F.when(F.col("operation") == "merge", "structural-continuity").otherwise(""), "turn_alignment": F.when(F.col("segment_id") % 2 == 0, "partial-turn").otherwise("turn-aligned"), "turn_count": (F.col("segment_id") % 3).cast("int"), "turn_completeness": F.col("visual_novelty")})
    return rows.withColumn("ambiguity", selection.ambiguity())


@query
def boundary_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubtful(spark, sf_dir).select("segment_id", "ambiguity")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ambiguity_targets(_doubtful(spark, sf_dir), threshold=0.75, floor=0.5)


@query
def ambiguity_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir).select("asset_id", "segment_id", "ambiguity", "target_rank", "target_reason")


@query
def budget_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.drained(_targets(spark, sf_dir), pct=30.0, most=1_000_000).select("asset_id", "segment_id", "run_rank", "status")


@query
def overrides_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = _takes(spark, sf_dir)
    second = takes.where("within_asset_rank = 2 and asset_id % 4 = 1").select("asset_id", F.col("segment_id").alias("override_segment"))
    cleared = takes.where("within_asset_rank = 1 and asset_id % 4 = 2").select("asset_id", F.lit(None).cast("long").alias("override_segment"))
    stale = takes.where("within_asset_rank = 1 and asset_id % 4 = 3").select("asset_id", F.lit(-1).cast("long").alias("override_segment"))
    rows = views.with_overrides(takes, second.unionByName(cleared).unionByName(stale))
    return rows.select("asset_id", "segment_id", "is_selected", "outcome", "editor_override", "editor_cleared")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = _takes(spark, sf_dir)
    seg = adapters.segments(spark, sf_dir).select("asset_id", "segment_id", "start_sec", "end_sec", "prefilter_score")
    owned = takes.where("within_asset_rank <= 2").select("segment_id", "take_id", "score_total")
    items = takes.where("is_selected").select("take_id", F.lit(True).alias("on_timeline"))
    return views.segment_views(seg, adapters.assets(spark, sf_dir), owned, items)


@query
def ranked_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ranked_view(_views(spark, sf_dir)).select("view_rank", "asset_name", "segment_id", "take_id", "score_total", "on_timeline")


@query
def clip_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.clip_view(_views(spark, sf_dir)).select("asset_id", "clip_rank", "segment_id", "take_id")


@query
def summary_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = _takes(spark, sf_dir)
    return views.run_summary(takes, takes)


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _takes(spark, sf_dir).where("is_selected")
    rows = rows.withColumn("scope", F.col("asset_id") % 20)
    order = Window.partitionBy("scope").orderBy("asset_id", "within_asset_rank")
    rows = rows.withColumns({"order_index": F.row_number().over(order) - 1, "trim_in_sec": F.lit(0.0), "trim_out_sec": F.least(F.col("end_sec") - F.col("start_sec"), F.lit(7.5))})
    return sequence.placed(rows, "scope").withColumn("source_reel", F.concat(F.lit("reel-"), (F.col("asset_id") % 9).cast("string")))


@query
def timeline_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.offsets(_timeline(spark, sf_dir), "scope").select("scope", "order_index", "segment_id", "offset_sec", "label", "sequence_group", "sequence_role")


@query
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.context_windows(adapters.segments(spark, sf_dir)).select("asset_id", "segment_id", "context_start", "context_end")


@query
def mode_alternations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _timeline(spark, sf_dir)
    return sequence.alternations(items, "scope").join(sequence.story_kind(items, "scope"), "scope")


@query
def timeline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.observed_state(_timeline(spark, sf_dir), "scope")
    return rows.select("scope", "item_count", *(joined(F.col(c)).alias(c) for c in ("reels", "roles", "groups")), "opener_reel", "closing_reel")


def _story_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _takes(spark, sf_dir).where("is_selected").withColumns({"scope": F.col("asset_id") % 50, "story_roles": F.array().cast("array<string>"), "turn_completeness": F.col("speech_ratio")})
    rows = rows.withColumns({"story_role": sequence.story_role(), "prompt_fit": (F.col("segment_id") % 5) * 0.02})
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("scope").orderBy("asset_id", "within_asset_rank")))


@query
def story_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.story_sequence(_story_takes(spark, sf_dir), "scope")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(_story_takes(spark, sf_dir))
    path = sequence.story_sequence(rows, "scope").select("take_id", "order_index")
    return sequence.labelled(rows.join(path, "take_id"), "scope")


@query
def sequence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("scope", "order_index", "take_id", joined(F.col("drivers")).alias("drivers"), joined(F.col("tradeoffs")).alias("tradeoffs"))


@query
def sequence_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.label_counts(_labelled(spark, sf_dir), "scope")


@query
def interval_signal_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.inside_or_nearest(adapters.audio(spark, sf_dir), adapters.ranges(spark, sf_dir), "asset_id", "range_id", "t", "start_sec", "end_sec", 20000.0)
    return found.groupBy("asset_id", "range_id").agg(F.count(F.lit(1)).alias("n"), F.min("matched").alias("matched"), numeric.rounded(F.avg("rms_energy"), 3).alias("energy"), numeric.rounded(F.count_if(~F.col("is_silent")) / F.count(F.lit(1)), 4).alias("speech_ratio"))


@query
def nearest_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.inside_or_nearest(adapters.audio(spark, sf_dir), adapters.ranges(spark, sf_dir, width=600.0), "asset_id", "range_id", "t", "start_sec", "end_sec", 20000.0)
    return found.where("matched = 'nearest'").select("asset_id", "range_id", "event_id", "t")


@query
def silence_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = adapters.ranges(spark, sf_dir).withColumnRenamed("range_id", "window_id")
    quiet = intervals.islands(adapters.event_spans(spark, sf_dir).where("text = 'error'"), "asset_id", "start_sec", "end_sec", 0.0)
    return signals.silence_share(windows, quiet, "asset_id", 40000.0).select("asset_id", "window_id", "is_silent")


@query
def sessionize_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.turns(adapters.event_spans(spark, sf_dir), gap=10800.0).select("asset_id", "turn", "turn_id", "start_sec", numeric.rounded("end_sec", 3).alias("end_sec"), "text", "span_count")


@query
def merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.islands(adapters.event_spans(spark, sf_dir), "asset_id", "start_sec", "end_sec", 3600.0)
    return found.select("asset_id", "start_sec", numeric.rounded("end_sec", 3).alias("end_sec"), "n")


@query
def speech_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.audio(spark, sf_dir).withColumn("rms_energy", F.col("rms_energy") * (F.col("asset_id") % 4) / 40)
    return speech.speech_gate(rows)


@query
def probe_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.audio(spark, sf_dir)
    length = rows.groupBy("asset_id").agg(F.max("t").alias("duration_sec"))
    return speech.probe_ranges(rows, length, width=7200.0)


@query
def question_answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.question_pairs(adapters.spans(spark, sf_dir), "asset_id", "turn")


@query
def spoken_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.spoken_structure(adapters.spans(spark, sf_dir), "asset_id")


@query
def overlap_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.spans(spark, sf_dir)
    windows = rows.groupBy("asset_id").agg(F.max("end_sec").alias("_end")).withColumn("segment_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("_end") / 10).cast("int"))))
    windows = windows.select("asset_id", "segment_id", (F.col("segment_id") * 10.0).alias("start_sec"), (F.col("segment_id") * 10.0 + 8.0).alias("end_sec"))
    found = intervals.overlapping_ranges(windows, rows.select("asset_id", F.col("start_sec").alias("a"), F.col("end_sec").alias("b"), "text"), ["asset_id"], ("start_sec", "end_sec"), ("a", "b"), 10.0)
    return found.groupBy("asset_id", "segment_id").agg(speech.ordered_text("a", "b").alias("excerpt"), F.count(F.lit(1)).alias("n"))


@query
def turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = speech.turns(adapters.spans(spark, sf_dir), gap=1.0).select("asset_id", F.col("start_sec").alias("t_start"), F.col("end_sec").alias("t_end"))
    ends = rows.groupBy("asset_id").agg(F.max("t_end").alias("_end"))
    windows = ends.select("asset_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("_end") / 10).cast("int"))).alias("segment_id")).withColumns({"start_sec": F.col("segment_id") * 10.0 + 0.25, "end_sec": F.col("segment_id") * 10.0 + 8.0})
    found = intervals.overlapping_ranges(windows, rows, ["asset_id"], ("start_sec", "end_sec"), ("t_start", "t_end"), 10.0)
    return speech.turn_alignment(found, ["asset_id", "segment_id"])


@query
def scene_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.fallback_scenes(adapters.assets(spark, sf_dir), "asset_id", "duration_sec")


@query
def sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.assets(spark, sf_dir).select("asset_id", F.posexplode(numeric.sample_timestamps(F.col("duration_sec"))).alias("pos", "t"))


@query
def peak_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.audio(spark, sf_dir).where("not is_silent and rms_energy >= 0.05").withColumns({"t": numeric.rounded(F.col("t") / 60000, 3), "duration_sec": F.lit(43.2)})
    return intervals.peak_windows(rows, "asset_id", "t", ["rms_energy"], "duration_sec", 3)


@query
def seed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.event_spans(spark, sf_dir).withColumns({"start_sec": numeric.rounded(F.col("start_sec") / 60000, 3), "end_sec": numeric.rounded(F.col("start_sec") / 60000 + 1 + F.col("event_id") % 5, 3), "duration_sec": F.lit(43.2)})
    return intervals.deduped_ranges(rows, "asset_id", "start_sec", "end_sec", "duration_sec")


def _clip_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audio rows within the first 40 seconds of the clips."""
    rows = adapters.audio(spark, sf_dir).select("asset_id", (F.col("event_id") % 40 + 0.5).alias("t"), "rms_energy", "is_silent")
    return rows.groupBy("asset_id", "t").agg(F.max("rms_energy").alias("rms_energy"), F.bool_and("is_silent").alias("is_silent"))


@query
def seed_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = adapters.assets(spark, sf_dir)
    scenes = intervals.fallback_scenes(clips, "asset_id", "duration_sec")
    seeds = clips.withColumn("seed_id", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"start_sec": F.col("seed_id") * 3.0, "end_sec": F.least(F.col("seed_id") * 3.0 + 4.0, F.col("duration_sec"))}).where("start_sec < end_sec")
    # Only some clips have a transcript or sound, so that every branch decides some.
    spans = adapters.spans(spark, sf_dir).where("asset_id % 3 = 0")
    audio = _clip_audio(spark, sf_dir).where("asset_id % 3 <> 1 and t >= 3")
    return intervals.refined(seeds, intervals.refined_by_transcript(seeds, spans, speech.turns(spans)), intervals.refined_by_audio(seeds, audio), intervals.refined_by_scene(seeds, scenes))


@query
def split_dividers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.spans(spark, sf_dir)
    seg = rows.groupBy("asset_id").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count(F.lit(1)).alias("segment_id"))
    scenes = intervals.fallback_scenes(seg.select("asset_id", F.col("end_sec").alias("duration_sec")), "asset_id", "duration_sec")
    return assembly.split_dividers(seg, speech.turns(rows, gap=2.0), rows, scenes)


def _clips_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("asset_id").agg(F.max("end_sec").alias("duration_sec"))


@query
def merge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as segments, every fourth one without speech, some as parts of one split."""
    rows = adapters.spans(spark, sf_dir)
    turn, spoken = F.col("turn"), F.col("turn") % 4 != 3
    seg = rows.select(
        "asset_id",
        turn.alias("segment_id"),
        "start_sec",
        (F.col("end_sec") + (turn % 3) * 0.125).alias("end_sec"),
        F.when(spoken, "speech").otherwise("visual").alias("analysis_mode"),
        F.when(spoken, F.col("text")).otherwise("").alias("transcript_excerpt"),
        F.array(F.element_at(F.array(*map(F.lit, ("scene", "audio-peak", "visual-peak"))), (turn % 3 + 1).cast("int"))).alias("seed_sources"),
        F.when(turn % 6 >= 4, F.floor(turn / 6).cast("string")).alias("source"),
        ((turn % 5) * 0.125 + 0.25).alias("boundary_confidence"),
    )
    scenes = intervals.fallback_scenes(_clips_of(rows), "asset_id", "duration_sec")
    near = assembly.continuity(seg, rows, _turns(rows), scenes)
    found = assembly.merged_chains(near, assembly.merge_rule())
    return found.select("asset_id", "chain", "start_sec", "end_sec", "n", "rule_family", "boundary_confidence", F.array_join(F.transform("segment_ids", lambda x: x.cast("string")), "|").alias("segment_ids"))


@query
def assembled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 11 seconds, split, joined and numbered anew."""
    rows = adapters.spans(spark, sf_dir)
    clips = _clips_of(rows)
    i = F.col("segment_id")
    seg = clips.withColumn("segment_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration_sec") / 12).cast("int"))))
    seg = seg.select("asset_id", "segment_id", (i * 12.0).alias("start_sec"), F.least(i * 12.0 + 11.0, F.col("duration_sec")).alias("end_sec"), F.array(F.when(i % 2 == 0, "scene").otherwise("audio-peak")).alias("seed_sources"), F.lit("scene-snap").alias("boundary_strategy"), (0.25 + (i % 4) * 0.125).alias("boundary_confidence"))
    seg = seg.where("end_sec > start_sec")

    def describe(ranges: DataFrame) -> DataFrame:
        said = intervals.overlapping_ranges(ranges.select("asset_id", "segment_id", "start_sec", "end_sec"), rows.select("asset_id", F.col("start_sec").alias("a"), F.col("end_sec").alias("b"), "text"), ["asset_id"], ("start_sec", "end_sec"), ("a", "b"), 30.0)
        said = said.groupBy("asset_id", "segment_id").agg(speech.ordered_text("a", "b").alias("transcript_excerpt"))
        out = ranges.join(said, ["asset_id", "segment_id"], "left").withColumn("transcript_excerpt", F.coalesce("transcript_excerpt", F.lit("")))
        return out.withColumn("analysis_mode", F.when(F.col("transcript_excerpt") != "", "speech").otherwise("visual"))

    scenes = intervals.fallback_scenes(clips, "asset_id", "duration_sec")
    out = assembly.assembled(seg, rows, _turns(rows), scenes, describe)
    return out.select("asset_id", "segment_id", "start_sec", "end_sec", "boundary_strategy", "boundary_confidence", "operation", "rule_family", joined(F.col("source_ids")).alias("source_ids"), joined(F.col("seed_sources")).alias("seed_sources"), "analysis_mode", F.length("transcript_excerpt").alias("excerpt_chars"))


def _turns(rows: DataFrame) -> DataFrame:
    return speech.turns(rows, gap=0.9)


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.audio(spark, sf_dir).select("asset_id", (F.floor(F.col("t") / 216000)).cast("int").alias("segment_id"), F.col("rms_energy").alias("brightness"), F.col("rms_energy").alias("distinctiveness"))
    return dedup.histograms(rows, ["asset_id", "segment_id"])


@query
def histogram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.intersections(_bins(spark, sf_dir), "asset_id", "segment_id")


@query
def histogram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of 35 % or more, the others pruned by mass and place."""
    return dedup.intersections(_bins(spark, sf_dir), "asset_id", "segment_id", 0.35)


@query
def leader_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = _bins(spark, sf_dir)
    items = bins.groupBy("asset_id", "segment_id").agg(F.sum("weight").alias("score"))
    return dedup.leaders(items, dedup.intersections(bins, "asset_id", "segment_id", 0.35), "asset_id", "segment_id", "score", 0.35)


@query
def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.vector_pairs(adapters.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4).select("a", "b", numeric.rounded("cosine", 4).alias("cosine"))


@query
def vector_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("score"))
    return dedup.vector_groups(rows, dedup.vector_links(rows, "vec_id", "embedding", 0.4), "vec_id", "score")


@query
def prompt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as excerpts; source, language and a verb stand for description, roles and actions."""
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    keywords = text.story_keywords(F.lit("Build a short story that moves through the erthing, ntion and reblen of src1 with thand"))
    none = F.array().cast("array<string>")
    actions = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("moves"), F.lit("waits"))).otherwise(none)
    found = text.searchable(F.col("text"), F.col("source"), F.array("lang"), none, actions, F.lit(""))
    rows = docs.select("doc_id", text.prompt_terms(keywords, found).alias("terms"))
    return rows.select("doc_id", F.size("terms").alias("n_terms"), numeric.rounded(text.prompt_score(F.col("terms")), 4).alias("score"), joined(F.slice("terms", 1, 3)).alias("first_terms"))


@query
def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    ratio = F.concat(F.col("k"), F.lit("/"), (F.col("event_id") % 4).cast("string"))
    odd = F.when(F.col("event_id") % 7 == 0, "N/A").when(F.col("event_id") % 7 == 1, "").otherwise(F.col("k"))
    return e.select("event_id", text_number(ratio).alias("ratio"), text_number(odd).alias("number"), numeric.rounded_metric(F.concat(F.lit("0.0"), F.col("k")), 0.5).alias("metric"))


def text_number(x: Column) -> Column:
    return numeric.rounded(numeric.parsed_float(x), 6)


@query
def hash_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.spread(adapters.table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("source_path"), F.col("p_brand").alias("proxy_path"), F.col("p_brand").alias("interchange_reel_name"), F.col("p_size").cast("double").alias("duration_sec"))
    return signals.seeded_signals(p).select("asset_id", "timestamp_sec", "sharpness", "contrast", "brightness", "motion_energy", "distinctiveness", "center_focus", "score")


@query
def media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.media(spark, sf_dir)
    stem = text.file_stem("path")
    return m.select("p_partkey", text.media_role("path").alias("role"), text.clip_key(stem).alias("clip_key"), text.humanize_stem(stem).alias("title"), text.slugify(stem).alias("slug"), text.file_extension("path").alias("ext"), text.is_video("path").alias("is_video"))


@query
def proxy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.media(spark, sf_dir).withColumns({"stem": text.file_stem("path"), "ext": text.file_extension("path"), "role": text.media_role("path")})
    # Read for sources and proxies, their classes and those left alone.
    return media.match_media(saved(m.withColumn("clip_key", text.clip_key("stem"))))


@query
def expectation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = adapters.table(spark, sf_dir, "labels").join(adapters.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    observed = labels.groupBy("lang", "source").agg(F.sum("quality").cast("double").alias("value"))
    asked = adapters.table(spark, sf_dir, "documents").select("lang", "source").distinct().withColumns({"min": F.lit(2.0), "max": F.when(F.col("lang") == "en", 12.0), "exact": F.when(F.col("source") == "src3", 3.0)})
    return evaluate.scalar_checks(observed, asked, ["lang", "source"])


@query
def expectation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.check_totals(expectation_checks(spark, sf_dir), "lang")


@query
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.dataset_fingerprint(adapters.table(spark, sf_dir, "part"), "p_name", "p_brand")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = adapters.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("completed_at"), F.col("o_totalprice").alias("total_runtime_sec"), F.col("o_orderpriority").alias("dataset_fingerprint"), F.col("o_orderstatus").alias("mode"))


@query
def history_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("dataset_fingerprint", F.col("run_id") % 100).orderBy("completed_at", "run_id")
    rows = _history(spark, sf_dir).withColumns({"before": F.lag("total_runtime_sec").over(order), "mode_before": F.lag("mode").over(order)})
    rows = evaluate.compared(rows, "total_runtime_sec", "before").where("before is not null")
    return rows.select("run_id", "delta", "delta_pct", joined(evaluate.differences([("mode", F.col("mode"), F.col("mode_before"))])).alias("changed"))


@query
def last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.last_match(_history(spark, sf_dir), "2-HIGH", "completed_at").select("run_id", "dataset_fingerprint", "total_runtime_sec")


@query
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), "value")
    code = text.timecode_of("stamp")
    return e.select("event_id", code.alias("timecode"), text.timecode_seconds(code, F.lit(25.0)).alias("seconds"), text.clock(F.col("value") * 20).alias("clock"))


def _screening_inputs(spark: SparkSession, sf_dir: str) -> tuple:
    """Customers as clips, hash-seeded frames, events as sound, conversations as spans, and answers that trim or split; the settings."""
    from ..config import EngineConfig
    from . import screening

    clips = adapters.assets(spark, sf_dir)
    named = clips.select(F.col("asset_id").alias("id"), F.col("asset_name").alias("name"), F.col("asset_name").alias("source_path"), F.col("asset_name").alias("proxy_path"), F.col("asset_name").alias("interchange_reel_name"), "duration_sec")
    spans = adapters.spans(spark, sf_dir).select("asset_id", "start_sec", "end_sec", "text")
    answers = clips.select(F.concat(F.col("asset_id").cast("string"), F.lit("-segment-01")).alias("segment_id"), F.when(F.col("asset_id") % 2 == 0, "trim").otherwise("split").alias("decision"), F.lit(0.5).alias("new_start"), F.lit(None).cast("double").alias("new_end"), F.lit(2.5).alias("split_at"))
    # Frames and sound are read by each step: hashed and grouped once, the clips dealt over the tasks.
    frames = written(signals.seeded_signals(adapters.spread(named, "id")))
    given = screening.Inputs(clips, frames, written(_clip_audio(spark, sf_dir)), spans, answers=answers)
    return given, EngineConfig(max_segments_per_asset=3, budget_pct=60.0, validation_budget_pct=50.0, validation_max=10**6)


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan up to the review."""
    from . import screening

    given, config = _screening_inputs(spark, sf_dir)
    return screening.reviewed(screening.flagged(screening.segments(given, config), given, config))


@query
def screened_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's seeds: scenes and the strongest windows of picture and sound, kept apart."""
    from . import screening

    given, config = _screening_inputs(spark, sf_dir)
    return screening.seeds(given, config)


@query
def screened_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's seeds refined by speech, sound, scene or length, and numbered."""
    from . import screening

    given, config = _screening_inputs(spark, sf_dir)
    found = screening.refined_ranges(given, config, saved(speech.turns(given.spans)))
    return found.withColumn("seed_sources", joined(F.col("seed_sources")))


@query
def screened_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ("start_sec", "end_sec", "analysis_mode", "boundary_strategy", "operation", "rule_family", "score_total", "ambiguity", "validation_status", "deduplicated", "dedup_group_id", "shortlisted", "stage")
    return _screened(spark, sf_dir).select("asset_id", "segment_id", *kept, F.col("review.blocked_reason").alias("blocked_reason"), F.col("review.analysis_path_summary").alias("path"))


@query
def screened_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan, from signals to one sequence for every twenty clips."""
    from . import screening

    return screening.timeline(screening.takes(_screened(spark, sf_dir)), scope=F.floor(F.col("asset_id") / 20).cast("int"))


from . import field_queries  # noqa: E402, F401  (registers more queries)
from . import source_queries  # noqa: E402, F401
