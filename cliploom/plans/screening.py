"""The screening plan: tables of clips, signals, spans and scenes in, described and flagged segments, ranked takes and a timeline out.

seeds -> refined ranges -> split, merged and renumbered segments -> validated ranges (of answers that were handed in) ->
metrics and scores -> near duplicates, shortlist, vector gate and model budget as flags -> rule-based understanding, review
record -> takes -> one sequence per scope.  Flags decide what a model would be asked about; takes are ranked over all
segments.  Each step has its switch or limit in `EngineConfig`.  Models and detectors stay outside: their results come as
frames of `Inputs`.

Seeds, turns and segments are read several times each and are written to the shared checkpoint folder once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import assembly, dedup, intervals, review, scoring, selection, sequence, signals, speech
from ..sources.scratch import checkpointed as saved


@dataclass(frozen=True)
class Inputs:
    """assets(asset_id, asset_name, duration_sec, has_speech), frame signals, audio rows (t, rms_energy, is_silent), spans, scenes (pos).

    Optional: vectors (asset_id, segment_id, vector) and vector_scores (segment_id, clip_score) of segments, and answers of
    boundary validation (segment_id, decision, new_start, new_end, split_at).
    """

    assets: DataFrame
    frames: DataFrame
    audio: DataFrame
    spans: DataFrame
    scenes: DataFrame | None = None
    vectors: DataFrame | None = None
    vector_scores: DataFrame | None = None
    answers: DataFrame | None = None

    def scene_ranges(self) -> DataFrame:
        return self.scenes if self.scenes is not None else intervals.fallback_scenes(self.assets, "asset_id", "duration_sec")


KEYS = ["asset_id", "segment_id"]
RANGE = ("start_sec", "end_sec")
#: Bins of range joins, in seconds.
BIN = 30.0


def seeds(given: Inputs, config: EngineConfig) -> DataFrame:
    clips = given.assets.select("asset_id", "duration_sec")
    scenes = given.scene_ranges()
    seen = intervals.peak_windows(given.frames.join(clips, "asset_id"), "asset_id", "timestamp_sec", ["score", "distinctiveness"], "duration_sec", config.top_windows)
    loud = given.audio.where("not is_silent and rms_energy >= 0.05").join(clips, "asset_id")
    heard = intervals.peak_windows(loud, "asset_id", "t", ["rms_energy"], "duration_sec", config.top_windows)
    found = intervals.seed_regions(scenes, seen, heard, clips, framed=given.frames)
    order = Window.partitionBy("asset_id").orderBy("start_sec", "end_sec")
    return found.withColumn("seed_id", F.row_number().over(order)).join(clips, "asset_id")


def refined_ranges(given: Inputs, config: EngineConfig, turns: DataFrame) -> DataFrame:
    """asset_id, segment_id, range, boundary_strategy, boundary_confidence and seed_sources; seeds as they are without refinement."""
    seed = saved(seeds(given, config))
    named = seed.select("asset_id", "seed_id", F.array("source").alias("seed_sources"))
    if config.boundary_refinement:
        rows = intervals.refined(seed, intervals.refined_by_transcript(seed, given.spans, turns), intervals.refined_by_audio(seed, given.audio), intervals.refined_by_scene(seed, given.scene_ranges()))
    else:
        rows = seed.select("asset_id", "seed_id", *RANGE, F.lit("legacy").alias("boundary_strategy"), F.col("confidence").alias("boundary_confidence"))
    return assembly.renumbered(rows.join(named, ["asset_id", "seed_id"]).withColumnRenamed("seed_id", "segment_id"))


def described(ranges: DataFrame, given: Inputs) -> DataFrame:
    """Adds transcript_excerpt, audio_energy, speech_ratio, mode_source and analysis_mode to ranges."""
    own = ranges.select(*KEYS, *RANGE)
    heard = signals.audio_aggregates(intervals.inside_or_nearest(given.audio, own, "asset_id", "segment_id", "t", *RANGE, BIN), KEYS)
    spans = given.spans.select("asset_id", F.col("start_sec").alias("a"), F.col("end_sec").alias("b"), "text")
    said = intervals.overlapping_ranges(own, spans, ["asset_id"], RANGE, ("a", "b"), BIN)
    said = said.groupBy(*KEYS).agg(speech.ordered_text("a", "b").alias("transcript_excerpt"))
    rows = ranges.join(heard, KEYS, "left").join(said, KEYS, "left").withColumn("transcript_excerpt", F.coalesce("transcript_excerpt", F.lit("")))
    return scoring.with_mode(rows.join(given.assets.select("asset_id", "has_speech"), "asset_id")).drop("has_speech")


def segments(given: Inputs, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Assembled, validated segments with their metrics, scores, doubt and validation state."""
    turns = saved(speech.turns(given.spans))
    scenes = given.scene_ranges()
    ranges = refined_ranges(given, config, turns)
    # What a step reads several times is written first.
    rows = saved(assembly.assembled(saved(ranges), given.spans, turns, scenes, lambda x: saved(described(saved(x), given))))
    rows = saved(measured(rows, given, turns))
    # Doubtful boundaries, within the run's budget; what an answer changes is measured anew.
    doubtful = rows.withColumns({"drift": F.lit(0.0), "ambiguity": F.lit(0.0)}).withColumn("ambiguity", selection.ambiguity())
    targets = selection.ambiguity_targets(doubtful, config.ambiguity_threshold, config.floor_threshold, config.min_targets)
    asked = selection.drained(targets, config.validation_budget_pct, config.validation_max if config.validation_max else 0)
    asked = saved(asked.select("segment_id", "ambiguity", "target_reason", "status"))
    if config.semantic_validation and given.answers is not None:
        may = asked.where("status = 'pending'").select("segment_id").join(rows.select("segment_id", F.coalesce(selection.split_supported(), F.lit(False)).alias("supported")), "segment_id")
        answers = given.answers.join(may, "segment_id")
        keep = ("asset_id", "segment_id", *RANGE, "duration_sec", "seed_sources", "boundary_strategy", "boundary_confidence", "operation", "rule_family", "source_ids")
        rows = assembly.validated(rows.select(*keep, F.col("segment_id").alias("asked_id")), answers, most=config.max_adjustment).drop("applied", "duration_sec")
        rows = saved(measured(saved(described(saved(rows), given)), given, turns))
    else:
        rows = rows.withColumn("asked_id", F.col("segment_id"))
    state = "not_eligible" if config.semantic_validation else "skipped"
    # Validated segments are numbered anew; what was asked is known by the id that a segment had.
    rows = rows.join(asked.select(F.col("segment_id").alias("asked_id"), "ambiguity", "target_reason", F.col("status").alias("validation_status")), "asked_id", "left")
    return rows.withColumns({"ambiguity": F.coalesce("ambiguity", F.lit(0.0)), "validation_status": F.coalesce("validation_status", F.lit(state))})


def measured(rows: DataFrame, given: Inputs, turns: DataFrame) -> DataFrame:
    """Adds asset columns, pos, frame metrics, turn alignment, spoken structure, projected metrics and scores."""
    own = rows.select(*KEYS, *RANGE)
    seen = signals.frame_aggregates(intervals.inside_or_nearest(given.frames, own, "asset_id", "segment_id", "timestamp_sec", *RANGE, BIN), KEYS)
    on_turns = intervals.overlapping_ranges(own, turns.select("asset_id", F.col("start_sec").alias("t_start"), F.col("end_sec").alias("t_end")), ["asset_id"], RANGE, ("t_start", "t_end"), BIN)
    rows = rows.join(seen, KEYS, "left").join(speech.turn_alignment(on_turns, KEYS), KEYS, "left").join(given.assets.select("asset_id", "asset_name", "duration_sec", "has_speech"), "asset_id")
    renamed = {"sharpness": "mean_sharpness", "visual_novelty": "mean_distinctiveness", "motion_energy": "mean_motion_energy", "prefilter_score": "mean_score"}
    rows = rows.withColumns({new: F.col(old) for new, old in renamed.items()})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = rows.withColumns(scoring.projected_metrics(zero("prefilter_score"), zero("subject_clarity"), zero("motion_energy"), zero("visual_novelty"), F.col("end_sec") - F.col("start_sec")))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("asset_id").orderBy("start_sec", "end_sec", "segment_id")))
    return scoring.with_scores(rows.drop("analysis_mode", "mode_source"))


def flagged(found: DataFrame, given: Inputs, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Adds deduplicated, dedup_group_id, shortlisted, filtered_before_vlm, clip_score, clip_gated, stage and vlm_budget_capped.

    Near duplicates go in two stages.  By histogram before the shortlist, in assets of two segments or more: duplicates leave
    room for others there.  By vectors over the shortlist alone: a duplicate found then leaves its place empty, as the
    shortlist isn't drawn again.  The keeper of a vector group has the highest mean of prefilter score and vector score (0.5
    where it has none), the first on ties.  Without vectors the second stage is the histogram's once more: leaders of the
    first one stay leaders, so it only numbers the shortlisted ones anew.
    """
    rows = found = saved(found)
    if config.dedup:
        own = found.select(*KEYS, *RANGE)
        bins = saved(dedup.histograms(intervals.inside_or_nearest(given.frames, own, "asset_id", "segment_id", "timestamp_sec", *RANGE, BIN), KEYS))
        several = found.groupBy("asset_id").count().where(F.col("count") > 1).select("asset_id")
        items = found.join(several, "asset_id", "left_semi").select(*KEYS, F.coalesce("prefilter_score", F.lit(0.0)).alias("score"))
        alike = dedup.leaders(items, dedup.intersections(bins, "asset_id", "segment_id", config.dedup_threshold), "asset_id", "segment_id", "score", config.dedup_threshold)
        rows = rows.join(alike.select(*KEYS, "deduplicated", F.col("dedup_group").alias("dedup_group_id")), KEYS, "left")
    else:
        rows = rows.withColumns({"deduplicated": F.lit(False), "dedup_group_id": F.lit(None).cast("int")})
    rows = rows.withColumn("deduplicated", F.coalesce("deduplicated", F.lit(False)))
    short = selection.shortlist(rows.where("not deduplicated"), config.max_segments_per_asset, fast=config.mode == "fast").select("segment_id", F.lit(True).alias("shortlisted"))
    rows = rows.join(short, "segment_id", "left").withColumn("shortlisted", F.coalesce("shortlisted", F.lit(False))).withColumn("filtered_before_vlm", ~F.col("shortlisted"))
    scores = given.vector_scores.select("segment_id", "clip_score") if given.vector_scores is not None else rows.select("segment_id", F.lit(None).cast("double").alias("clip_score")).where("false")
    # Only what is shortlisted is looked at, so only that has a score.
    rows = rows.join(scores, "segment_id", "left").withColumn("clip_score", F.when(F.col("shortlisted"), F.col("clip_score")))
    gated = F.col("clip_score").isNotNull() & (F.col("clip_score") < config.vector_min_score) if config.vector_gate else F.lit(False)
    rows = saved(rows.withColumn("clip_gated", gated))
    if config.dedup:
        rows = saved(_second_stage(rows, given))
    stages = selection.staged_targets(rows.withColumn("gated", F.col("clip_gated")), config.max_segments_per_asset, config.budget_pct).select("segment_id", "stage")
    rows = rows.join(stages, "segment_id", "left")
    return rows.withColumn("vlm_budget_capped", F.coalesce(F.col("stage") == "budget_capped", F.lit(False)))


def _second_stage(rows: DataFrame, given: Inputs) -> DataFrame:
    """Rows with deduplicated and dedup_group_id as the stage over the shortlist leaves them."""
    mean = (F.coalesce("prefilter_score", F.lit(0.0)) + F.coalesce("clip_score", F.lit(0.5))) / 2
    short = rows.where("shortlisted").select(*KEYS, "pos", F.coalesce("prefilter_score", F.lit(0.0)).alias("_prefilter"), mean.alias("score"))
    if given.vectors is None:
        alone = F.count(F.lit(1)).over(Window.partitionBy("asset_id")) < 2
        again = short.withColumn("_alone", alone).where("not _alone")
        place = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("_prefilter"), "pos")) - 1
        anew = again.select("segment_id", F.lit(False).alias("_dup"), place.alias("_group"))
    else:
        left = given.vectors.join(short, KEYS)
        groups = dedup.vector_groups(left.select("segment_id", "score"), dedup.vector_pairs(left, "segment_id", "vector", scope="asset_id"), "segment_id", "score")
        # Groups are numbered within their asset, from 1, in the order of their first segments.
        placed = groups.join(short.select("segment_id", "asset_id", "pos"), "segment_id")
        placed = placed.withColumn("_first", F.min("pos").over(Window.partitionBy("asset_id", "component")))
        anew = placed.select("segment_id", F.col("deduplicated").alias("_dup"), F.dense_rank().over(Window.partitionBy("asset_id").orderBy("_first")).alias("_group"))
    rows = rows.join(anew, "segment_id", "left")
    return rows.withColumns({"deduplicated": F.coalesce("_dup", "deduplicated"), "dedup_group_id": F.coalesce("_group", "dedup_group_id")}).drop("_dup", "_group")


def reviewed(rows: DataFrame) -> DataFrame:
    """Adds understanding (rule-based, of segments that a model would be asked about) and the review record."""
    target = F.coalesce(F.col("stage") == "target", F.lit(False))
    no = F.array().cast("array<string>")
    given = rows.withColumns(
        {
            "understanding": F.when(target, scoring.understanding()),
            "provider": F.when(target, "deterministic"),
            "keyframe_count": F.when(F.col("shortlisted"), F.lit(4)),
            "seed_ids": no,
            "validation_decision": F.lit(None).cast("string"),
            "validation_confidence": F.lit(None).cast("double"),
            "validation_reason": F.lit(None).cast("string"),
            "skip_reason": F.when(F.col("validation_status") == "over_budget", "over_budget"),
            "transcript_runtime": F.lit("ready"),
            "looked_up": F.lit(True),
            "structure_label": F.when(F.col("rule_family").isin("question-answer-flow", "monologue-continuity"), F.col("rule_family")),
            "structure_cues": no,
        }
    )
    return given.withColumn("review", review.review_record()).select(*rows.columns, "understanding", "review")


def takes(found: DataFrame) -> DataFrame:
    return selection.ranked_takes(found)


def timeline(ranked: DataFrame, prompt_fit: float = 0.0, scope: Column | None = None) -> DataFrame:
    """scope, take_id, order_index and labels of the selected takes: one greedy sequence per scope (a project; all are one without)."""
    roles = F.coalesce(F.col("understanding.story_roles"), F.array().cast("array<string>")) if "understanding" in ranked.columns else F.array().cast("array<string>")
    rows = ranked.where("is_selected").withColumns({"scope": scope if scope is not None else F.lit(0), "story_roles": roles, "prompt_fit": F.lit(prompt_fit)})
    order = Window.partitionBy("scope").orderBy("asset_id", "within_asset_rank")
    rows = rows.withColumns({"story_role": sequence.story_role(), "pos": F.row_number().over(order), "trim": sequence.suggested_duration()})
    path = sequence.story_sequence(rows, "scope").join(rows.select("take_id", "segment_id", "analysis_mode", "trim"), "take_id")
    return sequence.placed(path, "scope").select("scope", "take_id", "segment_id", "order_index", "sequence_score", "label", "sequence_group", "sequence_role", F.col("trim").alias("trim_out_sec"))
