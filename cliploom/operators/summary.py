"""The whole summary of a run: its counters, modes, reasons and story figures, and the stability record.  A04, P28-P30 of the survey.

Every frame is aggregated to one row on its own, partial sums first, and the rows are joined; nothing else is gathered.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from .sequence import alternations, label_counts
from .views import execution_context, runtime_status

#: What a caller knows of a run beside its frames, with the values of a run without transcripts and models; fixed names.
FACTS = {
    "transcript_provider_configured": "", "transcript_provider_effective": "", "transcript_status": "disabled", "transcript_available": False, "transcript_enabled": False, "transcript_model_size": "", "transcript_detail": "",
    "semantic_available": True, "analyzer_available": True, "vectors_available": True, "ai_live_request_count": 0,
}
#: Flags of assets and the counters that they make.
ASSET_COUNTS = {
    "audio_signal_asset_count": "has_audio_signal", "transcript_target_asset_count": "transcript_targeted", "transcript_skipped_asset_count": "transcript_skipped", "transcript_probed_asset_count": "transcript_probed",
    "transcript_probe_rejected_asset_count": "transcript_probe_rejected", "transcribed_asset_count": "transcribed", "transcript_failed_asset_count": "transcript_failed", "transcript_cached_asset_count": "transcript_cached",
    "transcript_runtime_probed_asset_count": "transcript_probed", "transcript_runtime_probe_rejected_asset_count": "transcript_probe_rejected", "deterministic_preprocessing_cache_hit_asset_count": "preprocessing_cached",
}
#: Counters of the stability record's runs, in order; fixed names.
WORKLOAD = (
    "asset_count", "prefilter_sample_count", "candidate_segment_count", "deduplicated_segment_count", "dedup_group_count", "dedup_eliminated_count", "prefilter_shortlisted_count", "vlm_target_count",
    "filtered_before_vlm_count", "audio_signal_asset_count", "audio_silent_asset_count", "transcript_target_asset_count", "transcript_skipped_asset_count", "transcript_probed_asset_count",
    "transcript_probe_rejected_asset_count", "transcribed_asset_count", "transcript_failed_asset_count", "transcript_cached_asset_count", "transcript_runtime_probed_asset_count",
    "transcript_runtime_probe_rejected_asset_count", "transcript_excerpt_segment_count", "speech_fallback_segment_count", "semantic_boundary_eligible_count", "semantic_boundary_request_count",
    "semantic_boundary_validated_count", "semantic_boundary_skipped_count", "semantic_boundary_fallback_count", "semantic_boundary_threshold_targeted_count", "semantic_boundary_floor_targeted_count",
    "semantic_boundary_applied_count", "semantic_boundary_noop_count", "deterministic_preprocessing_cache_hit_asset_count", "deterministic_preprocessing_cache_rebuilt_asset_count", "clip_scored_count",
    "clip_gated_count", "ai_live_segment_count", "ai_cached_segment_count", "ai_fallback_segment_count", "ai_live_request_count",
)


def _plural(n: Column, before: str, noun: str, after: str = "") -> Column:
    return F.concat(F.lit(before), n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"), F.lit(after))


def _told(pairs: list[tuple[Column, Column]]) -> Column:
    return F.filter(F.array(*(F.when(test, text) for test, text in pairs)), lambda x: x.isNotNull())


def _worst(modes: list[str]) -> Column:
    """The worst of the modes named by columns."""
    is_any = lambda status: F.array_contains(F.array(*map(F.col, modes)), status)
    return F.when(is_any("unavailable"), "unavailable").when(is_any("degraded"), "degraded").when(is_any("partial"), "partial").when(is_any("active"), "active").otherwise("inactive")


def _segment_counts(config: EngineConfig, vectors: bool) -> list[Column]:
    c = F.col
    flag = lambda name: F.coalesce(c(name), F.lit(False))
    text = lambda name: F.coalesce(c(name), F.lit(""))
    speech, blank = text("analysis_mode") == "speech", F.trim(text("transcript_excerpt")) == ""
    asked = text("target_reason") != ""
    group = F.when(flag("shortlisted") & c("dedup_group_id").isNotNull(), F.struct("asset_id", "dedup_group_id"))
    on = lambda used, count: count if used else F.lit(0).cast("long")
    counts = {
        "candidate_segment_count": F.count(F.lit(1)),
        "deduplicated_segment_count": on(config.dedup, F.count_if(flag("deduplicated"))),
        "dedup_group_count": on(config.dedup, F.countDistinct(group)),
        "dedup_eliminated_count": on(config.dedup, F.count_if(flag("deduplicated") & flag("shortlisted"))),
        "prefilter_shortlisted_count": F.count_if(flag("shortlisted")),
        "vlm_target_count": F.count_if(flag("targeted")),
        "filtered_before_vlm_count": F.count_if(flag("filtered_before_vlm")),
        "transcript_excerpt_segment_count": F.count_if(~blank),
        "speech_fallback_segment_count": F.count_if(speech & blank),
        "clip_scored_count": on(vectors, F.count_if(c("clip_score").isNotNull())),
        "clip_gated_count": on(vectors, F.count_if(flag("clip_gated"))),
        "semantic_boundary_eligible_count": F.count_if(F.coalesce(c("ambiguity"), F.lit(0.0)) >= config.ambiguity_threshold),
        "semantic_boundary_request_count": F.count_if(asked),
        **{f"semantic_boundary_{s}_count": F.count_if(text("validation_status") == s) for s in ("validated", "skipped", "fallback")},
        **{f"semantic_boundary_{s}_targeted_count": F.count_if(text("target_reason") == s) for s in ("threshold", "floor")},
        "semantic_boundary_applied_count": F.count_if((text("validation_status") == "validated") & flag("validation_applied")),
        "semantic_boundary_noop_count": F.count_if((text("validation_status") == "validated") & ~flag("validation_applied")),
        **{f"ai_{s}_segment_count": F.count_if(text("ai_status") == s) for s in ("live", "cached", "fallback")},
        "speech_structure_segment_count": F.count_if(text("structure_label") != ""),
        "speech_structure_question_answer_count": F.count_if(text("structure_label") == "question-answer-flow"),
        "speech_structure_monologue_count": F.count_if(text("structure_label") == "monologue-continuity"),
    }
    return [v.alias(k) for k, v in counts.items()]


def analysis_summary(segments: DataFrame, assets: DataFrame, frames: DataFrame, items: DataFrame, config: EngineConfig = EngineConfig(), facts: Mapping[str, object] | None = None, timings: Mapping[str, float] | None = None) -> DataFrame:
    """One row of all of a run's figures.

    Segments: asset_id, analysis_mode, transcript_excerpt, deduplicated, dedup_group_id, shortlisted, filtered_before_vlm,
    targeted (a model is asked), clip_score, clip_gated, ambiguity, target_reason (of what was asked about its boundary),
    validation_status, validation_applied, ai_status, structure_label.  Assets: the flags of ASSET_COUNTS.  Frames: the sampled
    ones.  Items: order_index, analysis_mode, sequence_group, sequence_role, drivers, tradeoffs.  Nulls are false or nothing.
    Counters of a step that is switched off are 0.
    """
    known = dict(FACTS) | dict(facts or {})
    c, one = F.col, F.lit(1)
    vectors = config.vector_gate and bool(known["vectors_available"])
    rows = segments.agg(*_segment_counts(config, vectors)).withColumn("_one", one)
    flags = [F.count_if(F.coalesce(c(flag), F.lit(False))).alias(name) for name, flag in ASSET_COUNTS.items()]
    by_asset = assets.agg(F.count(one).alias("asset_count"), *flags).withColumn("_one", one)
    sampled = frames.agg(F.count(one).alias("prefilter_sample_count")).withColumn("_one", one)
    placed = items.withColumn("_one", one)
    told = alternations(placed, "_one").join(label_counts(placed, "_one").drop("n_items"), "_one")
    # A run without items has a story of none.
    story = segments.sparkSession.range(1).select(one.alias("_one")).join(told, "_one", "left").na.fill(0)
    rows = rows.join(by_asset, "_one").join(sampled, "_one").join(story, "_one").drop("_one")
    number = lambda n: F.coalesce(c(n), F.lit(0)).cast("long")
    rows = rows.withColumns(
        {
            "audio_silent_asset_count": c("asset_count") - c("audio_signal_asset_count"),
            "deterministic_preprocessing_cache_rebuilt_asset_count": c("asset_count") - c("deterministic_preprocessing_cache_hit_asset_count"),
            "semantic_boundary_dormant": c("semantic_boundary_validated_count") == 0,
            "vlm_budget_cap_pct": F.lit(float(config.budget_pct)),
            "vlm_budget_was_binding": c("vlm_target_count") < c("prefilter_shortlisted_count") * config.budget_pct / 100 if config.budget_pct < 100 else F.lit(False),
            "vlm_target_pct_of_candidates": F.coalesce(F.try_divide(c("vlm_target_count"), c("candidate_segment_count")) * 100, F.lit(0.0)),
            "story_assembly_active": number("n_items") > 1,
            "story_assembly_strategy": F.lit("sequence-heuristic-v2"),
            "story_assembly_transition_count": F.greatest(number("n_items") - 1, F.lit(0).cast("long")),
            "story_assembly_mode_alternation_count": number("mode_changes"),
            "story_assembly_group_count": number("n_groups"),
            "story_assembly_role_count": number("n_roles"),
            "story_assembly_prompt_fit_count": number("prompt_fit_count"),
            "story_assembly_tradeoff_count": number("tradeoff_count"),
            "story_assembly_repetition_control_count": number("repetition_control_count"),
        }
        | {k: F.lit(v).cast("long") if k == "ai_live_request_count" else F.lit(v) for k, v in known.items() if k.startswith("transcript_") or k == "ai_live_request_count"}
        | {f"{k}_sec": F.lit(round(float(v), 3)) for k, v in (timings or {}).items()}
    )
    enabled, available = F.lit(bool(known["transcript_enabled"])), F.lit(bool(known["transcript_available"]))
    validates = F.lit(config.semantic_validation)
    rows = rows.withColumns(
        {
            "transcript_runtime_mode": runtime_status(enabled & available, enabled & ~available, c("transcript_failed_asset_count"), c("transcript_skipped_asset_count") + c("transcript_runtime_probe_rejected_asset_count")),
            "semantic_boundary_runtime_mode": runtime_status(validates, validates & F.lit(not known["semantic_available"]), c("semantic_boundary_fallback_count"), c("semantic_boundary_skipped_count")),
            "semantic_boundary_targeting_mode": F.when(c("semantic_boundary_validated_count") > 0, "active").otherwise("inactive"),
            "ai_runtime_mode": runtime_status(c("ai_live_segment_count") + c("ai_cached_segment_count") > 0, F.lit(not known["analyzer_available"]), c("ai_fallback_segment_count"), c("filtered_before_vlm_count") + c("ai_cached_segment_count")),
            "cache_runtime_mode": runtime_status(F.lit(config.cache), F.lit(False), F.lit(0), F.when(c("ai_cached_segment_count") > 0, 0).otherwise(1)),
        }
    )
    failed, lost, ruled = (c(n) for n in ("transcript_failed_asset_count", "semantic_boundary_fallback_count", "ai_fallback_segment_count"))
    skipped, rejected, unasked, filtered = (c(n) for n in ("transcript_skipped_asset_count", "transcript_probe_rejected_asset_count", "semantic_boundary_skipped_count", "filtered_before_vlm_count"))
    degraded = _told(
        [
            (enabled & ~available, F.lit("transcript runtime unavailable")),
            (~(enabled & ~available) & (failed > 0), _plural(failed, "transcript fallback on ", "asset")),
            (lost > 0, _plural(lost, "semantic boundary fallback on ", "segment")),
            (ruled > 0, _plural(ruled, "deterministic AI fallback on ", "segment")),
        ]
    )
    kept_out = F.concat_ws(", ", F.when(skipped > 0, _plural(skipped, "", "transcript-target skip")), F.when(rejected > 0, _plural(rejected, "", "probe rejection")))
    intended = _told(
        [
            (~enabled, F.lit("transcript provider disabled")),
            (enabled & (skipped + rejected > 0), F.concat(F.lit("transcript targeting kept cost bounded: "), kept_out)),
            (~validates, F.lit("semantic boundary validation disabled")),
            (validates & (unasked > 0), _plural(unasked, "semantic boundary validation skipped ", "segment")),
            (filtered > 0, _plural(filtered, "AI analysis skipped ", "segment", " before live VLM")),
        ]
    )
    modes = ["ai_runtime_mode", "transcript_runtime_mode", "semantic_boundary_runtime_mode", "cache_runtime_mode"]
    summary = F.concat_ws(", ", *(F.concat(F.lit(f"{name} "), c(mode)) for name, mode in zip(("AI", "transcript", "semantic", "cache"), modes, strict=True)))
    rows = rows.withColumns({"runtime_reliability_mode": _worst(modes), "runtime_reliability_summary": summary, "runtime_degraded_reasons": degraded, "runtime_intentional_skip_reasons": intended})
    rows = rows.withColumn("runtime_ready", ~c("runtime_reliability_mode").isin("unavailable", "inactive"))
    return rows.drop("n_items", "mode_changes", "n_roles", "n_groups", "transitions", "prompt_fit_count", "repetition_control_count", "tradeoff_count")


def _activity(hits: str, misses: str, what: str) -> Column:
    some, others = F.col(hits) > 0, F.col(misses) > 0
    return F.when(some & others, f"mixed-{what}").when(some, f"warm-{what}").when(others, f"cold-{what}").otherwise("inactive")


def stability_record(summary: DataFrame, provider: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """A run's workload counters with how it ran: modes overall and by component, reasons, providers, concurrency and cache activity."""
    c = F.col
    context = execution_context(provider, config.concurrency)
    return summary.select(
        *WORKLOAD, c("runtime_reliability_mode").alias("overall_mode"), c("runtime_ready").alias("ready"), c("runtime_reliability_summary").alias("summary"), c("ai_runtime_mode").alias("mode_ai"), c("transcript_runtime_mode").alias("mode_transcript"),
        c("semantic_boundary_runtime_mode").alias("mode_semantic_boundary"), c("cache_runtime_mode").alias("mode_cache"), c("runtime_degraded_reasons").alias("degraded_reasons"), c("runtime_intentional_skip_reasons").alias("intentional_skip_reasons"),
        c("semantic_boundary_targeting_mode").alias("semantic_targeting_mode"), "transcript_status", "transcript_provider_effective", F.lit(provider).alias("ai_provider_effective"),
        *(F.lit(context[k]).alias(k) for k in ("ai_execution_context", "ai_effective_concurrency")),
        _activity("ai_cached_segment_count", "ai_live_segment_count", "cache").alias("ai_cache_activity"),
        _activity("deterministic_preprocessing_cache_hit_asset_count", "deterministic_preprocessing_cache_rebuilt_asset_count", "preprocessing").alias("deterministic_preprocessing_cache_activity"),
    )


def log_lines(record: DataFrame) -> DataFrame:
    """(key, line) with a line key=value for every column of each row, whole numbers without and others with three decimals, lists joined."""
    kinds = dict(record.dtypes)

    def told(name: str) -> Column:
        value, kind = F.col(name), kinds[name]
        if kind.startswith("array"):
            return F.array_join(value.cast("array<string>"), ",")
        return F.format_string("%.3f", value) if kind in ("double", "float") else value.cast("string")

    pairs = F.array(*(F.struct(F.lit(name).alias("key"), F.concat(F.lit(f"{name}="), F.coalesce(told(name), F.lit(""))).alias("line")) for name in record.columns))
    return record.select(F.inline(pairs))
