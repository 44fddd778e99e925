"""Joined and ordered views, editor overrides, review state, run summary.  J10, J11, J14, L06, P21-P24, P28, P29, A04 of the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..sources.scratch import checkpointed


def segment_views(segments: DataFrame, assets: DataFrame, takes: DataFrame, items: DataFrame) -> DataFrame:
    """Segments with their asset (inner), take and timeline item (both optional)."""
    # Items meet takes first: segments without a take have no key, and would all meet in one task.
    placed = takes.join(items, "take_id", "left")
    return segments.join(assets, "asset_id").join(placed, "segment_id", "left")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in a total order, from 1, without gathering the rows in one task.

    Rows are range-partitioned, written, numbered within their partition, and the partitions' counts are added up before.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = checkpointed(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    found = dealt.withColumn("_place", place).join(F.broadcast(before), "_part")
    return found.withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def ranked_view(views: DataFrame) -> DataFrame:
    """Adds view_rank: score (else prefilter score) descending, taken ones first, then asset name, start and id."""
    rows = views.withColumns({"_score": F.coalesce("score_total", "prefilter_score", F.lit(0.0)), "_free": F.col("take_id").isNull()})
    order = [F.desc("_score"), F.col("_free"), F.col("asset_name"), F.col("start_sec"), F.col("segment_id")]
    return numbered(rows, order, "view_rank").drop("_score", "_free")


def clip_view(views: DataFrame) -> DataFrame:
    """Adds clip_rank: segments of each asset by start."""
    return views.withColumn("clip_rank", F.row_number().over(Window.partitionBy("asset_id").orderBy("start_sec", "segment_id")))


def with_overrides(takes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Takes after overrides (asset_id, override_segment): the named segment becomes best; null clears the asset's best.

    An override that names no segment of its asset is ignored.  Adds baseline_is_best, editor_override and editor_cleared.
    """
    known = takes.select("asset_id", F.col("segment_id").alias("override_segment")).distinct()
    valid = overrides.join(known, ["asset_id", "override_segment"], "left_semi").unionByName(overrides.where("override_segment is null")).withColumn("_has", F.lit(True))
    rows = takes.join(valid, "asset_id", "left").withColumn("baseline_is_best", F.col("is_selected"))
    has = F.coalesce("_has", F.lit(False))
    named = has & F.coalesce(F.col("override_segment") == F.col("segment_id"), F.lit(False))
    cleared = has & F.col("override_segment").isNull() & F.col("is_selected")
    selected = F.when(has, named).otherwise(F.col("is_selected"))
    outcome = F.when(named, "best").when(has & (F.col("outcome") == "best"), F.when(F.col("override_segment").isNull(), "backup").otherwise("alternate")).otherwise(F.col("outcome"))
    return rows.withColumns({"editor_override": named & ~F.col("baseline_is_best"), "editor_cleared": cleared, "is_selected": selected, "outcome": outcome}).drop("_has", "override_segment")


def blocked_reason() -> Column:
    """The first of duplicate, clip_gate, budget_cap and shortlist_filter that holds; empty if none does."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.coalesce(F.when(flag("deduplicated"), "duplicate"), F.when(flag("clip_gated"), "clip_gate"), F.when(flag("budget_capped"), "budget_cap"), F.when(~flag("shortlisted"), "shortlist_filter"), F.lit(""))


def analysis_path(steps: list[tuple[Column, str]]) -> Column:
    """Names of the steps that a segment went through, in order."""
    return F.array_join(F.filter(F.array(*(F.when(test, F.lit(name)) for test, name in steps)), lambda x: x.isNotNull()), " -> ")


#: Fixed values.
STRATEGIES = {
    "legacy": "Legacy window",
    "turn-snap": "Turn snapped",
    "transcript-snap": "Transcript snapped",
    "audio-snap": "Audio snapped",
    "scene-snap": "Scene snapped",
    "scene-duration": "Scene duration rule",
    "duration-rule": "Duration rule",
}


def strategy_label(strategy: Column) -> Column:
    """Display text of a boundary strategy; merges and splits name their rule."""
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in STRATEGIES.items() for x in pair)), strategy)
    rule = F.regexp_replace(F.regexp_extract(strategy, "^assembly-(?:merge|split):(.*)$", 1), "-", " ")
    told = lambda verb: F.concat(F.lit(f"Assembly {verb} ("), rule, F.lit(")"))
    return F.coalesce(known, F.when(strategy.startswith("assembly-merge:"), told("merged")).when(strategy.startswith("assembly-split:"), told("split")).otherwise(F.initcap(F.regexp_replace(strategy, "-", " "))), F.lit(""))


#: The worst status first.
SEVERITY = ("unavailable", "degraded", "partial", "active", "inactive")


def runtime_status(active: Column, unavailable: Column, fallbacks: Column, skipped: Column) -> Column:
    return F.when(unavailable, "unavailable").when(~active, "inactive").when(fallbacks > 0, "degraded").when(skipped > 0, "partial").otherwise("active")


def worst_status(status: Column) -> Column:
    """An aggregate: the worst status of a group."""
    return F.get(F.array(*map(F.lit, SEVERITY)), F.min(F.array_position(F.array(*map(F.lit, SEVERITY)), status)).cast("int") - 1)


def cache_activity(hits: Column, misses: Column) -> Column:
    return F.when((hits > 0) & (misses > 0), "mixed").when(hits > 0, "warm").when(misses > 0, "cold").otherwise("inactive")


def execution_context(provider: str, concurrency: int) -> dict[str, object]:
    """How many model requests run at once, by provider."""
    asked = max(1, concurrency)
    effective, context = {"mlx-vlm-local": (1, "serialized-local-model"), "lmstudio": (asked, "configured-parallel-requests")}.get(provider, (0, "deterministic-fallback"))
    return {"ai_concurrency": asked, "ai_effective_concurrency": effective, "ai_execution_context": context}


def run_counters(rows: DataFrame, budget_pct: float = 100.0) -> DataFrame:
    """One row of counters and modes of a run over its segments, which carry their review record as `r`."""
    r, n = (lambda name: F.col(f"r.{name}")), F.count(F.lit(1))
    status = lambda s: F.count_if(r("semantic_validation_status") == s)
    structure = lambda label: F.count_if(F.coalesce(F.col("structure_label") == label, F.lit(False)))
    target = r("shortlisted") & (r("blocked_reason") == "")
    counted = rows.agg(
        F.countDistinct("asset_id").alias("asset_count"),
        n.alias("candidate_segment_count"),
        F.count_if(r("deduplicated")).alias("dedup_eliminated_count"),
        F.countDistinct(F.when(r("dedup_group_id").isNotNull(), F.struct("asset_id", r("dedup_group_id")))).alias("dedup_group_count"),
        F.count_if(r("shortlisted")).alias("prefilter_shortlisted_count"),
        F.count_if(target).alias("vlm_target_count"),
        F.count_if(r("filtered_before_vlm")).alias("filtered_before_vlm_count"),
        F.countDistinct(F.when(F.coalesce("audio_energy", F.lit(0.0)) > 0, F.col("asset_id"))).alias("audio_signal_asset_count"),
        F.count_if(r("transcript_status") == "excerpt-available").alias("transcript_excerpt_segment_count"),
        F.countDistinct(F.when(r("transcript_status") == "selective-skip", F.col("asset_id"))).alias("transcript_skipped_asset_count"),
        F.count_if(r("speech_mode_source") == "speech-signal-fallback").alias("speech_fallback_segment_count"),
        F.count_if(r("clip_scored")).alias("clip_scored_count"),
        F.count_if(r("clip_gated")).alias("clip_gated_count"),
        F.count_if(r("semantic_validation_status") != "").alias("semantic_boundary_eligible_count"),
        *(status(s).alias(f"semantic_boundary_{s}_count") for s in ("validated", "skipped", "fallback")),
        F.count_if(r("model_analyzed")).alias("ai_live_segment_count"),
        F.count_if(r("deterministic_fallback")).alias("ai_fallback_segment_count"),
        F.sum(r("evidence_keyframe_count")).alias("keyframe_count"),
        F.count_if(F.coalesce("structure_label", F.lit("")) != "").alias("speech_structure_segment_count"),
        structure("question-answer-flow").alias("speech_structure_question_answer_count"),
        structure("monologue-continuity").alias("speech_structure_monologue_count"),
        *(F.count_if(r("blocked_reason") == b).alias(f"blocked_{b}_count") for b in ("duplicate", "clip_gate", "budget_cap", "shortlist_filter")),
    )
    c = F.col
    return counted.withColumns(
        {
            "semantic_boundary_dormant": c("semantic_boundary_validated_count") == 0,
            "vlm_budget_cap_pct": F.lit(float(budget_pct)),
            "vlm_budget_was_binding": c("vlm_target_count") < c("prefilter_shortlisted_count") * budget_pct / 100,
            "vlm_target_pct_of_candidates": rounded(F.coalesce(F.try_divide(c("vlm_target_count") * 100.0, c("candidate_segment_count")), F.lit(0.0)), 4),
            "ai_runtime_mode": runtime_status(c("ai_live_segment_count") > 0, F.lit(False), c("ai_fallback_segment_count"), c("filtered_before_vlm_count")),
            "semantic_boundary_runtime_mode": runtime_status(c("semantic_boundary_eligible_count") > 0, F.lit(False), c("semantic_boundary_fallback_count"), c("semantic_boundary_skipped_count")),
            "semantic_boundary_targeting_mode": F.when(c("semantic_boundary_validated_count") > 0, "active").otherwise("inactive"),
        }
    )


def run_summary(segments: DataFrame, takes: DataFrame) -> DataFrame:
    """One row of counters over segments and takes."""
    a = segments.agg(
        F.count(F.lit(1)).alias("segments"),
        F.countDistinct("asset_id").alias("assets"),
        F.count_if(F.col("analysis_mode") == "speech").alias("speech_segments"),
        F.count_if(F.col("analysis_mode") == "visual").alias("visual_segments"),
        F.count_if(F.col("mode_source") == "speech-signal-fallback").alias("speech_fallbacks"),
        F.count_if(F.trim("transcript_excerpt") != "").alias("with_excerpt"),
    )
    b = takes.agg(F.count(F.lit(1)).alias("takes"), F.count_if("is_selected").alias("selected"), F.count_if(F.col("outcome") == "alternate").alias("alternates"), rounded(F.avg(F.round("score_total", 4)), 3).alias("mean_total"))
    return a.join(F.broadcast(b)).withColumn("selected_pct", rounded(F.try_divide(100.0 * F.col("selected"), F.col("takes")), 1))
