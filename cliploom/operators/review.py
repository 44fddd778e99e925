"""Review texts and state of segments, provenance lists, evidence reuse.  P21, P22, P24, P26, P62, J16 of the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import human_join
from ..functions.numeric import keyframe_timestamps, rounded
from .scoring import transcript_status
from .views import analysis_path, blocked_reason, strategy_label


def _words(x: Column) -> Column:
    return F.regexp_replace(x, "[-_]", " ")


def _plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def lineage(operation: Column, rule: Column, sources: Column, seed_ids: Column, seed_sources: Column) -> Column:
    """What a segment was built from."""
    named = lambda default: F.when(F.coalesce(rule, F.lit("")) != "", _words(rule)).otherwise(F.lit(default))
    return (
        F.when((operation == "merge") & (F.size(sources) > 0), F.concat(F.lit("Merged from "), _plural(F.size(sources), "region"), F.lit(" by "), named("continuity")))
        .when((operation == "split") & (F.size(sources) > 0), F.concat(F.lit("Split from "), F.get(sources, 0), F.lit(" by "), named("internal divider")))
        .when(F.size(seed_ids) > 0, F.concat(F.lit("Built from "), _plural(F.size(seed_ids), "seed"), F.lit(" ("), human_join(F.transform(F.slice(seed_sources, 1, 3), _words)), F.lit(")")))
        .otherwise(F.lit(""))
    )


def turn_text(turn_count: Column, rule: Column, alignment: Column) -> Column:
    """How a segment lies on its transcript turns."""
    return (
        F.when(F.coalesce(turn_count, F.lit(0)) == 0, "")
        .when(rule.isin("turn-continuity", "question-answer-flow", "monologue-continuity", "turn-break"), F.concat(F.lit("By "), _words(rule)))
        .otherwise(F.concat(F.coalesce(_words(alignment), F.lit("turn aware")), F.lit(" on "), _plural(turn_count, "turn")))
    )


def validation_text(status: Column, decision: Column, confidence: Column, reason: Column, skip_reason: Column) -> Column:
    """How boundary validation ended."""
    pct = F.floor(confidence * 100 + 0.5).cast("int").cast("string")
    return (
        F.when((status == "validated") & (decision == "keep"), F.concat(F.lit("Validation kept the boundary at "), pct, F.lit("%")))
        .when(status == "validated", F.concat(F.lit("Validation chose "), decision, F.lit(": "), F.lower(F.coalesce(reason, F.lit("")))))
        .when(status == "fallback", "Validation fell back to the rules")
        .when(status == "skipped", F.concat(F.lit("Validation skipped: "), _words(F.coalesce(skip_reason, F.lit("not run")))))
        .otherwise(F.coalesce(reason, F.lit("")))
    )


def description(name: Column, start: Column, end: Column, mode: Column, excerpt: Column) -> Column:
    """A segment in words, by transcript, by speech signal or by picture."""
    place = F.format_string("%.1f-%.1f s of %s", start, end, name)
    return (
        F.when(F.trim(F.coalesce(excerpt, F.lit(""))) != "", F.concat(F.lit("Spoken, "), place, F.lit(": "), F.trim(excerpt)))
        .when(mode == "speech", F.concat(F.lit("Speech without transcript, "), place))
        .otherwise(F.concat(F.lit("Visual, "), place))
    )


def review_state(segments: DataFrame) -> DataFrame:
    """Adds `review`: flags, scores, boundary, path and blocked reason in one struct.

    The frame has shortlisted, clip_gated, budget_capped, deduplicated, dedup_group, clip_score, understood, validated,
    boundary_strategy and boundary_confidence; missing flags count as false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    path = analysis_path([(F.col("boundary_strategy").isNotNull(), "screened"), (flag("shortlisted"), "shortlisted"), (F.col("clip_score").isNotNull(), "vector scored"), (flag("deduplicated"), "deduplicated"), (flag("validated"), "validated"), (flag("understood"), "understood")])
    fields = [flag(c).alias(c) for c in ("shortlisted", "clip_gated", "budget_capped", "deduplicated", "understood", "validated")]
    return segments.withColumn("review", F.struct(*fields, "dedup_group", "clip_score", "boundary_confidence", strategy_label(F.col("boundary_strategy")).alias("boundary"), path.alias("path"), blocked_reason().alias("blocked_reason")))


def transcript_text(status: Column, turn_count: Column, source: Column, mode: Column) -> Column:
    """What is known of a segment's transcript."""
    return (
        F.when((status == "excerpt-available") & (F.coalesce(turn_count, F.lit(0)) > 0), F.concat(F.lit("Transcript on "), _plural(turn_count, "turn")))
        .when(status == "excerpt-available", "Transcript")
        .when(status == "selective-skip", "Transcription skipped for faint speech")
        .when(status == "fallback-no-transcript", F.concat(F.lit("Speech without transcript ("), F.coalesce(F.nullif(source, F.lit("")), F.lit("speech-signal-fallback")), F.lit(")")))
        .when(status.startswith("provider-"), F.concat(F.lit("No text from the transcriber ("), status, F.lit(")")))
        .when(mode == "speech", "Speech scored without transcript")
        .otherwise("No transcript needed")
    )


def structure_text(label: Column, cues: Column) -> Column:
    """How speech is built, with up to three cues."""
    some = F.when(F.size(cues) > 0, F.concat(F.lit(" ("), human_join(F.transform(F.slice(cues, 1, 3), _words)), F.lit(")"))).otherwise("")
    return F.when(F.coalesce(label, F.lit("")) == "", "").otherwise(F.concat(F.lit("Speech reads as "), _words(label), some))


def review_record() -> Column:
    """The review of a segment, of 23 fields.

    From the columns shortlisted, filtered_before_vlm, clip_score, clip_gated, deduplicated, dedup_group_id, vlm_budget_capped,
    provider (of the understanding, or null), keyframe_count, boundary_strategy, boundary_confidence, operation, rule_family,
    source_ids, seed_ids, seed_sources, validation_status, validation_decision, validation_confidence, validation_reason,
    skip_reason, has_speech, transcript_excerpt, transcript_runtime, looked_up, mode_source, analysis_mode, turn_count,
    turn_alignment, structure_label and structure_cues; nulls count as false, 0 or nothing.
    """
    c = F.col
    flag = lambda name: F.coalesce(c(name), F.lit(False))
    modelled, ruled = F.coalesce(c("provider") != "deterministic", F.lit(False)), F.coalesce(c("provider") == "deterministic", F.lit(False))
    frames = F.coalesce("keyframe_count", F.lit(0))
    path = analysis_path([(~flag("shortlisted"), "screened locally"), (flag("shortlisted"), "shortlisted"), (c("clip_score").isNotNull(), "vector scored"), (flag("deduplicated"), "deduplicated"), (frames > 0, "evidence"), (modelled, "model"), (ruled, "rules"), (c("validation_status") == "validated", "validated")])
    status = transcript_status(c("has_speech"), F.trim("transcript_excerpt") != "", c("transcript_runtime"), c("looked_up"))
    blocked = F.coalesce(F.when(flag("deduplicated"), "duplicate"), F.when(flag("clip_gated"), "clip_gate"), F.when(flag("vlm_budget_capped"), "budget_cap"), F.when(~flag("shortlisted"), "shortlist_filter"), F.lit(""))
    return F.struct(
        *(flag(n).alias(n) for n in ("shortlisted", "filtered_before_vlm")),
        c("clip_score").isNotNull().alias("clip_scored"),
        rounded("clip_score", 4).alias("clip_score"),
        *(flag(n).alias(n) for n in ("clip_gated", "deduplicated")),
        "dedup_group_id",
        flag("vlm_budget_capped").alias("vlm_budget_capped"),
        modelled.alias("model_analyzed"),
        ruled.alias("deterministic_fallback"),
        frames.alias("evidence_keyframe_count"),
        path.alias("analysis_path_summary"),
        blocked.alias("blocked_reason"),
        strategy_label(c("boundary_strategy")).alias("boundary_strategy_label"),
        rounded("boundary_confidence", 4).alias("boundary_confidence"),
        lineage(c("operation"), c("rule_family"), c("source_ids"), c("seed_ids"), c("seed_sources")).alias("lineage_summary"),
        F.coalesce("validation_status", F.lit("")).alias("semantic_validation_status"),
        F.coalesce(validation_text(c("validation_status"), c("validation_decision"), c("validation_confidence"), c("validation_reason"), c("skip_reason")), F.lit("")).alias("semantic_validation_summary"),
        status.alias("transcript_status"),
        transcript_text(status, c("turn_count"), c("mode_source"), c("analysis_mode")).alias("transcript_summary"),
        c("mode_source").alias("speech_mode_source"),
        turn_text(c("turn_count"), F.coalesce("rule_family", F.lit("")), c("turn_alignment")).alias("turn_summary"),
        structure_text(c("structure_label"), c("structure_cues")).alias("speech_structure_summary"),
    )


def gathered(rows: DataFrame, keys: list[str], lists: list[str], order: str, own: str) -> DataFrame:
    """keys and each list column united over the group in order, distinct; an empty union gives the `own` values."""

    def united(c: str) -> Column:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v")))), lambda x: x["v"])
        return F.array_distinct(F.flatten(parts))

    alone = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(own).cast("string").alias("v")))), lambda x: x["v"])
    return rows.groupBy(*keys).agg(*(F.when(F.size(united(c)) > 0, united(c)).otherwise(alone).alias(c) for c in lists))


#: What earlier evidence must agree in to be used again; fixed names.
EVIDENCE = ("media_path", "transcript_excerpt", "story_prompt", "analysis_mode", "transcript_status", "speech_mode_source", "keyframe_sec", "context_start", "context_end", "metrics", "keyframe_max_width")


def evidence(segments: DataFrame, keyframes: int | None = None, max_width: int = 640, images: bool = True) -> DataFrame:
    """Segments with what their evidence would be: keyframe_sec, context_start, context_end and keyframe_max_width.

    The context runs from the start of the segment before to the end of the one after, in the order of pos within the asset.
    """
    order = Window.partitionBy("asset_id").orderBy("pos")
    context = {"context_start": F.coalesce(F.lag("start_sec").over(order), F.col("start_sec")), "context_end": F.coalesce(F.lead("end_sec").over(order), F.col("end_sec"))}
    times = keyframe_timestamps(F.col("start_sec"), F.col("end_sec"), None if keyframes is None else F.lit(keyframes))
    rows = segments.withColumns({k: rounded(v, 3) for k, v in context.items()})
    return rows.withColumns({"keyframe_sec": times, "keyframe_max_width": F.lit(max_width if images else 0)})


def evidence_reuse(wanted: DataFrame, previous: DataFrame, key: str = "segment_id", compared: tuple[str, ...] = EVIDENCE) -> DataFrame:
    """Adds `reused`, whether the earlier evidence of the segment agrees in all compared fields (null-safe), and `differs`, those it doesn't.

    Maps are compared by their entries, whatever their order.
    """
    entries = lambda c, kind: F.array_sort(F.map_entries(c)) if kind.startswith("map") else c
    kinds = dict(wanted.dtypes)
    old = previous.select(key, *(F.col(c).alias(f"_old_{c}") for c in compared), F.lit(True).alias("_has"))
    rows = wanted.join(old, key, "left")
    same = {c: entries(F.col(c), kinds[c]).eqNullSafe(entries(F.col(f"_old_{c}"), kinds[c])) for c in compared}
    differs = F.filter(F.array(*(F.when(F.col("_has") & ~s, F.lit(c)) for c, s in same.items())), lambda x: x.isNotNull())
    rows = rows.withColumn("differs", differs).withColumn("reused", F.coalesce("_has", F.lit(False)) & (F.size("differs") == 0))
    return rows.drop("_has", *(f"_old_{c}" for c in compared))
