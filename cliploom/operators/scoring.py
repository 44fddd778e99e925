"""Metrics, analysis mode, weighted scores and what drives them.  Operators P01-P09, P19 and P26-P27 of the survey.

Frames of segments hold flat metric columns: sharpness, stability, visual_novelty, subject_clarity, motion_energy,
duration_fit, audio_energy, speech_ratio, hook_strength, story_alignment and, where known, turn_completeness,
question_answer_flow, monologue_continuity, spoken_beat_completeness and clip_score.  Missing ones count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, divided, fixed3, hash_unit, rounded, weighted_average

# Fixed values.
BLEND = {"technical": 0.35, "semantic": 0.40, "story": 0.25}
LABELS = {
    "audio_energy": "audio energy",
    "clip_score": "CLIP semantic match",
    "duration_fit": "duration fit",
    "hook_strength": "hook strength",
    "motion_energy": "motion energy",
    "sharpness": "sharpness",
    "question_answer_flow": "question/answer flow",
    "speech_ratio": "speech ratio",
    "spoken_beat_completeness": "spoken beat completeness",
    "stability": "stability",
    "story_alignment": "story alignment",
    "subject_clarity": "subject clarity",
    "turn_completeness": "turn completeness",
    "visual_novelty": "visual novelty",
    "monologue_continuity": "monologue continuity",
}
METRICS = ("sharpness", "stability", "visual_novelty", "subject_clarity", "motion_energy", "duration_fit", "audio_energy", "speech_ratio", "hook_strength", "story_alignment")
OPTIONAL = ("turn_completeness", "question_answer_flow", "monologue_continuity", "spoken_beat_completeness", "clip_score")


def with_optional(segments: DataFrame) -> DataFrame:
    """The frame with null columns for the metrics that it lacks."""
    return segments.withColumns({c: F.lit(None).cast("double") for c in OPTIONAL if c not in segments.columns})


def signal_score(sharpness: Column, contrast: Column, motion: Column, distinct: Column, center: Column) -> Column:
    return clamp(0.26 * sharpness + 0.16 * contrast + 0.22 * motion + 0.20 * distinct + 0.16 * center)


def duration_fit(length: Column) -> Column:
    return clamp(1 - F.abs(F.greatest(F.lit(0.1), length) - 5.5) / 7)


def projected_metrics(prefilter: Column, clarity: Column, motion: Column, novelty: Column, length: Column) -> dict[str, Column]:
    """duration_fit, hook_strength and story_alignment from screening values, 4 places."""
    fit = duration_fit(length)
    return {
        "duration_fit": rounded(fit, 4),
        "hook_strength": rounded(clamp(0.5 * prefilter + 0.25 * clarity + 0.25 * motion), 4),
        "story_alignment": rounded(clamp(0.45 * prefilter + 0.25 * novelty + 0.2 * clarity + 0.1 * fit), 4),
    }


def seeded_metrics(asset_id: Column, name: Column, source: Column, proxy: Column, reel: Column, start: Column, end: Column) -> dict[str, Column]:
    """Hash-seeded metrics for segments without screening values."""
    length = rounded(end - start, 3)
    seed = lambda key, a, b: hash_unit(F.concat_ws(":", key, fixed3(a), fixed3(b)))
    u, v = seed(asset_id, start, end), seed(name, end, start)
    values = {
        "motion_energy": 0.45 + 0.45 * u,
        "visual_novelty": 0.4 + 0.5 * v,
        "subject_clarity": 0.58 + 0.32 * seed(proxy, length, start),
        "hook_strength": 0.52 + 0.38 * seed(reel, end, length),
        "story_alignment": 0.55 + 0.35 * seed(source, start, length),
        "sharpness": 0.62 + 0.28 * u,
        "stability": 0.56 + 0.26 * v,
        "audio_energy": F.lit(0.0),
        "speech_ratio": F.lit(0.0),
        "duration_fit": duration_fit(length),
    }
    return {k: rounded(clamp(x), 4) for k, x in values.items()}


def analysis_mode(has_speech: Column, excerpt: Column, speech_ratio: Column, audio_energy: Column) -> Column:
    """(mode, source)."""
    ratio, energy = F.coalesce(speech_ratio, F.lit(0.0)), F.coalesce(audio_energy, F.lit(0.0))
    pair = lambda mode, source: F.struct(F.lit(mode).alias("mode"), F.lit(source).alias("source"))
    return (
        F.when(~F.coalesce(has_speech, F.lit(False)), pair("visual", "not-applicable"))
        .when(F.trim(F.coalesce(excerpt, F.lit(""))) != "", pair("speech", "transcript"))
        .when((ratio >= 0.9) | ((ratio >= 0.65) & (energy >= 0.2)), pair("speech", "speech-signal-fallback"))
        .otherwise(pair("visual", "visual"))
    )


def components(mode: Column, has_excerpt: Column) -> dict[str, list[tuple[str, Column, Column]]]:
    """Per component, (driver, value, weight): a null weight leaves the driver out."""
    m = {c: F.col(c) for c in METRICS + OPTIONAL}
    speech = mode == "speech"
    turn = F.coalesce(m["turn_completeness"], F.when(has_excerpt, F.lit(0.75)).otherwise(F.lit(0.0)))
    beat = F.coalesce(m["spoken_beat_completeness"], turn)
    answers, flows = clamp(m["question_answer_flow"]) > 0, clamp(m["monologue_continuity"]) > 0
    fuller = beat > turn + 0.01
    only = lambda test, w: F.when(test, F.lit(w) if isinstance(w, float) else w)
    by_mode = lambda spoken, seen: F.when(speech, F.lit(spoken) if isinstance(spoken, float | None) else spoken).otherwise(F.lit(seen) if isinstance(seen, float | None) else seen)
    pick = lambda test, yes, no: F.when(test, F.lit(yes)).otherwise(no if isinstance(no, Column) else F.lit(no))
    zero = F.lit(0.0)
    return {
        "technical": [
            ("sharpness", m["sharpness"], F.lit(0.22)),
            ("stability", m["stability"], F.lit(0.18)),
            ("duration_fit", m["duration_fit"], F.lit(0.20)),
            ("subject_clarity", m["subject_clarity"], F.lit(0.18)),
            # The unused modality keeps its weight with a value of 0.
            ("audio_energy", by_mode(m["audio_energy"], zero), F.lit(0.22)),
            ("motion_energy", by_mode(zero, m["motion_energy"]), F.lit(0.22)),
        ],
        "semantic": [
            ("visual_novelty", m["visual_novelty"], only(~speech, 0.34)),
            ("hook_strength", m["hook_strength"], by_mode(pick(answers, 0.18, 0.22), 0.24)),
            ("story_alignment", m["story_alignment"], only(speech, pick(answers, 0.18, 0.20))),
            ("speech_ratio", m["speech_ratio"], only(speech, pick(flows, 0.13, 0.16))),
            ("subject_clarity", m["subject_clarity"], by_mode(pick(flows, 0.10, 0.12), 0.18)),
            ("motion_energy", m["motion_energy"], only(~speech, 0.24)),
            ("turn_completeness", turn, only(speech, 0.14)),
            ("question_answer_flow", m["question_answer_flow"], only(speech & answers, 0.10)),
            ("monologue_continuity", m["monologue_continuity"], only(speech & flows, 0.06)),
            ("clip_score", m["clip_score"], only(m["clip_score"].isNotNull(), by_mode(0.12, 0.15))),
        ],
        "story": [
            ("story_alignment", m["story_alignment"], by_mode(pick(answers, 0.32, 0.36), 0.38)),
            ("visual_novelty", m["visual_novelty"], only(~speech, 0.28)),
            ("hook_strength", m["hook_strength"], only(speech, pick(fuller, 0.18, 0.22))),
            ("duration_fit", m["duration_fit"], by_mode(pick(fuller, 0.14, 0.20), 0.20)),
            ("turn_completeness", turn, only(speech, 0.22)),
            ("motion_energy", m["motion_energy"], only(~speech, 0.14)),
            ("spoken_beat_completeness", beat, only(speech & fuller, 0.12)),
            ("question_answer_flow", m["question_answer_flow"], only(speech & answers, 0.06)),
        ],
    }


def with_mode(segments: DataFrame) -> DataFrame:
    """Adds analysis_mode and mode_source, from the metrics and the excerpt."""
    found = analysis_mode(F.col("has_speech"), F.col("transcript_excerpt"), F.col("speech_ratio"), F.col("audio_energy"))
    return segments.withColumn("_mode", found).withColumns({"analysis_mode": F.col("_mode.mode"), "mode_source": F.col("_mode.source")}).drop("_mode")


def with_scores(segments: DataFrame) -> DataFrame:
    """Adds analysis_mode, mode_source, score_technical, score_semantic, score_story and score_total (4 places).

    The total comes from unrounded parts.
    """
    own = segments.columns
    rows = with_mode(with_optional(segments))
    parts = components(F.col("analysis_mode"), F.trim(F.coalesce("transcript_excerpt", F.lit(""))) != "")
    raw = {name: weighted_average([(v, w) for _, v, w in parts[name]]) for name in BLEND}
    rows = rows.withColumns({f"_{name}": x for name, x in raw.items()})
    total = clamp(BLEND["technical"] * F.col("_technical") + BLEND["semantic"] * F.col("_semantic") + BLEND["story"] * F.col("_story"))
    scores = {f"score_{name}": rounded(F.col(f"_{name}"), 4) for name in BLEND} | {"score_total": rounded(total, 4)}
    return rows.withColumns(scores).select(*own, "analysis_mode", "mode_source", *scores)


def with_shares(segments: DataFrame) -> DataFrame:
    """Adds shares: (driver, contribution) of each driver, in a fixed order; shares of the blended total, 6 places, added up over components."""
    rows = with_optional(segments)
    parts = components(F.col("analysis_mode"), F.trim(F.coalesce("transcript_excerpt", F.lit(""))) != "")
    of_driver: dict[str, list[Column]] = {}
    for name, drivers in parts.items():
        weights = F.lit(0.0)
        for _, _, w in drivers:
            weights = weights + F.coalesce(w, F.lit(0.0))
        for driver, v, w in drivers:
            of_driver.setdefault(driver, []).append(clamp(v) * divided(F.coalesce(w, F.lit(0.0)), weights) * BLEND[name])
    # The small addend makes halves round up whatever the order of the sum.
    total = {driver: rounded(sum(own[1:], own[0]) + F.lit(1e-9), 6) for driver, own in of_driver.items()}
    return rows.withColumn("shares", F.array(*(F.struct(F.lit(d).alias("driver"), x.alias("contribution")) for d, x in total.items()))).select(*segments.columns, "shares")


def contributions(segments: DataFrame, keys: tuple[str, ...] = ("asset_id", "segment_id")) -> DataFrame:
    """keys, driver, contribution, a row per driver."""
    # The outer form, as there are always drivers: the optimiser would compute all shares once more to see that.
    return with_shares(segments).select(*keys, F.inline_outer("shares"))


def label_of(driver: Column) -> Column:
    pairs = [F.lit(x) for pair in LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), driver), F.regexp_replace(driver, "_", " "))


def _first_labels(ranked: Column, limit: int) -> Column:
    """Labels of the largest of (value, driver) structs over 0, ties by label."""
    named = F.transform(F.filter(ranked, lambda x: x["value"] > 0), lambda x: F.struct((-x["value"]).alias("rank"), label_of(x["driver"]).alias("label")))
    return F.transform(F.slice(F.sort_array(named), 1, limit), lambda x: x["label"])


def _with_some(rows: DataFrame, keys: tuple[str, ...], labels: Column) -> DataFrame:
    """keys and labels, where there are any.  The generator keeps the test above it, which would else compute the labels again."""
    return rows.select(*keys, F.explode_outer(F.array(labels)).alias("labels")).where(F.size("labels") > 0)


def top_drivers(rows: DataFrame, keys: tuple[str, ...] = ("asset_id", "segment_id"), limit: int = 3) -> DataFrame:
    """keys and labels of rows with shares: the drivers that contribute most, ties by label; rows without any are left out."""
    ranked = F.transform("shares", lambda x: F.struct(x["contribution"].alias("value"), x["driver"].alias("driver")))
    return _with_some(rows, keys, _first_labels(ranked, limit))


def limiting_factors(rows: DataFrame, winners: DataFrame, limit: int = 2) -> DataFrame:
    """asset_id, segment_id and labels of rows with shares: where the asset's winner (asset_id, shares) contributes more."""
    best = winners.select("asset_id", F.col("shares").alias("_best"))
    gap = lambda b, x: F.struct(rounded(b["contribution"] - x["contribution"], 6).alias("value"), x["driver"].alias("driver"))
    return _with_some(rows.join(best, "asset_id"), ("asset_id", "segment_id"), _first_labels(F.zip_with("_best", "shares", gap), limit))


def understanding() -> Column:
    """The rule-based record of a segment: confidence, keep label and label lists."""
    m = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in METRICS}
    novelty, clarity, motion, story, fit = m["visual_novelty"], m["subject_clarity"], m["motion_energy"], m["story_alignment"], m["duration_fit"]
    confidence = rounded((novelty + clarity + story) / 3, 4)

    def listed(rules: list[tuple[Column, str]], default: Column | None = None) -> Column:
        found = F.filter(F.array(*(F.when(test, F.lit(label)) for test, label in rules)), lambda x: x.isNotNull())
        return found if default is None else F.when(F.size(found) == 0, F.array(default)).otherwise(found)

    speech = F.col("analysis_mode") == "speech"
    return F.struct(
        confidence.alias("confidence"),
        F.when(confidence >= 0.75, "keep").when(confidence >= 0.58, "maybe").otherwise("reject").alias("keep_label"),
        listed([(F.col("start_sec") <= 0.5, "opener"), (story >= 0.72, "bridge"), (novelty >= 0.78, "payoff")], F.when(clarity >= 0.78, "detail").otherwise("bridge")).alias("story_roles"),
        listed([(clarity >= 0.8, "clear framing"), (motion >= 0.72, "usable motion"), (fit >= 0.75, "rough-cut friendly duration")], F.lit("usable coverage")).alias("quality_findings"),
        listed([(motion < 0.38, "low_motion"), (clarity < 0.6, "low_clarity"), (story < 0.58, "weak_story_fit")]).alias("risk_flags"),
        F.when((novelty >= 0.8) & (motion >= 0.7), "wide").when(clarity >= 0.8, "detail").when(motion < 0.45, "static").otherwise("medium").alias("shot_type"),
        F.when(motion < 0.35, "static").when(motion < 0.65, "gentle movement").otherwise("active movement").alias("camera_motion"),
        F.when(speech & (story >= 0.7), "informative").when(speech, "conversational").when(motion >= 0.72, "energetic").when(novelty >= 0.76, "cinematic").otherwise("steady").alias("mood"),
    )


def visual_role(novelty: Column, motion: Column, clarity: Column) -> Column:
    n, m, c = (F.coalesce(x, F.lit(0.0)) for x in (novelty, motion, clarity))
    return F.when((n >= 0.8) & (m >= 0.7), "dynamic").when(m < 0.45, "calm").when(c >= 0.8, "clear detail").otherwise("transition-ready")


def transcript_status(has_speech: Column, has_excerpt: Column, runtime: Column, looked_up: Column) -> Column:
    """The first that holds."""
    return (
        F.when(~has_speech, "not-applicable")
        .when(has_excerpt, "excerpt-available")
        .when(~looked_up, "selective-skip")
        .when(runtime == "fallback", "fallback-no-transcript")
        .when(runtime.isin("disabled", "unavailable", "partial"), F.concat(F.lit("provider-"), runtime))
        .otherwise("no-transcript-match")
    )


def clip_score(snapshot: Column) -> Column:
    """The vector score out of a segment's map of screening metrics; null without the map or the key."""
    return F.try_element_at(snapshot, F.lit("clip_score"))
