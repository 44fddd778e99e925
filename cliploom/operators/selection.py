"""Ranking, best takes, shortlists, gates and budgets.  W01, W06, L01-L04, A09, P13, P14, P25, P32 of the survey.

Segment frames carry asset_id, segment_id and pos, the input order that breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, padded, rounded
from ..sources.scratch import written
from .views import numbered

# Fixed values.
MIN_SCORE, ALTERNATE_GAP, LONG_CLIP_SEC = 0.68, 0.08, 18.0


def ranked_takes(segments: DataFrame) -> DataFrame:
    """Adds within_asset_rank, winner_score, score_gap, is_selected, outcome and take_id.

    Selected are totals of 0.68 or more within 0.08 of the winner: two where the clip lasts 18 seconds, else one; if none
    qualifies, the winner alone.
    """
    by_rank = Window.partitionBy("asset_id").orderBy(F.desc("score_total"), "pos")
    whole = Window.partitionBy("asset_id")
    rows = segments.withColumn("within_asset_rank", F.row_number().over(by_rank)).withColumn("winner_score", F.max("score_total").over(whole))
    rows = rows.withColumn("score_gap", rounded(F.greatest(F.lit(0.0), F.col("winner_score") - F.col("score_total")), 4))
    fits = (F.col("score_total") >= MIN_SCORE) & (F.col("score_total") >= F.col("winner_score") - ALTERNATE_GAP)
    # Qualifying rows are the first ranks, so a rank is also the place among them.
    chosen = (fits & (F.col("within_asset_rank") <= F.when(F.col("duration_sec") >= LONG_CLIP_SEC, 2).otherwise(1))) | ((F.col("within_asset_rank") == 1) & (F.col("winner_score") < MIN_SCORE))
    rows = rows.withColumn("is_selected", chosen)
    rows = rows.withColumn("outcome", F.when(F.col("within_asset_rank") == 1, "best").when(F.col("is_selected"), "alternate").otherwise("backup"))
    number = F.row_number().over(Window.partitionBy("asset_id").orderBy("pos"))
    return rows.withColumn("take_id", F.concat(F.col("asset_id").cast("string"), F.lit("-take-"), padded(number, 2)))


def reason(drivers: Column, limiting: Column) -> Column:
    """Why a take won, stayed or fell back; lists are already joined texts."""
    points = lambda x: F.floor(x * 100 + 0.5).cast("int").cast("string")
    gap = points(F.col("score_gap"))
    weak = F.when(limiting != "", limiting).otherwise(drivers)
    return (
        F.when(F.col("outcome") == "best", F.concat(F.lit("Best of its clip with "), points(F.col("score_total")), F.lit("/100 for "), drivers))
        .when(F.col("outcome") == "alternate", F.concat(F.lit("Alternate, "), gap, F.lit(" behind the best, for "), drivers))
        .when(F.col("score_total") < MIN_SCORE, F.concat(F.lit("Backup under the threshold of 68/100, strongest in "), drivers))
        .when((F.col("duration_sec") >= LONG_CLIP_SEC) & (F.col("score_gap") > ALTERNATE_GAP), F.concat(F.lit("Backup, "), gap, F.lit(" behind the best, mainly in "), weak))
        .otherwise(F.concat(F.lit("Backup at rank "), F.col("within_asset_rank").cast("string"), F.lit(", mainly in "), weak))
    )


def shortlist(segments: DataFrame, limit: int = 1, fast: bool = True) -> DataFrame:
    """The first max(1, limit) segments of an asset by prefilter_score; all of them unless fast."""
    if not fast:
        return segments
    turn = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("prefilter_score"), "pos"))
    return segments.withColumn("_turn", turn).where(F.col("_turn") <= max(1, limit)).drop("_turn")


def staged_targets(segments: DataFrame, limit: int, budget_pct: float, scope: str = "asset") -> DataFrame:
    """Shortlisted, not gated, not duplicate segments by (clip + prefilter) / 2: target, capped or dropped.

    Adds gate_rank and stage: `target`, `budget_capped` (over max(1, percent of those within the limit)) or `over_limit`.
    The percentage applies per asset, or over all assets with scope="run".
    """
    rows = segments.where("shortlisted and not gated and not deduplicated")
    score = (F.coalesce("clip_score", F.lit(0.0)) + F.coalesce("prefilter_score", F.lit(0.0))) / 2
    rows = rows.withColumn("gate_score", rounded(score, 6))
    rows = rows.withColumn("gate_rank", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("gate_score"), "pos")))
    inside = F.col("gate_rank") <= limit
    if scope == "asset":
        n = F.least(F.count(F.lit(1)).over(Window.partitionBy("asset_id")), F.lit(limit))
        place = F.col("gate_rank")
    else:
        rows = rows.withColumn("_in", inside.cast("int"))
        n = F.sum("_in").over(Window.partitionBy())
        place = F.row_number().over(Window.orderBy(F.desc("_in"), F.desc("gate_score"), "asset_id", "pos"))
    quota = F.greatest(F.lit(1), F.floor(n * F.lit(budget_pct) / 100))
    rows = rows.withColumn("_keep", place <= quota)
    return rows.withColumn("stage", F.when(~inside, "over_limit").when(F.col("_keep"), "target").otherwise("budget_capped")).drop("_keep", "_in")


def ambiguity_targets(segments: DataFrame, threshold: float = 0.6, floor: float = 0.45, min_targets: int = 1) -> DataFrame:
    """Per asset, segments whose ambiguity reaches the threshold; if none, the first few that reach the floor.

    Adds target_rank and target_reason (`threshold` or `floor`), ordered by (ambiguity, score) descending.
    """
    order = Window.partitionBy("asset_id").orderBy(F.desc("ambiguity"), F.desc("score_total"), "pos")
    rows = segments.withColumn("target_rank", F.row_number().over(order)).withColumn("_most", F.max("ambiguity").over(Window.partitionBy("asset_id")))
    by_threshold = F.col("ambiguity") >= threshold
    by_floor = (F.col("_most") < threshold) & (F.col("ambiguity") >= floor) & (F.col("target_rank") <= min_targets)
    return rows.where(by_threshold | by_floor).withColumn("target_reason", F.when(by_threshold, "threshold").otherwise("floor")).drop("_most")


def run_budget(total: Column, pct: float, most: int) -> Column:
    """min(total, most, max(1, percent of total)); 0 when there is nothing or the percentage is 0."""
    share = F.greatest(F.lit(1), F.floor(total * F.lit(float(pct)) / 100))
    return F.when((total <= 0) | (F.lit(pct) <= 0), F.lit(0)).otherwise(F.least(total, F.lit(most), share)).cast("int")


def drained(targets: DataFrame, pct: float = 100.0, most: int = 2) -> DataFrame:
    """The run-wide budget spent asset by asset: adds run_rank and status (`pending` or `over_budget`).

    Ranks are places in the order of assets and their targets, found without gathering them in a task.
    """
    rows = written(targets)
    budget = run_budget(F.lit(rows.count()), pct, most)
    ranked = numbered(rows, [F.col("asset_id"), F.col("target_rank")], "run_rank")
    return ranked.withColumn("status", F.when(F.col("run_rank") <= budget, "pending").otherwise("over_budget"))


def seed_drift(start: Column, end: Column, seeds: Column) -> Column:
    """Distance of a segment's centre from the mean centre of its valid seed ranges; 0 without any."""
    valid = F.filter(seeds, lambda r: r["end"] > r["start"])
    total = F.aggregate(valid, F.lit(0.0), lambda acc, r: acc + (r["start"] + r["end"]) / 2)
    return F.when(F.size(valid) > 0, F.abs((start + end) / 2 - total / F.size(valid))).otherwise(F.lit(0.0))


def ambiguity() -> Column:
    """How doubtful a segment's boundary is, from its boundary_confidence, boundary_strategy, rule_family, drift and speech."""
    strategy, family = F.coalesce("boundary_strategy", F.lit("")), F.coalesce("rule_family", F.lit(""))
    alignment = F.coalesce("turn_alignment", F.lit(""))
    speech, turn = F.col("analysis_mode") == "speech", F.coalesce("turn_completeness", F.lit(1.0))
    length, drift = F.col("end_sec") - F.col("start_sec"), F.col("drift")
    rules: list[tuple[Column, float]] = [
        (strategy.isin("legacy", "duration-rule", "scene-duration"), 0.18),
        (strategy.startswith("assembly-merge:structural"), 0.16),
        (F.col("operation") == "split", 0.20),
        ((F.col("operation") == "merge") & (family == "structural-continuity"), 0.12),
        (strategy.isin("audio-snap", "scene-snap") & (drift >= 1.0), 0.08),
        ((strategy == "transcript-snap") & (drift >= 0.75), 0.04),
        ((strategy == "turn-snap") & (drift >= 0.5), 0.03),
        (speech & (alignment == "partial-turn"), 0.08),
        (speech & (alignment == "mostly-complete"), 0.03),
        (speech & (family == "turn-break"), 0.14),
        (speech & (family == "turn-continuity"), 0.04),
        (speech & (F.coalesce("turn_count", F.lit(0)) >= 2), 0.05),
        (speech & (turn < 0.7), 0.06),
        (speech & (turn < 0.5), 0.08),
        (speech & (length >= 2) & (length <= 7), 0.08),
        (~speech & (F.coalesce("motion_energy", F.lit(0.0)) >= 0.65), 0.06),
    ]
    total = F.lit(1.0) - clamp(F.col("boundary_confidence"))
    for test, points in rules:
        total = total + F.when(F.coalesce(test, F.lit(False)), F.lit(points)).otherwise(F.lit(0.0))
    return F.when(F.col("boundary_confidence").isNull(), F.lit(0.0)).otherwise(rounded(clamp(total), 4))


def initial_validation(enabled: bool, available: bool) -> Column:
    """(status, skip_reason) before any budget, from `targeted`."""
    status = lambda s, why: F.struct(F.lit(s).alias("status"), F.lit(why).alias("skip_reason"))
    if not enabled:
        return status("skipped", "disabled")
    if not available:
        return F.when(F.col("targeted"), status("skipped", "ai_unavailable")).otherwise(status("not_eligible", ""))
    return F.when(F.col("targeted"), status("pending", "")).otherwise(status("not_eligible", ""))


def clamped_range_value(value: Column, current: Column, low: Column, high: Column, most: float = 1.5) -> Column:
    """Within [low, high], then within `most` of the current value, then within [low, high] again; 3 places."""
    inside = lambda x, a, b: F.greatest(a, F.least(b, x))
    return rounded(inside(inside(inside(value, low, high), current - most, current + most), low, high), 3)


def split_supported() -> Column:
    """Whether a segment may be split by validation."""
    snapped = F.col("boundary_strategy").startswith("transcript-") | (F.col("boundary_strategy") == "turn-snap")
    return F.col("operation").isin("split", "merge") | (F.coalesce("turn_count", F.lit(0)) >= 2) | ((F.col("analysis_mode") == "speech") & (F.col("boundary_confidence") >= 0.85) & snapped)
