"""Transcript turns, spoken structure and the speech gate.  W02, J05, A02, A03, P36, P61, L05 of the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, divided, padded, rounded
from ..functions.text import is_question
from .intervals import islands, sessions


def ordered_text(start: str = "start_sec", end: str = "end_sec", text: str = "text") -> Column:
    """Non-blank texts of a group in order of time."""
    rows = F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct(start, end, F.trim(text).alias("t")))))
    return F.array_join(F.transform(rows, lambda x: x["t"]), " ")


def turns(spans: DataFrame, key: str = "asset_id", gap: float = 0.9) -> DataFrame:
    """key, turn, turn_id, start_sec, end_sec, text, span_count: spans joined while the pause after the previous one is at most `gap`."""
    rows = sessions(spans, key, "start_sec", "end_sec", gap)
    out = rows.groupBy(key, F.col("session").alias("turn")).agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), ordered_text().alias("text"), F.count(F.lit(1)).alias("span_count"))
    return out.withColumn("turn_id", F.concat(F.lit("turn-"), padded(F.col("turn"), 2)))


def turn_alignment(overlapping: DataFrame, keys: list[str], tolerance: float = 0.45) -> DataFrame:
    """keys, turn_count, turn_completeness, turn_alignment of segments (start_sec, end_sec) with their turns (t_start, t_end)."""
    rows = overlapping.groupBy(*keys).agg(F.min("start_sec").alias("s"), F.max("end_sec").alias("e"), F.min("t_start").alias("a"), F.max("t_end").alias("b"), F.count(F.lit(1)).alias("turn_count"))
    covered = clamp(divided(F.greatest(F.lit(0.0), F.least("e", "b") - F.greatest("s", "a")), F.col("b") - F.col("a")))
    left = clamp(1 - F.greatest(F.lit(0.0), F.col("s") - F.col("a")) / tolerance)
    right = clamp(1 - F.greatest(F.lit(0.0), F.col("b") - F.col("e")) / tolerance)
    rows = rows.withColumns({"coverage": covered, "left_edge": left, "right_edge": right})
    label = F.when((F.col("left_edge") >= 0.85) & (F.col("right_edge") >= 0.85), "turn-aligned").when(F.col("coverage") >= 0.8, "mostly-complete").otherwise("partial-turn")
    score = rounded(clamp(0.55 * F.col("coverage") + 0.45 * (F.col("left_edge") + F.col("right_edge")) / 2), 4)
    return rows.select(*keys, "turn_count", score.alias("turn_completeness"), label.alias("turn_alignment"))


def question_pairs(spans: DataFrame, key: str, order: str, text: str = "text", pause: Column | None = None, most: float = 1.6) -> DataFrame:
    """Rows that ask and are followed, within `most`, by one that does not: key, order, question, answer."""
    w = Window.partitionBy(key).orderBy(order)
    rows = spans.withColumns({"_q": is_question(text), "_next": F.lead(text).over(w)}).withColumns({"_next_q": is_question("_next"), "_pause": (pause if pause is not None else F.lit(0.0))})
    return rows.where(F.col("_q") & F.col("_next").isNotNull() & ~F.col("_next_q") & (F.col("_pause") <= most)).select(key, order, F.col(text).alias("question"), F.col("_next").alias("answer"))


def spoken_structure(spans: DataFrame, key: str, order: str = "start_sec") -> DataFrame:
    """key, n_spans, question_answer_flow (.9 with an answered question), monologue_continuity (.82, or .68 with one question before the end)."""
    w = Window.partitionBy(key).orderBy(order, "end_sec")
    rows = spans.withColumns({"_q": is_question("text"), "_gap": F.lead("start_sec").over(w) - F.col("end_sec"), "_next": is_question(F.lead("text").over(w)), "_last": F.lead("start_sec").over(w).isNull()})
    found = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.max((F.col("_q") & ~F.col("_last") & ~F.col("_next") & (F.col("_gap") <= 1.6)).cast("int")).alias("answered"),
        F.coalesce(F.max("_gap"), F.lit(0.0)).alias("widest"),
        F.count_if("_q").alias("questions"),
        F.max((F.col("_q") & F.col("_last")).cast("int")).alias("ends_asking"),
    )
    flow = F.when(F.col("answered") == 1, 0.9).otherwise(0.0)
    steady = (F.col("answered") == 0) & (F.col("n_spans") > 1) & (F.col("widest") <= 0.95)
    mono = F.when(steady & (F.col("questions") == 0), 0.82).when(steady & (F.col("questions") == 1) & (F.col("ends_asking") == 0), 0.68).otherwise(0.0)
    return found.select(key, "n_spans", "questions", flow.alias("question_answer_flow"), mono.alias("monologue_continuity"))


def beat_completeness(turn: Column, edges: Column, flow: Column, mono: Column) -> Column:
    return rounded(clamp(0.6 * turn + 0.25 * edges + 0.1 * flow + 0.05 * mono), 4)


def speech_gate(audio: DataFrame, key: str = "asset_id") -> DataFrame:
    """key, and whether to request a transcript, to do so without a probe, and to probe after a skip."""
    rows = audio.groupBy(key).agg(F.avg("rms_energy").alias("mean"), F.max("rms_energy").alias("most"), F.count_if(~F.col("is_silent")).alias("loud"))
    mean, most, loud = F.col("mean"), F.col("most"), F.col("loud")
    request = (most >= 0.02) | ((loud >= 3) & (mean >= 0.0075)) | ((loud >= 2) & (most >= 0.012) & (mean >= 0.0065))
    direct = (most >= 0.05) | ((loud >= 4) & (mean >= 0.02))
    return rows.select(key, loud.alias("loud_rows"), request.alias("request"), (request & direct).alias("without_probe"), (~request & ((mean >= 0.003) | (most >= 0.005))).alias("probe_after_skip"))


def probe_ranges(audio: DataFrame, assets: DataFrame, key: str = "asset_id", top: int = 2, width: float = 4.0, slack: float = 0.25) -> DataFrame:
    """key, start_sec, end_sec: windows around the loudest rows, shifted into the clip and united; under half a second dropped."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rms_energy"), "t"))
    rows = audio.where("not is_silent").withColumn("_turn", turn).where(F.col("_turn") <= top).join(assets.select(key, "duration_sec"), key)
    start = F.greatest(F.lit(0.0), F.least(F.col("t") - width / 2, F.col("duration_sec") - width))
    rows = rows.select(key, rounded(start, 3).alias("start_sec"), rounded(F.least(F.col("duration_sec"), start + width), 3).alias("end_sec"))
    return islands(rows, key, "start_sec", "end_sec", slack).where("end_sec - start_sec >= 0.5").select(key, "start_sec", "end_sec")
