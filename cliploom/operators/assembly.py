"""Splitting and merging refined segments, and bounded boundary changes.  G11-G14 of the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, padded, rounded
from ..functions.text import is_question
from ..sources.scratch import checkpointed
from .intervals import gap_stats
from .ranges import overlapping_ranges, points_in_ranges


def split_dividers(segments: DataFrame, turns: DataFrame, spans: DataFrame, scenes: DataFrame, keys: tuple[str, str] = ("asset_id", "segment_id"), bin_width: float = 30.0) -> DataFrame:
    """keys, divider, rule: where a segment of 6.5 seconds or more is cut, if anywhere.

    First the earliest turn gap of 1.35 s that leaves two seconds on either side; else, with three or more spans, the widest
    such gap of 1.25 s; else a scene boundary at least 1.5 s inside, the first one with spans on both sides, or the one
    nearest to the centre where no span is, if it leaves two seconds on either side.
    """
    asset, seg = keys
    long_ones = segments.where("end_sec - start_sec >= 6.5").select(asset, seg, F.col("start_sec").alias("s"), F.col("end_sec").alias("e"))
    held = lambda rows: overlapping_ranges(long_ones, rows.select(asset, F.col("start_sec").alias("a"), F.col("end_sec").alias("b")), [asset], ("s", "e"), ("a", "b"), bin_width)
    own = held(spans)
    counts = own.groupBy(asset, seg).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("first_a"), F.max("b").alias("last_b"))
    apart = "mid - s >= 2 and e - mid >= 2"

    def gaps(rows: DataFrame, least: float) -> DataFrame:
        order = Window.partitionBy(asset, seg).orderBy("a", "b")
        wide = rows.withColumns({"gap": F.lead("a").over(order) - F.col("b"), "mid": rounded((F.lead("a").over(order) + F.col("b")) / 2, 3)})
        return wide.where((F.col("gap") >= least) & F.expr(apart))

    by_turn = gaps(held(turns), 1.35).select(asset, seg, "s", "e", F.lit(1).alias("rank"), F.col("mid").alias("order"), "mid", F.lit("turn-break").alias("rule"))
    by_gap = gaps(own, 1.25).join(counts.where("n >= 3").select(asset, seg), [asset, seg])
    by_gap = by_gap.select(asset, seg, "s", "e", F.lit(2).alias("rank"), (-F.col("gap")).alias("order"), "mid", F.lit("transcript-gap").alias("rule"))
    cuts = scenes.select(asset, rounded("end_sec", 3).alias("mid"), F.lead("start_sec").over(Window.partitionBy(asset).orderBy("pos")).alias("next")).where("next is not null")
    inner = long_ones.select(asset, seg, "s", "e", (F.col("s") + 1.5).alias("_a"), (F.col("e") - 1.5).alias("_b"))
    by_scene = points_in_ranges(cuts, inner, [asset], "mid", "_a", "_b", bin_width).drop("_a", "_b").join(counts, [asset, seg], "left")
    both_sides = F.col("n").isNull() | ((F.col("first_a") < F.col("mid")) & (F.col("last_b") > F.col("mid")))
    order = F.when(F.col("n").isNull(), F.abs(F.col("mid") - (F.col("s") + F.col("e")) / 2)).otherwise(F.col("mid"))
    by_scene = by_scene.where(both_sides).select(asset, seg, "s", "e", F.lit(3).alias("rank"), order.alias("order"), "mid", F.lit("scene-divider").alias("rule"))
    every = by_turn.unionByName(by_gap).unionByName(by_scene)
    turn = F.row_number().over(Window.partitionBy(asset, seg).orderBy("rank", "order", "mid"))
    best = every.withColumn("_turn", turn).where("_turn = 1")
    return best.where(apart).select(asset, seg, F.col("mid").alias("divider"), "rule")


def split(segments: DataFrame, dividers: DataFrame, keys: tuple[str, str] = ("asset_id", "segment_id")) -> DataFrame:
    """The segments with cut ones in two parts: adds part (0 whole, 1, 2) and rule; confidence of parts max(c, .45) * .92."""
    rows = segments.join(dividers, list(keys), "left")
    part = lambda no, a, b: F.struct(F.lit(no).alias("part"), a.alias("a"), b.alias("b"))
    s, e, d = F.col("start_sec"), F.col("end_sec"), F.col("divider")
    rows = rows.withColumn("_p", F.explode(F.when(d.isNotNull(), F.array(part(1, s, d), part(2, d, e))).otherwise(F.array(part(0, s, e)))))
    lowered = rounded(F.greatest(F.coalesce("boundary_confidence", F.lit(0.0)), F.lit(0.45)) * 0.92, 4)
    return rows.withColumns({"part": F.col("_p.part"), "start_sec": F.col("_p.a"), "end_sec": F.col("_p.b"), "boundary_confidence": F.when(d.isNotNull(), lowered).otherwise(F.col("boundary_confidence"))}).drop("_p", "divider")


#: Fixed limits in seconds.
JOIN_GAP, QUESTION_GAP, MONOLOGUE_GAP, TURN_BREAK, TURN_GAP, SPAN_GAP, STRUCTURAL_GAP, STRUCTURAL_LENGTH = 1.25, 1.6, 0.95, 1.35, 0.55, 0.9, 0.4, 7.5


def _neighbours(segments: DataFrame, key: str) -> DataFrame:
    """The segments in order, each with the one before it as `left`, and the range of both."""
    order = Window.partitionBy(key).orderBy("start_sec", "end_sec", "segment_id")
    own = F.struct("start_sec", "end_sec", "analysis_mode", "source", "seed_sources", F.col("_question").alias("question"))
    rows = segments.withColumn("_question", F.coalesce((F.trim("transcript_excerpt") != "") & is_question("transcript_excerpt"), F.lit(False)))
    rows = rows.withColumns({"pos": F.row_number().over(order), "left": F.lag(own).over(order)})
    return rows.withColumns({"_from": F.col("left.start_sec"), "_to": F.greatest("end_sec", "left.end_sec")})


def continuity(segments: DataFrame, spans: DataFrame, turns: DataFrame, scenes: DataFrame, key: str = "asset_id", bin_width: float = 30.0) -> DataFrame:
    """The segments with pos, left (the segment before) and what is known of the pause between: gap, n_spans, span_gap,
    turn_gap, on_turn (a turn that both hold, or consecutive ones), turn_break and divider (a scene boundary between).

    Segments hold segment_id, range, analysis_mode, transcript_excerpt, seed_sources and source (the segment that a part was
    split from, or null); turns hold turn, scenes pos.
    """
    # Read by each of the joins below, and dear where the caller's segments are.
    rows = checkpointed(_neighbours(segments, key))
    pairs = rows.where("left is not null").select(key, "pos", "_from", "_to", F.col("left.start_sec").alias("ls"), F.col("left.end_sec").alias("le"), F.col("start_sec").alias("rs"), F.col("end_sec").alias("re"))
    ranges = F.array_sort(F.collect_list(F.struct(F.col("a").alias("start"), F.col("b").alias("end"))))

    def held(found: DataFrame) -> DataFrame:
        own = found.select(key, F.col("start_sec").alias("a"), F.col("end_sec").alias("b"), *(c for c in ("turn",) if c in found.columns))
        return overlapping_ranges(pairs, own, [key], ("_from", "_to"), ("a", "b"), bin_width)

    said = held(spans).where("a <= re").groupBy(key, "pos").agg(ranges.alias("r")).select(key, "pos", F.size("r").cast("long").alias("n_spans"), gap_stats(F.col("r"))["largest"].alias("span_gap"))
    in_left, in_right = (F.col("a") <= F.col("le")) & (F.col("b") >= F.col("ls")), (F.col("a") <= F.col("re")) & (F.col("b") >= F.col("rs"))
    on = held(turns).groupBy(key, "pos").agg(
        F.array_sort(F.collect_list(F.when(F.col("a") <= F.col("re"), F.struct(F.col("a").alias("start"), F.col("b").alias("end"))))).alias("r"),
        F.coalesce(F.bool_or(in_left & in_right), F.lit(False)).alias("shared"),
        F.max(F.when(in_left, F.struct("turn", "b"))).alias("last"),
        F.min(F.when(in_right, F.struct("turn", "a"))).alias("first"),
    )
    next_turn = F.coalesce(F.col("first.turn") - F.col("last.turn") == 1, F.lit(False))
    on = on.select(key, "pos", gap_stats(F.col("r"))["largest"].alias("turn_gap"), (F.col("shared") | next_turn).alias("on_turn"), (next_turn & (F.col("first.a") - F.col("last.b") >= TURN_BREAK)).alias("turn_break"))
    order = Window.partitionBy(key).orderBy("pos")
    cuts = scenes.withColumn("_next", F.lead("pos").over(order)).where("_next is not null").select(key, rounded(F.col("end_sec"), 3).alias("cut"))
    pauses = pairs.where("le <= rs").select(key, "pos", "le", "rs")
    cut = points_in_ranges(cuts, pauses, [key], "cut", "le", "rs", bin_width).select(key, "pos").distinct().withColumn("divider", F.lit(True))
    rows = rows.join(said, [key, "pos"], "left").join(on, [key, "pos"], "left").join(cut, [key, "pos"], "left").drop("_from", "_to")
    zero, no = F.lit(0.0), F.lit(False)
    return rows.withColumns(
        {"gap": rounded(F.greatest(zero, F.col("start_sec") - F.col("left.end_sec")), 3), "n_spans": F.coalesce("n_spans", F.lit(0)), "span_gap": F.coalesce("span_gap", zero), "turn_gap": F.coalesce("turn_gap", zero)}
        | {c: F.coalesce(c, no) for c in ("on_turn", "turn_break", "divider")}
    )


def merge_rule() -> Column:
    """The first rule by which a row of `continuity` joins the one before it, or null."""
    left, gap, open_ = F.col("left"), F.col("gap"), ~F.col("divider")
    speech = (left["analysis_mode"] == "speech") & (F.col("analysis_mode") == "speech")
    either = (left["analysis_mode"] == "speech") | (F.col("analysis_mode") == "speech")
    related = (left["analysis_mode"] == F.col("analysis_mode")) | either | F.coalesce(F.arrays_overlap(left["seed_sources"], F.col("seed_sources")), F.lit(False))
    length = F.greatest(F.col("end_sec"), left["end_sec"]) - F.least(F.col("start_sec"), left["start_sec"])
    never = left.isNull() | (gap > JOIN_GAP) | F.coalesce(left["source"] == F.col("source"), F.lit(False))
    return (
        F.when(never, F.lit(None).cast("string"))
        .when(speech & left["question"] & ~F.col("_question") & (gap <= QUESTION_GAP) & open_ & ~F.col("turn_break"), "question-answer-flow")
        .when(speech & ~left["question"] & ~F.col("_question") & (gap <= MONOLOGUE_GAP) & open_, "monologue-continuity")
        .when(F.col("on_turn") & ~F.col("turn_break") & (F.col("turn_gap") <= TURN_GAP) & open_, "turn-continuity")
        .when((F.col("n_spans") >= 2) & (F.col("span_gap") <= SPAN_GAP) & open_, "transcript-continuity")
        .when((gap <= STRUCTURAL_GAP) & (length <= STRUCTURAL_LENGTH) & open_ & related, "structural-continuity")
    )


def merged_chains(segments: DataFrame, rule: Column, key: str = "asset_id") -> DataFrame:
    """key, chain, start_sec, end_sec, n, rule_family, boundary_confidence, segment_ids and, where there are any, seed_sources.

    Each row is compared with the one before it only, so chains are runs of rows whose `rule` (an expression over the row
    and its lag) is not null.  The end is the last row's end; a chain by more than one rule is a continuity-chain.
    """
    order = Window.partitionBy(key).orderBy("start_sec", "pos")
    seeds = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "pos", "seed_sources"))), lambda x: x["seed_sources"]))).alias("seed_sources")] if "seed_sources" in segments.columns else []
    rows = segments.withColumn("_rule", rule)
    rows = rows.withColumn("chain", F.sum(F.when(F.col("_rule").isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    rules = F.array_sort(F.collect_set("_rule"))
    out = rows.groupBy(key, "chain").agg(
        F.min("start_sec").alias("start_sec"),
        F.max_by("end_sec", F.struct("start_sec", "pos")).alias("end_sec"),
        F.count(F.lit(1)).alias("n"),
        F.when(F.size(rules) == 0, F.lit("")).when(F.size(rules) == 1, F.get(rules, 0)).otherwise(F.lit("continuity-chain")).alias("rule_family"),
        rounded(clamp(F.avg(F.round("boundary_confidence", 9))), 4).alias("boundary_confidence"),
        F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "pos", "segment_id"))), lambda x: x["segment_id"]).alias("segment_ids"),
        *seeds,
    )
    return out


def assembled(segments: DataFrame, spans: DataFrame, turns: DataFrame, scenes: DataFrame, describe: Callable[[DataFrame], DataFrame], key: str = "asset_id") -> DataFrame:
    """Segments split at their dividers, joined by the merge rules, described anew and numbered anew.

    Takes and gives key, segment_id, start_sec, end_sec, seed_sources, boundary_strategy and boundary_confidence, and what
    `describe` adds: it computes transcript_excerpt, analysis_mode and whatever else depends on the range.  Adds
    operation ('' as it was, split or merge), rule_family and source_ids.
    """
    own = [key, "segment_id", "start_sec", "end_sec", "seed_sources", "boundary_strategy", "boundary_confidence"]
    parts = split(segments.select(*own), split_dividers(segments, turns, spans, scenes, (key, "segment_id")), (key, "segment_id"))
    cut = F.col("part") > 0
    parts = parts.select(
        key,
        F.when(cut, F.concat_ws("-split-", F.col("segment_id").cast("string"), F.col("part").cast("string"))).otherwise(F.col("segment_id").cast("string")).alias("segment_id"),
        "start_sec", "end_sec", "seed_sources",
        F.when(cut, F.concat(F.lit("assembly-split:"), F.col("rule"))).otherwise(F.col("boundary_strategy")).alias("boundary_strategy"),
        "boundary_confidence",
        F.when(cut, F.col("segment_id").cast("string")).alias("source"),
        F.when(cut, F.col("rule")).otherwise(F.lit("")).alias("rule"),
    )
    parts = checkpointed(parts)
    near = continuity(describe(parts), spans, turns, scenes, key)
    chains = merged_chains(near, merge_rule(), key)
    # A chain of one row is that row.
    first = F.element_at("segment_ids", 1)
    alone = parts.select(F.col(key).alias("_k"), F.col("segment_id").alias("_id"), "boundary_strategy", "source", F.col("rule").alias("_rule"), F.col("boundary_confidence").alias("_conf"))
    rows = chains.join(alone, (F.col(key) == F.col("_k")) & (first == F.col("_id")))
    one = F.col("n") == 1
    rows = rows.select(
        key,
        first.alias("segment_id"),
        "start_sec", "end_sec", "seed_sources",
        F.when(one, F.col("boundary_strategy")).otherwise(F.concat(F.lit("assembly-merge:"), F.col("rule_family"))).alias("boundary_strategy"),
        F.when(one, F.col("_conf")).otherwise(F.col("boundary_confidence")).alias("boundary_confidence"),
        F.when(~one, "merge").when(F.col("source").isNotNull(), "split").otherwise("").alias("operation"),
        F.when(one, F.col("_rule")).otherwise(F.col("rule_family")).alias("rule_family"),
        F.when(one & F.col("source").isNotNull(), F.array("source")).otherwise(F.col("segment_ids")).alias("source_ids"),
    )
    return renumbered(describe(rows), key)


def renumbered(segments: DataFrame, key: str = "asset_id") -> DataFrame:
    """segment_id by start within the asset: <asset>-segment-NN."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("start_sec", "end_sec", "segment_id"))
    return segments.withColumn("segment_id", F.concat(F.col(key).cast("string"), F.lit("-segment-"), padded(n, 2)))


def validated(segments: DataFrame, results: DataFrame, key: str = "asset_id", most: float = 1.5, shortest: float = 1.5) -> DataFrame:
    """Segments after validation results (segment_id, decision, new_start, new_end, split_at, supported).

    trim and extend move each end by at most `most` seconds within the clip and keep `shortest` seconds; split cuts once
    where it is supported and both parts last that long; all else keeps the range.  Ids are numbered anew.
    """
    rows = segments.join(results, "segment_id", "left")
    s, e = F.col("start_sec"), F.col("end_sec")
    move = lambda new, old: F.greatest(F.lit(0.0), F.least(F.col("duration_sec"), F.greatest(old - most, F.least(old + most, F.coalesce(new, old)))))
    a, b = rounded(move(F.col("new_start"), s), 3), rounded(move(F.col("new_end"), e), 3)
    moved = F.col("decision").isin("trim", "extend") & (b - a >= shortest)
    cut = (F.col("decision") == "split") & F.coalesce("supported", F.lit(False)) & (F.col("split_at") - s >= shortest) & (e - F.col("split_at") >= shortest)
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    ranges = F.when(moved, F.array(pair(a, b))).when(cut, F.array(pair(s, F.col("split_at")), pair(F.col("split_at"), e))).otherwise(F.array(pair(s, e)))
    rows = rows.withColumn("_r", F.explode(ranges)).withColumns({"start_sec": F.col("_r.a"), "end_sec": F.col("_r.b"), "applied": F.coalesce(moved | cut, F.lit(False))})
    return renumbered(rows.select(*segments.columns, "applied"), key)
