"""Range joins, nearest matches, islands, sessions and suppression on time ranges.  J03-J09, W02, W03, G01-G08, S17.

Range joins (`ranges`) are equi-joins on (key, bin) followed by the exact predicate, so they neither nest loops nor broadcast;
series that fit a key without bins pass bin_width=None.  Suppression of overlapping ranges is `greedy.kept_apart`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..sources.scratch import written
from .greedy import kept_apart
from .ranges import overlapping_ranges, points_in_ranges


def inside_or_nearest(points: DataFrame, ranges: DataFrame, key: str, range_id: str, t: str, start: str, end: str, bin_width: float | None = None) -> DataFrame:
    """Each range with its points; a range without any takes the point nearest to its centre (the earlier on ties).

    Adds `matched`: inside or nearest.  The nearest point is the last one up to the centre or the first one after it: both are
    found in one order of points and centres, so an empty range never meets all points of its key.
    """
    inside = points_in_ranges(points, ranges, [key], t, start, end, bin_width).withColumn("matched", F.lit("inside"))
    empty = ranges.join(inside.select(key, range_id).distinct(), [key, range_id], "left_anti")
    value = F.struct(*(F.col(c) for c in [t, *(c for c in points.columns if c not in (key, t))]))
    own = F.struct(*(F.col(c) for c in empty.columns if c != key))
    centres = empty.select(key, ((F.col(start) + F.col(end)) / 2).alias("_t"), own.alias("_range"))
    both = points.select(key, F.col(t).cast("double").alias("_t"), value.alias("_p")).unionByName(centres, allowMissingColumns=True)
    # Points at the centre come before it; of points at one time the least counts, on either side.
    up_to = Window.partitionBy(key).orderBy("_t", F.col("_range").isNotNull(), F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(F.desc("_t"), F.col("_range").isNull(), F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_before", F.last("_p", ignorenulls=True).over(up_to)).withColumn("_after", F.last("_p", ignorenulls=True).over(after))
    away = lambda side: F.struct(F.abs(F.col(f"{side}.{t}") - F.col("_t")).alias("_d"), F.col(side).alias("_p"))
    best = F.array_min(F.filter(F.array(away("_before"), away("_after")), lambda x: x["_p"].isNotNull()))["_p"]
    found = both.where("_range is not null").withColumn("_p", best).where("_p is not null")
    nearest = found.select(key, *(F.col(f"_range.{c}").alias(c) for c in empty.columns if c != key), *(F.col(f"_p.{c}").alias(c) for c in points.columns if c != key), F.lit("nearest").alias("matched"))
    return inside.unionByName(nearest.select(*inside.columns))


def sessions(rows: DataFrame, key: str, start: str, end: str, gap: float) -> DataFrame:
    """Adds session, numbered from 1 per key: a new one begins where a row starts more than `gap` after the previous row's end.

    It is the previous row's end that counts, not the furthest end so far.
    """
    order = Window.partitionBy(key).orderBy(start, end)
    opens = F.when(F.col(start) - F.lag(end).over(order) <= gap, 0).otherwise(1)
    return rows.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_opens")


def islands(rows: DataFrame, key: str, start: str, end: str, slack: float) -> DataFrame:
    """key, start, end, n: ranges united where they lie within `slack` of the furthest end so far."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_opens", F.when(F.col(start) <= reach + slack, 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def deduped_ranges(rows: DataFrame, key: str, start: str, end: str, duration: str, least: float = 1.0, most: float = 0.9) -> DataFrame:
    """key, start, end: the shortest ranges win (then the earliest); clamped to the clip, under `least` seconds dropped."""
    a, b = F.greatest(F.lit(0.0), F.col(start)), F.least(F.col(end), F.col(duration))
    cut = rows.select(key, rounded(a, 3).alias(start), rounded(b, 3).alias(end)).where(F.col(end) - F.col(start) >= least).distinct()
    cut = cut.withColumn("_length", rounded(F.col(end) - F.col(start), 3))
    return kept_apart(cut, key, ["_length", start, end], start, end, most).drop("_length")


def peak_windows(signals: DataFrame, key: str, t: str, rank: Sequence[str], duration: str, limit: int, most: float = 0.7) -> DataFrame:
    """key, pos, start_sec, end_sec: windows of clamp(duration / 8, 2.5, 5.5) around the strongest points that keep apart, in rank order."""
    width = F.greatest(F.lit(2.5), F.least(F.lit(5.5), F.col(duration) / 8))
    a = F.greatest(F.lit(0.0), F.col(t) - width / 2)
    b = F.least(F.col(duration), a + width)
    order = [f"_r{i}" for i in range(len(rank))] + ["_t"]
    cut = signals.select(key, *((-F.col(c)).alias(n) for c, n in zip(rank, order, strict=False)), F.col(t).alias("_t"), rounded(a, 3).alias("start_sec"), rounded(b, 3).alias("end_sec")).where(F.col("end_sec") - F.col("start_sec") >= 1.5)
    # Of equal points the order is the windows'; equal rows are one.
    kept = kept_apart(cut.distinct(), key, [*order, "start_sec", "end_sec"], "start_sec", "end_sec", most, limit)
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order, "start_sec", "end_sec")) - 1
    return kept.select(key, place.alias("pos"), "start_sec", "end_sec")


def fallback_scenes(assets: DataFrame, key: str, duration: str) -> DataFrame:
    """key, pos, start_sec, end_sec for clips without detected scenes.

    Up to 8 seconds the clip is one scene; beyond, windows of 5.5 s every clamp(d / 3, 2.75, 6) s, at most four, none under
    2.5 s, the last one being the first that reaches the end.
    """
    usable = F.greatest(F.col(duration), F.lit(6.0))
    stride = F.greatest(F.lit(2.75), F.least(F.lit(6.0), usable / 3))
    window = lambda i: F.struct(rounded(i * stride, 3).alias("start"), rounded(F.least(usable, i * stride + 5.5), 3).alias("end"))
    all_of = F.transform(F.sequence(F.lit(0), F.lit(3)), window)
    # A window counts only if the one before it has not reached the end.
    some = F.filter(all_of, lambda w, i: (w["end"] - w["start"] >= 2.5) & ((i == 0) | ((i - 1) * stride + 5.5 < usable)))
    one = F.array(F.struct(F.lit(0.0).alias("start"), rounded(usable, 3).alias("end")))
    rows = assets.select(key, F.posexplode(F.when(usable <= 8, one).otherwise(some)).alias("pos", "r"))
    return rows.select(key, "pos", F.col("r.start").alias("start_sec"), F.col("r.end").alias("end_sec"))


def seed_regions(scenes: DataFrame, visual_peaks: DataFrame, audio_peaks: DataFrame, assets: DataFrame, key: str = "asset_id", framed: DataFrame | None = None) -> DataFrame:
    """Seeds of all sources with their confidence, the shortest of much-overlapping ones kept; whole clip where there is none.

    Scenes (key, pos, start_sec, end_sec) are normalised first: clamped to the clip, those under a second left out, of much
    overlapping ones the shortest kept.  Peaks only lose what is empty.  Of equal ranges the first stays, in the order scene,
    visual peak, audio peak and by place within each.  `framed` has the clips with frame signals (all, if not given): a clip
    without any has its scenes only, neither peaks nor a fallback.
    """
    framed = (assets if framed is None else framed).select(key).distinct()
    clips = assets.select(key, "duration_sec")
    own = deduped_ranges(scenes.join(clips, key), key, "start_sec", "end_sec", "duration_sec")
    by_start = F.row_number().over(Window.partitionBy(key).orderBy("start_sec", "end_sec"))
    source = lambda df, n, name, conf: df.select(key, F.lit(n).alias("_source"), F.col("_place"), "start_sec", "end_sec", F.lit(name).alias("source"), F.lit(conf).alias("confidence"))
    peaks = lambda df: df.join(framed, key, "left_semi").withColumn("_place", F.col("pos") if "pos" in df.columns else by_start)
    every = source(own.withColumn("_place", by_start), 0, "scene", 0.55).unionByName(source(peaks(visual_peaks), 1, "visual-peak", 0.72)).unionByName(source(peaks(audio_peaks), 2, "audio-peak", 0.68))
    # Three folds, read for their ranges and for the clips without any.
    every = written(every)
    rest = clips.join(framed, key, "left_semi").join(every.select(key).distinct(), key, "left_anti")
    whole = rest.select(key, F.lit(3).alias("_source"), F.lit(1).alias("_place"), F.lit(0.0).alias("start_sec"), rounded(F.greatest("duration_sec", F.lit(1.0)), 3).alias("end_sec"), F.lit("fallback").alias("source"), F.lit(0.30).alias("confidence"))
    cut = every.unionByName(whole).where("end_sec > start_sec").join(clips, key)
    cut = cut.withColumns({"start_sec": F.greatest(F.lit(0.0), F.col("start_sec")), "end_sec": F.least("end_sec", "duration_sec")})
    cut = cut.withColumn("_length", F.col("end_sec") - F.col("start_sec")).drop("duration_sec")
    kept = kept_apart(cut, key, ["_length", "start_sec", "_source", "_place"], "start_sec", "end_sec", 0.9)
    return kept.select(key, rounded("start_sec", 3).alias("start_sec"), rounded("end_sec", 3).alias("end_sec"), "source", "confidence")


def refined_by_duration(start: Column, end: Column, duration: Column) -> Column:
    """A seed's centre with clamp(length, 1.5, 6) seconds around it, within the clip."""
    half = F.greatest(F.lit(1.5), F.least(F.lit(6.0), end - start)) / 2
    centre = (start + end) / 2
    return F.struct(rounded(F.greatest(F.lit(0.0), centre - half), 3).alias("start"), rounded(F.least(duration, centre + half), 3).alias("end"), F.lit("duration-rule").alias("strategy"), F.lit(0.48).alias("confidence"))


def refined_by_scene(seeds: DataFrame, scenes: DataFrame, key: str = "asset_id", seed_id: str = "seed_id", bin_width: float = 30.0) -> DataFrame:
    """key, seed_id, refined: the first scene that holds the seed's centre, else the one that overlaps it most.

    Scenes over 8 seconds give way to the duration rule.  A seed meets only scenes of its own bins.
    """
    own = scenes.select(key, F.col("pos").alias("_pos"), F.col("start_sec").alias("_a"), F.col("end_sec").alias("_b"))
    both = overlapping_ranges(seeds.select(key, seed_id, "start_sec", "end_sec", "duration_sec"), own, [key], ("start_sec", "end_sec"), ("_a", "_b"), bin_width)
    centre = (F.col("start_sec") + F.col("end_sec")) / 2
    holds = ((F.col("_a") <= centre) & (centre <= F.col("_b"))).cast("int")
    overlap = F.greatest(F.lit(0.0), F.least("end_sec", "_b") - F.greatest("start_sec", "_a"))
    order = Window.partitionBy(key, seed_id).orderBy(F.desc("_holds"), F.when(F.col("_holds") == 1, 0.0).otherwise(-F.col("_overlap")), "_pos")
    best = both.withColumn("_holds", holds).withColumn("_overlap", overlap).withColumn("_turn", F.row_number().over(order)).where("_turn = 1 and (_holds = 1 or _overlap > 0)")
    snapped = F.struct(F.col("_a").alias("start"), F.col("_b").alias("end"), F.lit("scene-snap").alias("strategy"), F.lit(0.62).alias("confidence"))
    by_rule = refined_by_duration(F.col("start_sec"), F.col("end_sec"), F.col("duration_sec"))
    return best.select(key, seed_id, F.when(F.col("_b") - F.col("_a") > 8, by_rule.withField("strategy", F.lit("scene-duration"))).otherwise(snapped).alias("refined"))


def refined_by_audio(seeds: DataFrame, audio: DataFrame, key: str = "asset_id", seed_id: str = "seed_id", least: float = 0.05, bin_width: float = 30.0) -> DataFrame:
    """key, seed_id, refined: the run of energetic audio rows nearest to the seed's centre, padded by half the mean step.

    Runs under a second or centred more than two seconds away do not count; so a seed only meets runs that come within two
    seconds and a step of its centre.
    """
    order = Window.partitionBy(key).orderBy("t")
    loud = (~F.col("is_silent")) & (F.col("rms_energy") >= least)
    rows = audio.withColumn("_loud", loud)
    rows = rows.withColumn("_run", F.row_number().over(order) - F.row_number().over(Window.partitionBy(key, "_loud").orderBy("t")))
    steps = audio.withColumn("_gap", F.col("t") - F.lag("t").over(order)).groupBy(key).agg(F.coalesce(F.avg("_gap"), F.lit(1.0)).alias("_step"))
    runs = rows.where("_loud").groupBy(key, "_run").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    centre = (F.col("start_sec") + F.col("end_sec")) / 2
    reach = seeds.select(key, seed_id, "start_sec", "end_sec", "duration_sec").join(steps, key).withColumns({"_lo": centre - 2 - F.col("_step"), "_hi": centre + 2 + F.col("_step")})
    both = overlapping_ranges(reach, runs.select(key, F.col("_a"), F.col("_b")), [key], ("_lo", "_hi"), ("_a", "_b"), bin_width)
    away = F.greatest(F.col("_a") - centre, centre - F.col("_b"), F.lit(0.0))
    turn = Window.partitionBy(key, seed_id).orderBy("_away", "_a")
    best = both.withColumn("_away", away).withColumn("_turn", F.row_number().over(turn)).where("_turn = 1")
    a, b = F.greatest(F.lit(0.0), F.col("_a") - F.col("_step") / 2), F.least(F.col("duration_sec"), F.col("_b") + F.col("_step") / 2)
    good = (b - a >= 1.0) & (F.abs((a + b) / 2 - centre) <= 2.0)
    return best.where(good).select(key, seed_id, F.struct(rounded(a, 3).alias("start"), rounded(b, 3).alias("end"), F.lit("audio-snap").alias("strategy"), F.lit(0.74).alias("confidence")).alias("refined"))


def refined(seeds: DataFrame, by_transcript: DataFrame, by_audio: DataFrame, by_scene: DataFrame, key: str = "asset_id", seed_id: str = "seed_id", most: float = 0.9) -> DataFrame:
    """Each seed's first refinement of transcript, audio, scene and duration; overlapping ones fall to the surer, then the longer."""
    rows = seeds
    for i, found in enumerate((by_transcript, by_audio, by_scene)):
        rows = rows.join(found.withColumnRenamed("refined", f"_r{i}"), [key, seed_id], "left")
    best = F.coalesce("_r0", "_r1", "_r2", refined_by_duration(F.col("start_sec"), F.col("end_sec"), F.col("duration_sec")))
    rows = rows.select(key, seed_id, best.alias("r")).select(key, seed_id, "r.*")
    ordered = rows.withColumns({"_confidence": -F.col("confidence"), "_length": -(F.col("end") - F.col("start"))})
    kept = kept_apart(ordered, key, ["_confidence", "_length", seed_id], "start", "end", most)
    return kept.select(key, seed_id, F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), F.col("strategy").alias("boundary_strategy"), F.col("confidence").alias("boundary_confidence"))


def refined_by_transcript(seeds: DataFrame, spans: DataFrame, turns: DataFrame, key: str = "asset_id", seed_id: str = "seed_id", margin: float = 0.75, bin_width: float = 30.0) -> DataFrame:
    """key, seed_id, refined: a seed snapped to the turns (else spans) that it overlaps within the margin.

    After a closing question the next turn joins if it starts within 1.6 s; where one turn matched that asks nothing, the
    next one joins within .95 s if it asks nothing either.  Results under a second do not count.
    """
    from ..functions.text import is_question

    order = Window.partitionBy(key).orderBy("start_sec", "end_sec")
    ahead = turns.select(key, F.col("start_sec").alias("a"), F.col("end_sec").alias("b"), is_question("text").alias("q"), F.lead("start_sec").over(order).alias("next_a"), F.lead("end_sec").over(order).alias("next_b"), F.coalesce(is_question(F.lead("text").over(order)), F.lit(False)).alias("next_q"))
    by_turn = overlapping_ranges(seeds, ahead, [key], ("start_sec", "end_sec"), ("a", "b"), bin_width, margin)
    last = F.max(F.struct("a", "b", "q", "next_a", "next_b", "next_q"))
    found = by_turn.groupBy(key, seed_id).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n"), last.alias("l"))
    pause = F.col("l.next_a") - F.col("l.b")
    joins = (F.col("l.q") & ~F.col("l.next_q") & (pause <= 1.6)) | ((F.col("n") == 1) & ~F.col("l.q") & ~F.col("l.next_q") & (pause <= 0.95))
    end = F.when(F.coalesce(joins, F.lit(False)), F.greatest("b", "l.next_b")).otherwise(F.col("b"))
    snap = lambda a, b, name, conf: F.struct(a.alias("start"), b.alias("end"), F.lit(name).alias("strategy"), F.lit(conf).alias("confidence"))
    first = found.select(key, seed_id, snap(F.col("a"), end, "turn-snap", 0.93).alias("refined"))
    by_span = overlapping_ranges(seeds, spans.select(key, F.col("start_sec").alias("a"), F.col("end_sec").alias("b")), [key], ("start_sec", "end_sec"), ("a", "b"), bin_width, margin)
    second = by_span.groupBy(key, seed_id).agg(snap(F.min("a"), F.max("b"), "transcript-snap", 0.90).alias("refined"))
    both = first.unionByName(second.join(first.select(key, seed_id), [key, seed_id], "left_anti"))
    return both.where(F.col("refined.end") - F.col("refined.start") >= 1)


def scene_boundaries(ranges: Column) -> Column:
    """Ends of all ranges but the last."""
    return F.transform(F.slice(ranges, F.lit(1), F.greatest(F.size(ranges) - 1, F.lit(0))), lambda x: x["end"])


def gap_stats(ranges: Column) -> Column:
    """(largest, mean) pause between consecutive ranges of an ordered array; pauses under 0 count as 0, no pause gives (0, 1)."""
    gaps = F.filter(F.zip_with(F.slice(ranges, F.lit(1), F.greatest(F.size(ranges) - 1, F.lit(0))), F.slice(ranges, F.lit(2), F.greatest(F.size(ranges) - 1, F.lit(0))), lambda a, b: F.greatest(F.lit(0.0), b["start"] - a["end"])), lambda x: x.isNotNull())
    total = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    return F.struct(rounded(F.coalesce(F.array_max(gaps), F.lit(0.0)), 3).alias("largest"), F.when(F.size(gaps) > 0, rounded(total / F.size(gaps), 3)).otherwise(F.lit(1.0)).alias("mean"))
