"""Story sequence of the best takes, timeline labels and offsets.  G15, P15-P18, P51, W04, W05, A05, A10 of the survey."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from .scoring import visual_role


def story_role() -> Column:
    """The first known role of a segment, else by speech or picture."""
    seen = visual_role(F.col("visual_novelty"), F.col("motion_energy"), F.col("subject_clarity"))
    return F.coalesce(F.get("story_roles", 0), F.when(F.col("analysis_mode") == "speech", "spoken beat").otherwise(seen))


def suggested_duration() -> Column:
    """Longest useful length of a segment by how its boundary was found."""
    strategy = F.coalesce("boundary_strategy", F.lit(""))
    most = (
        F.when(F.col("analysis_mode") == "speech", 7.5)
        .when(F.col("boundary_strategy").isNull(), 5.0)
        .when((F.coalesce("operation", F.lit("")) == "merge") | strategy.startswith("assembly-merge:"), 7.0)
        .when(strategy.isin("scene-snap", "audio-snap", "transcript-snap") | (F.coalesce("boundary_confidence", F.lit(0.0)) >= 0.6), 6.5)
        .otherwise(5.0)
    )
    return F.least(F.col("end_sec") - F.col("start_sec"), most)


def placed(items: DataFrame, scope: str) -> DataFrame:
    """Adds sequence_group, sequence_role, label and note by order_index within the scope."""
    n = F.count(F.lit(1)).over(Window.partitionBy(scope))
    i, speech = F.col("order_index"), F.col("analysis_mode") == "speech"
    first, last = i == 0, i == n - 1
    return items.withColumns(
        {
            "sequence_group": F.when(first, "setup").when(last, "release").otherwise("development"),
            "sequence_role": F.when(first, "opener").when(last, "release").when(speech, "spoken beat").otherwise("visual bridge"),
            "label": F.when(first, "Opener").when(last, "Outro").when(speech, "Narrative beat").otherwise("Visual bridge"),
            "note": F.when(speech, "Keep the spoken line whole and readable.").otherwise("Visual pacing or atmosphere."),
        }
    )


def offsets(items: DataFrame, scope: str, order: str = "order_index") -> DataFrame:
    """Adds offset_sec: the sum of the lengths (trim_out - trim_in, 0 at least) of the items before."""
    before = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    length = F.greatest(F.lit(0.0), F.col("trim_out_sec") - F.col("trim_in_sec"))
    return items.withColumn("offset_sec", rounded(F.coalesce(F.sum(length).over(before), F.lit(0.0)), 3))


def context_windows(segments: DataFrame, key: str = "asset_id") -> DataFrame:
    """Adds context_start (the previous segment's start) and context_end (the next one's end), its own at the edges."""
    order = Window.partitionBy(key).orderBy("start_sec", "pos")
    return segments.withColumns({"context_start": F.coalesce(F.lag("start_sec").over(order), F.col("start_sec")), "context_end": F.coalesce(F.lead("end_sec").over(order), F.col("end_sec"))})


def alternations(items: DataFrame, scope: str) -> DataFrame:
    """scope, n_items, mode_changes, n_roles, n_groups."""
    order = Window.partitionBy(scope).orderBy("order_index")
    changed = F.col("analysis_mode") != F.lag("analysis_mode").over(order)
    rows = items.withColumn("_changed", F.coalesce(changed, F.lit(False)))
    return rows.groupBy(scope).agg(F.count(F.lit(1)).alias("n_items"), F.count_if("_changed").alias("mode_changes"), F.countDistinct("sequence_role").alias("n_roles"), F.countDistinct("sequence_group").alias("n_groups"))


def story_kind(items: DataFrame, scope: str) -> DataFrame:
    """scope, kind: visual-led, dialogue-led or mixed."""
    speech = F.col("analysis_mode") == "speech"
    return items.groupBy(scope).agg(F.when(F.bool_and(~speech), "visual-led").when(F.bool_and(speech), "dialogue-led").otherwise("mixed").alias("kind"))


#: A ten-thousandth, in which scores are whole numbers: they are compared after rounding to four places.
UNIT = 10_000


def _units(x: np.ndarray) -> np.ndarray:
    return np.floor(x * UNIT + 0.5).astype(np.int64)


def story_order(takes: list[dict]) -> list[tuple[int, int]]:
    """(place, score in ten-thousandths) in sequence: best opener, best follower each time, and a reserved release of three or more.

    Takes hold score_total, mode, role, prompt, novelty, hook, motion, story, turn and blank.  The first of equals wins.  A
    single take keeps its own score.
    """
    n = len(takes)
    column = lambda name: np.array([t[name] for t in takes], float)
    total, prompt, turn = column("score_total"), column("prompt"), column("turn")
    if n <= 1:
        return [(0, int(_units(total)[0]))] if n else []
    visual = np.array([t["mode"] == "visual" for t in takes])
    role = pd.factorize(np.array([t["role"] for t in takes], object))[0]
    hook = 0.03 * (column("hook") >= 0.7)
    opener = _units(total + prompt + hook + np.where(visual, 0.09 + 0.04 * (column("novelty") >= 0.7) + 0.02 * (prompt > 0), 0.03 - 0.03 * column("blank")))
    release = _units(total + np.minimum(0.05, prompt) + 0.03 * (column("story") >= 0.7) + np.where(visual, 0.08 + 0.04 * (column("motion") <= 0.55), 0.03 * (turn >= 0.85)))
    follow = _units(total + np.minimum(0.06, prompt) + np.where(~visual & (turn >= 0.85), 0.02, 0))
    left = np.ones(n, bool)
    best = lambda score, among: int(np.argmax(np.where(among, score, np.iinfo(np.int64).min)))

    at = best(opener, left)
    out = [(at, int(opener[at]))]
    left[at] = False
    last = None
    if n >= 3:
        last = best(release, left & visual if (left & visual).any() else left)
        left[last] = False
    out += _followers(at, visual.tolist(), role.tolist(), (total >= 0.75).tolist(), follow.tolist(), left)
    if last is not None:
        out.append((last, int(release[last])))
    return out


def _followers(at: int, visual: list[bool], role: list[int], strong: list[bool], follow: list[int], left: np.ndarray) -> list[tuple[int, int]]:
    """The takes that are left, each the best after the one before; n log n.

    What a take gains or loses by its predecessors depends on its class (mode, role, strong) alone, so only the head of a
    class can be next; and all roles other than the last one's count alike, so of these only the best head of a
    (mode, strong) can be.  `lines` holds each class in order, `heads` the classes of a (mode, strong) by their first take.
    """
    order = sorted(np.flatnonzero(left).tolist(), key=lambda i: (-follow[i], i))
    lines: dict[tuple[bool, bool], dict[int, list[int]]] = {}
    for i in reversed(order):
        lines.setdefault((visual[i], strong[i]), {}).setdefault(role[i], []).append(i)
    heads = {k: [(-follow[line[-1]], line[-1], r) for r, line in by_role.items()] for k, by_role in lines.items()}
    for heap in heads.values():
        heapq.heapify(heap)
    out: list[tuple[int, int]] = []
    now = before = at

    def top(heap: list, by_role: dict[int, list[int]]) -> tuple | None:
        """The first head that is still one."""
        while heap and (not by_role[heap[0][2]] or by_role[heap[0][2]][-1] != heap[0][1]):
            heapq.heappop(heap)
        return heap[0] if heap else None

    for _ in order:
        found = None
        for (mode, firm), heap in heads.items():
            gain = (-400 if mode == visual[now] else 1300 if mode else 1200) + 100 * (firm and strong[now]) - 500 * (mode == visual[now] == visual[before])
            same = lines[mode, firm].get(role[now])
            if same:
                i = same[-1]
                found = max(found or (-math.inf,), (follow[i] + gain - 300 - 400 * (role[now] == role[before]), -i, mode, firm))
            # The best head of another role is the first or the second one.
            own = heapq.heappop(heap) if top(heap, lines[mode, firm]) and heap[0][2] == role[now] else None
            other = top(heap, lines[mode, firm])
            if own is not None:
                heapq.heappush(heap, own)
            if other is not None:
                found = max(found or (-math.inf,), (gain + 400 - other[0], -other[1], mode, firm))
        score, i, mode, firm = found[0], -found[1], found[2], found[3]
        out.append((i, score))
        line = lines[mode, firm][role[i]]
        line.pop()
        if line:
            heapq.heappush(heads[mode, firm], (-follow[line[-1]], line[-1], role[i]))
        before, now = (at, i) if len(out) == 1 else (now, i)
    return out


def story_sequence(takes: DataFrame, scope: str) -> DataFrame:
    """scope, take_id, order_index, sequence_score: the greedy sequence of each scope (a project).

    Takes need pos, score_total, analysis_mode, story_role, prompt_fit, visual_novelty, hook_strength, motion_energy, story_alignment,
    turn_completeness and transcript_excerpt.  Scopes run in parallel; within one the path is greedy, n steps of log n in one
    task, as each place depends on the one before.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("pos").reset_index(drop=True)
        rows = [
            {"score_total": r.score_total, "mode": r.analysis_mode, "role": r.story_role, "prompt": r.prompt_fit, "novelty": r.visual_novelty, "hook": r.hook_strength, "motion": r.motion_energy, "story": r.story_alignment, "turn": r.turn_completeness, "blank": not (r.transcript_excerpt or "").strip()}
            for r in batch.itertuples()
        ]
        path = story_order(rows)
        return pd.DataFrame({scope: [batch[scope][0]] * len(path), "take_id": [batch["take_id"][i] for i, _ in path], "order_index": range(len(path)), "sequence_score": [s / UNIT for _, s in path]})

    kinds = dict(takes.dtypes)
    needed = takes.select(scope, "take_id", "pos", "score_total", "analysis_mode", "story_role", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("prompt_fit", "visual_novelty", "hook_strength", "motion_energy", "story_alignment", "turn_completeness")), "transcript_excerpt")
    return needed.groupBy(scope).applyInPandas(run, f"{scope} {kinds[scope]}, take_id {kinds['take_id']}, order_index int, sequence_score double")


def labelled(items: DataFrame, scope: str) -> DataFrame:
    """Adds drivers and tradeoffs: why an item stands at its place (order_index) of the sequence, and what that cost.

    Items hold analysis_mode, story_role, score_total, prompt_fit, visual_novelty, hook_strength, motion_energy, story_alignment
    and turn_completeness; missing numbers are 0.
    """
    order = Window.partitionBy(scope).orderBy("order_index")
    n = F.count(F.lit(1)).over(Window.partitionBy(scope))
    two = {f"_{c}{k}": F.lag(c, k).over(order) for c in ("analysis_mode", "story_role", "score_total") for k in (1, 2)}
    rows = items.withColumns({"_n": n} | two)
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    visual, fits = F.col("analysis_mode") == "visual", number("prompt_fit") > 0
    whole = ~visual & (number("turn_completeness") >= 0.85)
    changed = {c: F.col(c) != F.col(f"_{c}1") for c in ("analysis_mode", "story_role")}
    # Of one item before, that one counts for both.
    third = {c: (F.col(c) == F.col(f"_{c}1")) & (F.col(c) == F.coalesce(f"_{c}2", f"_{c}1")) for c in changed}
    strong = (F.col("score_total") >= 0.75) & (F.col("_score_total1") >= 0.75)
    told = lambda pairs: F.filter(F.array(*(F.when(test, F.lit(label)) for label, test in pairs)), lambda x: x.isNotNull())
    always = ("local_strength", F.lit(True))
    opener = told([always, ("opener_fit", visual), ("visual_novelty", visual & (number("visual_novelty") >= 0.7)), ("hook_strength", number("hook_strength") >= 0.7), ("prompt_fit", fits), ("prompt_led_opener", visual & fits)])
    release = told([always, ("release_fit", F.lit(True)), ("calm_release", visual & (number("motion_energy") <= 0.55)), ("complete_turn", whole), ("story_alignment", number("story_alignment") >= 0.7), ("prompt_fit", fits)])
    follow = told(
        [always, ("mode_variety", changed["analysis_mode"]), ("repetition_control", changed["analysis_mode"] | changed["story_role"]), ("spoken_progression", changed["analysis_mode"] & ~visual), ("release_transition", changed["analysis_mode"] & visual),
         ("role_variety", changed["story_role"]), ("complete_turn", whole), ("paired_strength", strong), ("prompt_fit", fits)]
    )
    cost = told([("same_mode_repeat", ~changed["analysis_mode"]), ("same_role_repeat", ~changed["story_role"]), ("third_same_mode_avoided", third["analysis_mode"]), ("third_same_role_avoided", third["story_role"])])
    none = F.array().cast("array<string>")
    i, last = F.col("order_index"), (F.col("order_index") == F.col("_n") - 1) & (F.col("_n") >= 3)
    drivers = F.when(F.col("_n") == 1, told([always])).when(i == 0, opener).when(last, release).otherwise(follow)
    tradeoffs = F.when((F.col("_n") > 1) & (i == 0), told([("preferred_for_prompt_fit", fits & (F.col("score_total") < 0.78))])).when((i == 0) | last, none).otherwise(cost)
    return rows.withColumns({"drivers": drivers, "tradeoffs": tradeoffs}).select(*items.columns, "drivers", "tradeoffs")


def label_counts(items: DataFrame, scope: str) -> DataFrame:
    """scope, n_items, transitions, and how many items have prompt_fit or repetition_control as a driver, or a tradeoff."""
    has = lambda label: F.count_if(F.array_contains("drivers", label))
    return items.groupBy(scope).agg(F.count(F.lit(1)).alias("n_items"), (F.count(F.lit(1)) - 1).alias("transitions"), has("prompt_fit").alias("prompt_fit_count"), has("repetition_control").alias("repetition_control_count"), F.count_if(F.size("tradeoffs") > 0).alias("tradeoff_count"))
