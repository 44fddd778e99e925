"""DuckDB SQL with the same rows and column names as the registered queries."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def d(x: float) -> str:
    """A double literal."""
    return f"{x!r}e0"


def r(x: str, places: int = 4) -> str:
    return f"(floor(({x}) * 1e{places} + 0.5e0) / 1e{places})"


def padded(x: str, width: int) -> str:
    return f"lpad(({x})::VARCHAR, greatest({width}, length(({x})::VARCHAR))::INT, '0')"


def clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, coalesce(({x})::DOUBLE, 0e0)))"


# The adapters.
ASSETS = "assets AS (SELECT c_custkey AS asset_id, c_name AS asset_name, 6e0 + c_custkey % 40 AS duration_sec, c_custkey % 3 = 0 AS has_speech FROM customer)"
_LINES = """lines AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty, sum(floor(l_discount * 100 + 0.5e0)::BIGINT)::BIGINT AS disc, sum(floor(l_tax * 100 + 0.5e0)::BIGINT)::BIGINT AS tax,
  count(DISTINCT l_suppkey) AS supp, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY l_orderkey)"""
_FIT = clamp(f"1e0 - abs(greatest({d(0.1)}, end_sec - start_sec) - 5.5e0) / 7e0")
_PF = clamp(" + ".join(f"{d(w)} * {c}" for w, c in ((0.26, "sharpness"), (0.16, "stability"), (0.22, "motion_energy"), (0.2, "visual_novelty"), (0.16, "subject_clarity"))))
_z = lambda c: f"coalesce({c}, 0e0)"
SEGMENTS = f"""{ASSETS}, {_LINES},
seg0 AS (SELECT a.asset_id, a.asset_name, a.duration_sec, a.has_speech, o_orderkey AS segment_id, row_number() OVER (PARTITION BY a.asset_id ORDER BY o_orderkey) AS pos, n, qty, disc, tax, supp, r, o, o_totalprice, o_orderpriority
  FROM orders JOIN assets a ON o_custkey = a.asset_id LEFT JOIN lines ON o_orderkey = l_orderkey),
seg1 AS (SELECT *, 2e0 * (pos - 1) AS start_sec, 2e0 * (pos - 1) + 1.5e0 * coalesce(n, 0) AS end_sec, {r("qty / (50 * n)")} AS sharpness, {r("1e0 - 5e0 * disc / (100 * n)")} AS stability,
  {r("supp::DOUBLE / n")} AS visual_novelty, {r("12.5e0 * tax / (100 * n)")} AS subject_clarity, {r("r::DOUBLE / n")} AS motion_energy, {r("o::DOUBLE / n")} AS speech_ratio, {r("least(1e0, o_totalprice / 500000)")} AS audio_energy FROM seg0),
seg2 AS (SELECT *, CASE WHEN n IS NOT NULL THEN {r(_PF)} END AS prefilter_score FROM seg1),
seg AS (SELECT asset_id, asset_name, duration_sec, has_speech, segment_id, pos, start_sec, end_sec, sharpness, stability, visual_novelty, subject_clarity, motion_energy, speech_ratio, audio_energy, prefilter_score,
  {r(_FIT)} AS duration_fit,
  {r(clamp(f"0.5e0 * {_z('prefilter_score')} + 0.25e0 * {_z('subject_clarity')} + 0.25e0 * {_z('motion_energy')}"))} AS hook_strength,
  {r(clamp(f"{d(0.45)} * {_z('prefilter_score')} + 0.25e0 * {_z('visual_novelty')} + {d(0.2)} * {_z('subject_clarity')} + {d(0.1)} * {_FIT}"))} AS story_alignment,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent order' ELSE '' END AS transcript_excerpt FROM seg2)"""

# Scores: (driver, value, weight when speech, weight when visual); these frames carry no optional metrics.
_TURN = "CASE WHEN transcript_excerpt <> '' THEN 0.75e0 ELSE 0e0 END"
_PARTS = {
    "technical": [("sharpness", "sharpness", 0.22, 0.22), ("stability", "stability", 0.18, 0.18), ("duration_fit", "duration_fit", 0.2, 0.2), ("subject_clarity", "subject_clarity", 0.18, 0.18), ("audio_energy", "CASE WHEN speech THEN audio_energy ELSE 0e0 END", 0.22, 0.22), ("motion_energy", "CASE WHEN speech THEN 0e0 ELSE motion_energy END", 0.22, 0.22)],
    "semantic": [("visual_novelty", "visual_novelty", 0, 0.34), ("hook_strength", "hook_strength", 0.22, 0.24), ("story_alignment", "story_alignment", 0.2, 0), ("speech_ratio", "speech_ratio", 0.16, 0), ("subject_clarity", "subject_clarity", 0.12, 0.18), ("motion_energy", "motion_energy", 0, 0.24), ("turn_completeness", _TURN, 0.14, 0)],
    "story": [("story_alignment", "story_alignment", 0.36, 0.38), ("visual_novelty", "visual_novelty", 0, 0.28), ("hook_strength", "hook_strength", 0.22, 0), ("duration_fit", "duration_fit", 0.2, 0.2), ("turn_completeness", _TURN, 0.22, 0), ("motion_energy", "motion_energy", 0, 0.14)],
}
_BLEND = {"technical": 0.35, "semantic": 0.4, "story": 0.25}
_w = lambda a, b: f"(CASE WHEN speech THEN {d(a)} ELSE {d(b)} END)"
_bottom = lambda name: " + ".join(["0e0", *(_w(a, b) for _, _, a, b in _PARTS[name])])
_top = lambda name: " + ".join(["0e0", *(f"{clamp(v)} * {_w(a, b)}" for _, v, a, b in _PARTS[name])])
_SCORE = {name: f"(({_top(name)}) / ({_bottom(name)}))" for name in _PARTS}
SCORED = f"""{SEGMENTS},
mode AS (SELECT *, CASE WHEN NOT has_speech THEN 'not-applicable' WHEN transcript_excerpt <> '' THEN 'transcript'
  WHEN coalesce(speech_ratio, 0) >= 0.9e0 OR (coalesce(speech_ratio, 0) >= 0.65e0 AND coalesce(audio_energy, 0) >= 0.2e0) THEN 'speech-signal-fallback' ELSE 'visual' END AS mode_source FROM seg),
sp AS (SELECT *, mode_source IN ('transcript', 'speech-signal-fallback') AS speech FROM mode),
raw AS (SELECT *, CASE WHEN speech THEN 'speech' ELSE 'visual' END AS analysis_mode, {", ".join(f"{x} AS s_{n}" for n, x in _SCORE.items())} FROM sp),
scored AS (SELECT *, {", ".join(f"{r(f's_{n}')} AS score_{n}" for n in _SCORE)}, {r(clamp(f"{d(0.35)} * s_technical + {d(0.4)} * s_semantic + 0.25e0 * s_story"))} AS score_total FROM raw)"""
TAKES = f"""{SCORED},
t1 AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY score_total DESC, pos) AS within_asset_rank, max(score_total) OVER (PARTITION BY asset_id) AS winner FROM scored),
t2 AS (SELECT *, {r("greatest(0e0, winner - score_total)")} AS score_gap, row_number() OVER (PARTITION BY asset_id ORDER BY pos) AS take_no,
  (score_total >= 0.68e0 AND score_total >= winner - 0.08e0 AND within_asset_rank <= CASE WHEN duration_sec >= 18 THEN 2 ELSE 1 END) OR (winner < 0.68e0 AND within_asset_rank = 1) AS is_selected FROM t1),
takes AS (SELECT *, CASE WHEN within_asset_rank = 1 THEN 'best' WHEN is_selected THEN 'alternate' ELSE 'backup' END AS outcome, asset_id || '-take-' || {padded('take_no', 2)} AS take_id FROM t2)"""

ORACLES["score_segments"] = f"WITH {SCORED} SELECT asset_id, segment_id, analysis_mode, mode_source, score_technical, score_semantic, score_story, score_total FROM scored"
ORACLES["take_rank"] = f"WITH {TAKES} SELECT asset_id, asset_name, segment_id, take_id, analysis_mode, score_total, within_asset_rank, score_gap, outcome, is_selected FROM takes"
ORACLES["best_takes"] = f"WITH {TAKES} SELECT asset_id, segment_id, outcome, score_total FROM takes WHERE is_selected"

_SHARES = " UNION ALL ".join(f"SELECT asset_id, segment_id, '{k}' AS driver, {clamp(v)} * ({_w(a, b)} / ({_bottom(n)})) * {d(_BLEND[n])} AS share FROM takes" for n, parts in _PARTS.items() for k, v, a, b in parts)
_LABELS = {"question_answer_flow": "question/answer flow", "clip_score": "CLIP semantic match"}
_LABEL = "replace(driver, '_', ' ')"
CONTRIBUTIONS = f"{TAKES}, shares AS ({_SHARES}), contrib AS (SELECT asset_id, segment_id, driver, {r('sum(share) + 1e-9', 6)} AS contribution FROM shares GROUP BY ALL)"
ORACLES["score_drivers"] = f"WITH {CONTRIBUTIONS} SELECT * FROM contrib WHERE contribution > 0"
ORACLES["top_driver_labels"] = f"""WITH {CONTRIBUTIONS}, k AS (SELECT *, {_LABEL} AS label, row_number() OVER (PARTITION BY asset_id, segment_id ORDER BY contribution DESC, {_LABEL}) AS i FROM contrib WHERE contribution > 0)
SELECT asset_id, segment_id, string_agg(label, '|' ORDER BY i) AS labels FROM k WHERE i <= 3 GROUP BY ALL"""
ORACLES["limiting_factor_labels"] = f"""WITH {CONTRIBUTIONS}, win AS (SELECT c.asset_id, c.driver, c.contribution AS w FROM contrib c JOIN takes t ON c.segment_id = t.segment_id WHERE within_asset_rank = 1),
g AS (SELECT c.asset_id, c.segment_id, c.driver, {r("w - c.contribution", 6)} AS delta FROM contrib c JOIN win USING (asset_id, driver)),
k AS (SELECT *, {_LABEL} AS label, row_number() OVER (PARTITION BY segment_id ORDER BY delta DESC, {_LABEL}) AS i FROM g WHERE delta > 0)
SELECT asset_id, segment_id, string_agg(label, '|' ORDER BY i) AS labels FROM k WHERE i <= 2 GROUP BY ALL"""

_listed = lambda rules, default="NULL": f"coalesce(nullif(concat_ws('|', {', '.join(f'CASE WHEN {t} THEN {chr(39)}{v}{chr(39)} END' for t, v in rules)}), ''), {default})"
ORACLES["rule_understanding"] = f"""WITH {SCORED}, m AS (SELECT segment_id, start_sec, speech, {_z('visual_novelty')} AS nov, {_z('subject_clarity')} AS cla, {_z('motion_energy')} AS mot, story_alignment AS sto, duration_fit AS fit FROM scored),
c AS (SELECT *, {r("(nov + cla + sto) / 3e0")} AS confidence FROM m)
SELECT segment_id, confidence, CASE WHEN confidence >= 0.75e0 THEN 'keep' WHEN confidence >= 0.58e0 THEN 'maybe' ELSE 'reject' END AS keep_label,
CASE WHEN nov >= 0.8e0 AND mot >= 0.7e0 THEN 'wide' WHEN cla >= 0.8e0 THEN 'detail' WHEN mot < 0.45e0 THEN 'static' ELSE 'medium' END AS shot_type,
CASE WHEN mot < 0.35e0 THEN 'static' WHEN mot < 0.65e0 THEN 'gentle movement' ELSE 'active movement' END AS camera_motion,
CASE WHEN speech AND sto >= 0.7e0 THEN 'informative' WHEN speech THEN 'conversational' WHEN mot >= 0.72e0 THEN 'energetic' WHEN nov >= 0.76e0 THEN 'cinematic' ELSE 'steady' END AS mood,
{_listed([("start_sec <= 0.5e0", "opener"), ("sto >= 0.72e0", "bridge"), ("nov >= 0.78e0", "payoff")], "CASE WHEN cla >= 0.78e0 THEN 'detail' ELSE 'bridge' END")} AS story_roles,
{_listed([("cla >= 0.8e0", "clear framing"), ("mot >= 0.72e0", "usable motion"), ("fit >= 0.75e0", "rough-cut friendly duration")], "'usable coverage'")} AS quality_findings,
{_listed([("mot < 0.38e0", "low_motion"), ("cla < 0.6e0", "low_clarity"), ("sto < 0.58e0", "weak_story_fit")], "''")} AS risk_flags FROM c"""

ORACLES["shortlist_topk"] = f"WITH {SEGMENTS} SELECT asset_id, segment_id, prefilter_score FROM seg WHERE prefilter_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY prefilter_score DESC, pos) <= 3"
ORACLES["three_stage_targets"] = f"""WITH {SEGMENTS}, f AS (SELECT *, {r("(coalesce(CASE WHEN segment_id % 5 <> 0 THEN visual_novelty END, 0e0) + prefilter_score) / 2e0", 6)} AS gate_score FROM seg WHERE prefilter_score IS NOT NULL AND segment_id % 7 <> 0 AND segment_id % 11 <> 0 AND segment_id % 13 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY gate_score DESC, pos) AS gate_rank, least(count(*) OVER (PARTITION BY asset_id), 4) AS n FROM f)
SELECT asset_id, segment_id, gate_score, gate_rank, CASE WHEN gate_rank > 4 THEN 'over_limit' WHEN gate_rank <= greatest(1, floor(n * 50e0 / 100)) THEN 'target' ELSE 'budget_capped' END AS stage FROM k"""

_AMB = [
    ("st IN ('legacy', 'duration-rule', 'scene-duration')", 0.18), ("starts_with(st, 'assembly-merge:structural')", 0.16), ("op = 'split'", 0.2), ("op = 'merge'", 0.12),
    ("st IN ('audio-snap', 'scene-snap') AND drift >= 1e0", 0.08), ("st = 'transcript-snap' AND drift >= 0.75e0", 0.04), ("st = 'turn-snap' AND drift >= 0.5e0", 0.03), ("speech AND segment_id % 2 = 0", 0.08),
    ("speech AND segment_id % 3 >= 2", 0.05), ("speech AND visual_novelty < 0.7e0", 0.06), ("speech AND visual_novelty < 0.5e0", 0.08), ("speech AND end_sec - start_sec >= 2 AND end_sec - start_sec <= 7", 0.08), ("NOT speech AND motion_energy >= 0.65e0", 0.06),
]
_AMB_SUM = " + ".join([f"1e0 - {clamp('stability')}", *(f"CASE WHEN {t} THEN {d(p)} ELSE 0e0 END" for t, p in _AMB)])
DOUBT = f"""{SCORED}, q AS (SELECT *, ['legacy', 'turn-snap', 'transcript-snap', 'audio-snap', 'scene-snap', 'assembly-merge:structural-continuity'][(segment_id % 6 + 1)::INT] AS st,
  CASE WHEN segment_id % 6 = 5 THEN 'merge' WHEN segment_id % 4 = 0 THEN 'split' ELSE '' END AS op, (segment_id % 5) * 0.25e0 AS drift FROM scored WHERE prefilter_score IS NOT NULL),
doubt AS (SELECT *, {r(clamp(_AMB_SUM))} AS ambiguity FROM q)"""
ORACLES["boundary_ambiguity"] = f"WITH {DOUBT} SELECT segment_id, ambiguity FROM doubt"
TARGETS = f"""{DOUBT}, k AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ambiguity DESC, score_total DESC, pos) AS target_rank, max(ambiguity) OVER (PARTITION BY asset_id) AS most FROM doubt),
targets AS (SELECT *, CASE WHEN ambiguity >= 0.75e0 THEN 'threshold' ELSE 'floor' END AS target_reason FROM k WHERE ambiguity >= 0.75e0 OR (most < 0.75e0 AND ambiguity >= 0.5e0 AND target_rank <= 1))"""
ORACLES["ambiguity_targets"] = f"WITH {TARGETS} SELECT asset_id, segment_id, ambiguity, target_rank, target_reason FROM targets"
ORACLES["budget_drain"] = f"""WITH {TARGETS}, b AS (SELECT *, row_number() OVER (ORDER BY asset_id, target_rank) AS run_rank, count(*) OVER () AS total FROM targets)
SELECT asset_id, segment_id, run_rank, CASE WHEN run_rank <= greatest(1, floor(total * 30e0 / 100)) THEN 'pending' ELSE 'over_budget' END AS status FROM b"""

ORACLES["overrides_apply"] = f"""WITH {TAKES}, o AS (SELECT asset_id, segment_id AS seg FROM takes WHERE within_asset_rank = 2 AND asset_id % 4 = 1 UNION ALL SELECT asset_id, NULL FROM takes WHERE within_asset_rank = 1 AND asset_id % 4 = 2),
j AS (SELECT t.*, o.asset_id IS NOT NULL AS has, o.seg, coalesce(o.seg = t.segment_id, false) AS named FROM takes t LEFT JOIN o ON o.asset_id = t.asset_id)
SELECT asset_id, segment_id, CASE WHEN has THEN named ELSE is_selected END AS is_selected, CASE WHEN named THEN 'best' WHEN has AND outcome = 'best' THEN CASE WHEN seg IS NULL THEN 'backup' ELSE 'alternate' END ELSE outcome END AS outcome,
named AND NOT is_selected AS editor_override, has AND seg IS NULL AND is_selected AS editor_cleared FROM j"""
_V = f"{TAKES}, v AS (SELECT *, CASE WHEN within_asset_rank <= 2 THEN take_id END AS tid, CASE WHEN within_asset_rank <= 2 THEN score_total END AS st, CASE WHEN is_selected THEN true END AS on_timeline FROM takes)"
ORACLES["ranked_view"] = f"WITH {_V} SELECT row_number() OVER (ORDER BY coalesce(st, prefilter_score, 0e0) DESC, tid IS NULL, asset_name, start_sec, segment_id) AS view_rank, asset_name, segment_id, tid AS take_id, st AS score_total, on_timeline FROM v"
ORACLES["clip_view"] = f"WITH {_V} SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY start_sec, segment_id) AS clip_rank, segment_id, tid AS take_id FROM v"
ORACLES["summary_counters"] = f"""WITH {TAKES} SELECT count(*) AS segments, count(DISTINCT asset_id) AS assets, count(*) FILTER (speech) AS speech_segments, count(*) FILTER (NOT speech) AS visual_segments,
count(*) FILTER (mode_source = 'speech-signal-fallback') AS speech_fallbacks, count(*) FILTER (transcript_excerpt <> '') AS with_excerpt, count(*) AS takes, count(*) FILTER (is_selected) AS selected,
count(*) FILTER (outcome = 'alternate') AS alternates, {r("avg(score_total)", 3)} AS mean_total, {r("100e0 * count(*) FILTER (is_selected) / count(*)", 1)} AS selected_pct FROM takes"""

ITEMS = f"""{TAKES}, it0 AS (SELECT *, asset_id % 20 AS scope, row_number() OVER (PARTITION BY asset_id % 20 ORDER BY asset_id, within_asset_rank) - 1 AS order_index, least(end_sec - start_sec, 7.5e0) AS len, count(*) OVER (PARTITION BY asset_id % 20) AS n_items FROM takes WHERE is_selected),
items AS (SELECT *, CASE WHEN order_index = 0 THEN 'setup' WHEN order_index = n_items - 1 THEN 'release' ELSE 'development' END AS sequence_group, CASE WHEN order_index = 0 THEN 'opener' WHEN order_index = n_items - 1 THEN 'release' WHEN speech THEN 'spoken beat' ELSE 'visual bridge' END AS sequence_role,
CASE WHEN order_index = 0 THEN 'Opener' WHEN order_index = n_items - 1 THEN 'Outro' WHEN speech THEN 'Narrative beat' ELSE 'Visual bridge' END AS label, 'reel-' || asset_id % 9 AS reel FROM it0)"""
ORACLES["timeline_offsets"] = f"WITH {ITEMS} SELECT scope, order_index, segment_id, {r('coalesce(sum(len) OVER (PARTITION BY scope ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)', 3)} AS offset_sec, label, sequence_group, sequence_role FROM items"
ORACLES["context_window"] = f"WITH {SEGMENTS} SELECT asset_id, segment_id, coalesce(lag(start_sec) OVER w, start_sec) AS context_start, coalesce(lead(end_sec) OVER w, end_sec) AS context_end FROM seg WINDOW w AS (PARTITION BY asset_id ORDER BY start_sec, pos)"
ORACLES["mode_alternations"] = f"""WITH {ITEMS}, a AS (SELECT *, analysis_mode <> lag(analysis_mode) OVER (PARTITION BY scope ORDER BY order_index) AS changed FROM items)
SELECT scope, count(*) AS n_items, count(*) FILTER (changed) AS mode_changes, count(DISTINCT sequence_role) AS n_roles, count(DISTINCT sequence_group) AS n_groups, CASE WHEN bool_and(NOT speech) THEN 'visual-led' WHEN bool_and(speech) THEN 'dialogue-led' ELSE 'mixed' END AS kind FROM a GROUP BY scope"""
ORACLES["timeline_state"] = f"""WITH {ITEMS} SELECT scope, count(*) AS item_count, string_agg(DISTINCT reel, '|' ORDER BY reel) AS reels, string_agg(DISTINCT sequence_role, '|' ORDER BY sequence_role) AS roles, string_agg(DISTINCT sequence_group, '|' ORDER BY sequence_group) AS groups, arg_min(reel, order_index) AS opener_reel, arg_max(reel, order_index) AS closing_reel FROM items GROUP BY scope"""

# Signals and ranges.
_T = "floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000) / 1e3"
AUDIO = f"audio AS (SELECT user_id AS asset_id, event_id, {_T} AS t, {r('least(1e0, value / 500)')} AS rms, value < 5 AS silent FROM events)"
SPANS_E = f"es AS (SELECT user_id AS asset_id, event_id, {_T} AS s, {_T} + floor(value * 100 + 0.5e0) * {d(0.6)} AS e, event_type AS text FROM events)"
_ranges = lambda width: f"ranges AS (SELECT asset_id, i::INT AS range_id, i * 129600e0 AS s, i * 129600e0 + {width} AS e FROM (SELECT DISTINCT user_id AS asset_id FROM events), range(0, (SELECT floor(max({_T}) / 129600)::BIGINT + 1 FROM events)) x(i))"
_NEAR = """ins AS (SELECT r.asset_id, range_id, event_id, t, rms, silent, 'inside' AS matched FROM ranges r JOIN audio a ON a.asset_id = r.asset_id AND t >= s AND t <= e),
near AS (SELECT r.asset_id, range_id, event_id, t, rms, silent, 'nearest' AS matched FROM ranges r JOIN audio a ON a.asset_id = r.asset_id WHERE NOT EXISTS (SELECT 1 FROM ins i WHERE i.asset_id = r.asset_id AND i.range_id = r.range_id)
  QUALIFY row_number() OVER (PARTITION BY r.asset_id, range_id ORDER BY abs(t - (s + e) / 2), t, event_id) = 1),
m AS (SELECT * FROM ins UNION ALL SELECT * FROM near)"""
ORACLES["interval_signal_agg"] = f"""WITH {AUDIO}, {_ranges('20000e0')}, {_NEAR} SELECT asset_id, range_id, count(*) AS n, min(matched) AS matched, {r('avg(rms)', 3)} AS energy, {r('count(*) FILTER (NOT silent)::DOUBLE / count(*)')} AS speech_ratio FROM m GROUP BY ALL"""
ORACLES["nearest_signal"] = f"WITH {AUDIO}, {_ranges('600e0')}, {_NEAR} SELECT asset_id, range_id, event_id, t FROM near"
_ISLANDS = lambda source, slack: f"""f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY asset_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {slack} THEN 0 ELSE 1 END AS o FROM {source}),
g AS (SELECT *, sum(o) OVER (PARTITION BY asset_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM f), isl AS (SELECT asset_id, k, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY ALL)"""  # noqa: E731
ORACLES["silence_share"] = f"""WITH {SPANS_E}, err AS (SELECT * FROM es WHERE text = 'error'), {_ISLANDS('err', '0')}, {_ranges('20000e0')},
q AS (SELECT r.asset_id, r.range_id, sum(round(greatest(0e0, least(r.e, i.e) - greatest(r.s, i.s)), 6)) AS q FROM ranges r JOIN isl i ON i.asset_id = r.asset_id AND i.e >= r.s AND i.s <= r.e GROUP BY ALL)
SELECT r.asset_id, r.range_id AS window_id, r.e - r.s <= 0 OR coalesce(q, 0e0) >= 0.5e0 * (r.e - r.s) AS is_silent FROM ranges r LEFT JOIN q USING (asset_id, range_id)"""
ORACLES["sessionize_turns"] = f"""WITH {SPANS_E}, f AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY asset_id ORDER BY s, e) <= 10800 THEN 0 ELSE 1 END AS o FROM es), g AS (SELECT *, (sum(o) OVER (PARTITION BY asset_id ORDER BY s, e ROWS UNBOUNDED PRECEDING))::INT AS turn FROM f)
SELECT asset_id, turn, 'turn-' || lpad(turn::VARCHAR, greatest(2, length(turn::VARCHAR))::INT, '0') AS turn_id, min(s) AS start_sec, {r('max(e)', 3)} AS end_sec, string_agg(text, ' ' ORDER BY s, e, text) AS text, count(*) AS span_count FROM g GROUP BY ALL"""
ORACLES["merge_islands"] = f"WITH {SPANS_E}, {_ISLANDS('es', '3600')} SELECT asset_id, s AS start_sec, {r('e', 3)} AS end_sec, n FROM isl"
ORACLES["speech_gate"] = f"""WITH {AUDIO}, a AS (SELECT asset_id, rms * (asset_id % 4) / 40 AS x, silent FROM audio), g AS (SELECT asset_id, avg(x) AS mean, max(x) AS most, count(*) FILTER (NOT silent) AS loud FROM a GROUP BY ALL),
h AS (SELECT *, most >= 0.02e0 OR (loud >= 3 AND mean >= 0.0075e0) OR (loud >= 2 AND most >= 0.012e0 AND mean >= 0.0065e0) AS request, most >= 0.05e0 OR (loud >= 4 AND mean >= 0.02e0) AS direct FROM g)
SELECT asset_id, loud AS loud_rows, request, request AND direct AS without_probe, NOT request AND (mean >= 0.003e0 OR most >= 0.005e0) AS probe_after_skip FROM h"""
ORACLES["probe_ranges"] = f"""WITH {AUDIO}, l AS (SELECT asset_id, max(t) AS dur FROM audio GROUP BY ALL), p AS (SELECT a.asset_id, greatest(0e0, least(t - 3600, dur - 7200)) AS s0, dur FROM audio a JOIN l USING (asset_id) WHERE NOT silent QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY rms DESC, t) <= 2),
w AS (SELECT asset_id, {r('s0', 3)} AS s, {r('least(dur, s0 + 7200)', 3)} AS e FROM p), {_ISLANDS('w', '0.25e0')} SELECT asset_id, s AS start_sec, e AS end_sec FROM isl WHERE e - s >= 0.5"""

# Conversations.
_Q = "('how', 'what', 'when', 'where', 'which', 'who', 'why', 'can', 'could', 'did', 'do', 'does', 'is', 'are', 'should', 'will', 'would')"
_ASK = f"(contains(coalesce(text, ''), '?') OR regexp_extract(lower(trim(coalesce(text, ''))), '[a-z0-9'']+') IN {_Q})"
CONV = f"sp AS (SELECT conv_id AS asset_id, turn, turn * 4e0 AS s, turn * 4e0 + least(3.5e0, ceil(length(text) / 25e0) * 0.25e0) AS e, text, {_ASK} AS q FROM conversations)"
ORACLES["question_answer_pairs"] = f"WITH {CONV}, n AS (SELECT *, lead(text) OVER w AS answer, lead(q) OVER w AS nq FROM sp WINDOW w AS (PARTITION BY asset_id ORDER BY turn)) SELECT asset_id, turn, text AS question, answer FROM n WHERE q AND answer IS NOT NULL AND NOT nq"
ORACLES["spoken_structure"] = f"""WITH {CONV}, n AS (SELECT *, lead(s) OVER w - e AS gap, lead(q) OVER w AS nq FROM sp WINDOW w AS (PARTITION BY asset_id ORDER BY s, e)),
g AS (SELECT asset_id, count(*) AS n_spans, coalesce(bool_or(q AND gap IS NOT NULL AND NOT nq AND gap <= 1.6e0), false) AS answered, coalesce(max(gap), 0e0) AS widest, count(*) FILTER (q) AS questions, bool_or(q AND gap IS NULL) AS ends FROM n GROUP BY ALL)
SELECT asset_id, n_spans, questions, CASE WHEN answered THEN {d(0.9)} ELSE 0e0 END AS question_answer_flow, CASE WHEN answered OR n_spans < 2 OR widest > 0.95e0 THEN 0e0 WHEN questions = 0 THEN {d(0.82)} WHEN questions = 1 AND NOT ends THEN {d(0.68)} ELSE 0e0 END AS monologue_continuity FROM g"""
ORACLES["overlap_excerpt"] = f"""WITH {CONV}, w AS (SELECT asset_id, i::INT AS segment_id, i * 10e0 AS ws, i * 10e0 + 8e0 AS we FROM (SELECT asset_id, max(e) AS dur FROM sp GROUP BY ALL), range(0, 10000) x(i) WHERE i <= floor(dur / 10))
SELECT w.asset_id, segment_id, string_agg(trim(text), ' ' ORDER BY s, e, trim(text)) AS excerpt, count(*) AS n FROM w JOIN sp ON sp.asset_id = w.asset_id AND e >= ws AND s <= we GROUP BY ALL"""
_CTURNS = lambda gap: f"""tf AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY asset_id ORDER BY s, e) <= {gap} THEN 0 ELSE 1 END AS o FROM sp), tg AS (SELECT *, sum(o) OVER (PARTITION BY asset_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM tf),
turns AS (SELECT asset_id, k, min(s) AS a, max(e) AS b FROM tg GROUP BY ALL)"""  # noqa: E731
ORACLES["turn_alignment"] = f"""WITH {CONV}, {_CTURNS('1e0')}, w AS (SELECT asset_id, i::INT AS segment_id, i * 10e0 + 0.25e0 AS s, i * 10e0 + 8e0 AS e FROM (SELECT asset_id, max(e) AS dur FROM sp GROUP BY ALL), range(0, 10000) x(i) WHERE i <= floor(dur / 10)),
g AS (SELECT w.asset_id, segment_id, min(w.s) AS s, max(w.e) AS e, min(a) AS a, max(b) AS b, count(*) AS turn_count FROM w JOIN turns t ON t.asset_id = w.asset_id AND b >= w.s AND a <= w.e GROUP BY ALL),
h AS (SELECT *, {clamp('coalesce(greatest(0e0, least(e, b) - greatest(s, a)) / nullif(b - a, 0e0), 0e0)')} AS cov, {clamp(f'1e0 - greatest(0e0, s - a) / {d(0.45)}')} AS le, {clamp(f'1e0 - greatest(0e0, b - e) / {d(0.45)}')} AS re FROM g)
SELECT asset_id, segment_id, turn_count, {r(clamp(f'{d(0.55)} * cov + {d(0.45)} * (le + re) / 2e0'))} AS turn_completeness, CASE WHEN le >= 0.85e0 AND re >= 0.85e0 THEN 'turn-aligned' WHEN cov >= 0.8e0 THEN 'mostly-complete' ELSE 'partial-turn' END AS turn_alignment FROM h"""
# Scenes, grids, seeds.
SCENES = lambda src, key, dur: f"""u AS (SELECT {key} AS asset_id, greatest({dur}, 6e0) AS d FROM {src}), v AS (SELECT *, greatest(2.75e0, least(6e0, d / 3)) AS st FROM u),
w AS (SELECT asset_id, i, CASE WHEN d <= 8 THEN 0e0 ELSE {r('i * st', 3)} END AS a, CASE WHEN d <= 8 THEN {r('d', 3)} ELSE {r('least(d, i * st + 5.5e0)', 3)} END AS b FROM v, range(0, 4) x(i) WHERE (d <= 8 AND i = 0) OR (d > 8 AND (i = 0 OR (i - 1) * st + 5.5e0 < d))),
scenes AS (SELECT asset_id, (row_number() OVER (PARTITION BY asset_id ORDER BY i) - 1)::INT AS pos, a, b FROM w WHERE b - a >= 2.5e0)"""  # noqa: E731
# Assembly.  `{p}` keeps the names of the steps apart.
_CLIPS = "clips AS (SELECT asset_id, max(e) AS dur FROM sp GROUP BY ALL)"


def _continuity(p: str, seg: str) -> str:
    """{p}c: the segments (asset_id, id, s, e, mode, qq, src, source, conf) with pos and the rule that joins each to the one before."""
    return f"""{p}n AS (SELECT *, row_number() OVER o AS pos, lag(s) OVER o AS ls, lag(e) OVER o AS le, lag(mode) OVER o AS lmode, lag(qq) OVER o AS lqq, lag(src) OVER o AS lsrc, lag(source) OVER o AS lsource FROM {seg} WINDOW o AS (PARTITION BY asset_id ORDER BY s, e, id)),
{p}s AS (SELECT n.asset_id, n.pos, lead(x.s) OVER (PARTITION BY n.asset_id, n.pos ORDER BY x.s, x.e) - x.e AS g FROM {p}n n JOIN sp x ON x.asset_id = n.asset_id AND x.e >= n.ls AND x.s <= n.e),
{p}sg AS (SELECT asset_id, pos, count(*) AS n_spans, {r('coalesce(max(greatest(0e0, g)), 0e0)', 3)} AS span_gap FROM {p}s GROUP BY ALL),
{p}t AS (SELECT n.asset_id, n.pos, n.s, n.e, ls, le, k, a, b FROM {p}n n JOIN turns t ON t.asset_id = n.asset_id AND b >= ls AND a <= greatest(n.e, le)),
{p}tl AS (SELECT *, CASE WHEN a <= e THEN lead(CASE WHEN a <= e THEN a END) OVER (PARTITION BY asset_id, pos ORDER BY a, b) - b END AS g FROM {p}t),
{p}tg AS (SELECT asset_id, pos, {r('coalesce(max(greatest(0e0, g)), 0e0)', 3)} AS turn_gap, bool_or(a <= le AND b >= ls AND a <= e AND b >= s) AS shared, max(k) FILTER (a <= le AND b >= ls) AS lk, arg_max(b, k) FILTER (a <= le AND b >= ls) AS lb, min(k) FILTER (a <= e AND b >= s) AS rk, arg_min(a, k) FILTER (a <= e AND b >= s) AS ra FROM {p}tl GROUP BY ALL),
{p}d AS (SELECT DISTINCT n.asset_id, n.pos FROM {p}n n JOIN cuts c ON c.asset_id = n.asset_id AND cut >= le AND cut <= s),
{p}j AS (SELECT n.*, {r('greatest(0e0, s - le)', 3)} AS gap, coalesce(n_spans, 0) AS n_spans, coalesce(span_gap, 0e0) AS span_gap, coalesce(turn_gap, 0e0) AS turn_gap, coalesce(shared, false) OR coalesce(rk - lk = 1, false) AS on_turn, coalesce(rk - lk = 1 AND ra - lb >= 1.35e0, false) AS brk, d.pos IS NOT NULL AS divider
  FROM {p}n n LEFT JOIN {p}sg USING (asset_id, pos) LEFT JOIN {p}tg USING (asset_id, pos) LEFT JOIN {p}d d USING (asset_id, pos)),
{p}r AS (SELECT *, CASE WHEN ls IS NULL OR gap > 1.25e0 OR coalesce(lsource = source, false) OR divider THEN NULL
  WHEN mode = 'speech' AND lmode = 'speech' AND lqq AND NOT qq AND NOT brk THEN 'question-answer-flow' WHEN mode = 'speech' AND lmode = 'speech' AND NOT lqq AND NOT qq AND gap <= {d(0.95)} THEN 'monologue-continuity'
  WHEN on_turn AND NOT brk AND turn_gap <= {d(0.55)} THEN 'turn-continuity' WHEN n_spans >= 2 AND span_gap <= {d(0.9)} THEN 'transcript-continuity'
  WHEN gap <= {d(0.4)} AND greatest(e, le) - least(s, ls) <= 7.5e0 AND (mode = lmode OR mode = 'speech' OR lmode = 'speech' OR list_has_any(src, lsrc)) THEN 'structural-continuity' END AS rule FROM {p}j),
{p}c AS (SELECT *, (sum(CASE WHEN rule IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::INT AS chain FROM {p}r)"""


_CUTS = "cuts AS (SELECT asset_id, b AS cut FROM (SELECT *, lead(pos) OVER (PARTITION BY asset_id ORDER BY pos) AS nx FROM scenes) WHERE nx IS NOT NULL)"
_FAMILY = "CASE count(DISTINCT rule) WHEN 0 THEN '' WHEN 1 THEN max(rule) ELSE 'continuity-chain' END"
_ON_CLIPS = f"{CONV}, {_CTURNS(d(0.9))}, {_CLIPS}, {SCENES('clips', 'asset_id', 'dur')}, {_CUTS}"
ORACLES["merge_chain"] = f"""WITH {_ON_CLIPS},
sg AS (SELECT asset_id, turn AS id, s, e + (turn % 3) * 0.125e0 AS e, CASE WHEN turn % 4 = 3 THEN 'visual' ELSE 'speech' END AS mode, turn % 4 <> 3 AND trim(text) <> '' AND q AS qq, [['scene', 'audio-peak', 'visual-peak'][(turn % 3 + 1)::INT]] AS src, CASE WHEN turn % 6 >= 4 THEN (turn // 6)::VARCHAR END AS source, (turn % 5) * 0.125e0 + 0.25e0 AS conf FROM sp),
{_continuity('m_', 'sg')}
SELECT asset_id, chain, min(s) AS start_sec, arg_max(e, pos) AS end_sec, count(*) AS n, {_FAMILY} AS rule_family, {r(clamp('avg(conf)'))} AS boundary_confidence, string_agg(id::VARCHAR, '|' ORDER BY pos) AS segment_ids FROM m_c GROUP BY ALL"""


def _dividers(seg: str) -> str:
    """div: asset_id, id, divider, rule of the segments (asset_id, id, s, e) that are cut."""
    apart = "mid - s >= 2 AND e - mid >= 2"
    gaps = lambda rows, a, b: f"SELECT *, lead({a}) OVER (PARTITION BY asset_id, id ORDER BY {a}, {b}) - {b} AS gap, {r(f'(lead({a}) OVER (PARTITION BY asset_id, id ORDER BY {a}, {b}) + {b}) / 2', 3)} AS mid FROM {rows}"
    return f"""dl AS (SELECT asset_id, id, s, e FROM {seg} WHERE e - s >= 6.5e0),
dt AS (SELECT l.*, a, b FROM dl l JOIN turns t ON t.asset_id = l.asset_id AND b >= s AND a <= e), ds AS (SELECT l.*, x.s AS a, x.e AS b FROM dl l JOIN sp x ON x.asset_id = l.asset_id AND x.e >= l.s AND x.s <= l.e),
dn AS (SELECT asset_id, id, count(*) AS n, min(a) AS fa, max(b) AS lb FROM ds GROUP BY ALL), dtg AS ({gaps('dt', 'a', 'b')}), dsg AS ({gaps('ds', 'a', 'b')}),
dall AS (SELECT asset_id, id, s, e, 1 AS rank, mid AS o, mid, 'turn-break' AS rule FROM dtg WHERE gap >= 1.35e0 AND {apart}
  UNION ALL SELECT asset_id, id, s, e, 2, -gap, mid, 'transcript-gap' FROM dsg JOIN dn USING (asset_id, id) WHERE n >= 3 AND gap >= 1.25e0 AND {apart}
  UNION ALL SELECT asset_id, id, s, e, 3, CASE WHEN n IS NULL THEN abs(cut - (s + e) / 2) ELSE cut END, cut, 'scene-divider' FROM dl JOIN cuts USING (asset_id) LEFT JOIN dn USING (asset_id, id) WHERE cut >= s + 1.5e0 AND cut <= e - 1.5e0 AND (n IS NULL OR (fa < cut AND lb > cut))),
div AS (SELECT asset_id, id, mid AS divider, rule FROM (SELECT * FROM dall QUALIFY row_number() OVER (PARTITION BY asset_id, id ORDER BY rank, o, mid) = 1) WHERE {apart})"""


_SPLIT_SCENES = SCENES("clips", "asset_id", "dur")
ORACLES["split_dividers"] = f"""WITH {CONV}, {_CTURNS('2e0')}, {_CLIPS}, {_SPLIT_SCENES}, {_CUTS}, ss AS (SELECT asset_id, count(*) AS id, min(s) AS s, max(e) AS e FROM sp GROUP BY ALL), {_dividers('ss')}
SELECT asset_id, id AS segment_id, divider, rule FROM div"""
_SAID = lambda rows: f"SELECT g.asset_id, g.id, string_agg(trim(text), ' ' ORDER BY x.s, x.e, trim(text)) FILTER (trim(text) <> '') AS txt FROM {rows} g JOIN sp x ON x.asset_id = g.asset_id AND x.e >= g.s AND x.s <= g.e GROUP BY ALL"
ORACLES["assembled_segments"] = f"""WITH {_ON_CLIPS},
ss AS (SELECT asset_id, i::INT AS id, i * 12e0 AS s, least(i * 12e0 + 11, dur) AS e, [CASE WHEN i % 2 = 0 THEN 'scene' ELSE 'audio-peak' END] AS src, 0.25e0 + (i % 4) * 0.125e0 AS conf FROM clips, range(0, 100000) x(i) WHERE i <= floor(dur / 12) AND i * 12e0 < least(i * 12e0 + 11, dur)),
{_dividers('ss')},
pt AS (SELECT asset_id, id::VARCHAR AS id, s, e, src, conf, NULL::VARCHAR AS source, '' AS prule, 'scene-snap' AS st FROM ss ANTI JOIN div USING (asset_id, id)
  UNION ALL SELECT asset_id, id || '-split-' || i, CASE WHEN i = 1 THEN s ELSE divider END, CASE WHEN i = 1 THEN divider ELSE e END, src, {r(f'greatest(conf, {d(0.45)}) * {d(0.92)}')}, id::VARCHAR, rule, 'assembly-split:' || rule FROM ss JOIN div USING (asset_id, id), (VALUES (1), (2)) x(i)),
ps AS ({_SAID('pt')}),
pd AS (SELECT pt.*, CASE WHEN coalesce(txt, '') <> '' THEN 'speech' ELSE 'visual' END AS mode, contains(coalesce(txt, ''), '?') OR regexp_extract(lower(trim(coalesce(txt, ''))), '[a-z0-9'']+') IN {_Q} AS qq FROM pt LEFT JOIN ps USING (asset_id, id)),
{_continuity('a_', 'pd')},
ch AS (SELECT asset_id, chain, min(s) AS s, arg_max(e, pos) AS e, count(*) AS n, {_FAMILY} AS fam, {r(clamp('avg(conf)'))} AS mean, arg_min(conf, pos) AS conf, arg_min(source, pos) AS source, arg_min(prule, pos) AS prule, arg_min(st, pos) AS st, list(id ORDER BY pos) AS ids, flatten(list(src ORDER BY pos)) AS srcs FROM a_c GROUP BY ALL),
cc AS (SELECT asset_id, ids[1] AS id, s, e, CASE WHEN n = 1 THEN st ELSE 'assembly-merge:' || fam END AS st, CASE WHEN n = 1 THEN conf ELSE mean END AS conf, CASE WHEN n > 1 THEN 'merge' WHEN source IS NOT NULL THEN 'split' ELSE '' END AS op, CASE WHEN n = 1 THEN prule ELSE fam END AS fam,
  CASE WHEN n = 1 AND source IS NOT NULL THEN source ELSE array_to_string(ids, '|') END AS source_ids, array_to_string(list_filter(srcs, lambda x, i: list_position(srcs, x) = i), '|') AS seed_sources FROM ch),
cs AS ({_SAID('cc')})
SELECT asset_id, asset_id || '-segment-' || {padded('row_number() OVER (PARTITION BY asset_id ORDER BY s, e, id)', 2)} AS segment_id, s AS start_sec, e AS end_sec, st AS boundary_strategy, conf AS boundary_confidence, op AS operation, fam AS rule_family, source_ids, seed_sources,
CASE WHEN coalesce(txt, '') <> '' THEN 'speech' ELSE 'visual' END AS analysis_mode, length(coalesce(txt, ''))::INT AS excerpt_chars FROM cc LEFT JOIN cs USING (asset_id, id)"""
ORACLES["scene_windows"] = f"WITH {ASSETS}, {SCENES('assets', 'asset_id', 'duration_sec')} SELECT asset_id, pos, a AS start_sec, b AS end_sec FROM scenes"
ORACLES["sample_grid"] = f"""WITH {ASSETS}, n AS (SELECT asset_id, greatest(duration_sec, 1e0) AS u, greatest(4, least(10, (ceil(greatest(duration_sec, 1e0) / 8) + 2)::INT)) AS n FROM assets)
SELECT asset_id, (i - 1)::INT AS pos, {r('i * (u / (n + 1))', 3)} AS t FROM n, range(1, 11) x(i) WHERE i <= n"""

# Near duplicates.
BINS = f"""{AUDIO}, h0 AS (SELECT asset_id, floor(t / 216000)::INT AS seg, least(floor(rms * 256), 255)::INT AS bin, greatest(1, floor(rms * 10))::BIGINT AS w FROM audio),
tot AS (SELECT asset_id, seg, sum(w)::BIGINT AS total, count(*) AS n FROM h0 GROUP BY ALL), bins AS (SELECT asset_id, seg, bin, floor((sum(w)::BIGINT * 256 * any_value(n))::DOUBLE / any_value(total))::BIGINT AS weight FROM h0 JOIN tot USING (asset_id, seg) GROUP BY ALL)"""
ORACLES["histogram_join"] = f"""WITH {BINS}, mass AS (SELECT asset_id, seg, sum(weight) AS m FROM bins GROUP BY ALL), p AS (SELECT x.asset_id, x.seg AS a, y.seg AS b, sum(least(x.weight, y.weight)) AS c FROM bins x JOIN bins y ON x.asset_id = y.asset_id AND x.bin = y.bin AND x.seg <> y.seg GROUP BY ALL),
z AS (SELECT p.asset_id, a, b, {r('c::DOUBLE / m', 6)} AS similarity FROM p JOIN mass ON mass.asset_id = p.asset_id AND mass.seg = p.a) SELECT * FROM z WHERE similarity >= 0.35e0"""
ORACLES["histogram_similarity"] = f"""WITH {BINS}, mass AS (SELECT asset_id, seg, sum(weight) AS m FROM bins GROUP BY ALL), p AS (SELECT x.asset_id, x.seg AS a, y.seg AS b, sum(least(x.weight, y.weight)) AS c FROM bins x JOIN bins y ON x.asset_id = y.asset_id AND x.bin = y.bin AND x.seg <> y.seg GROUP BY ALL)
SELECT p.asset_id, a, b, {r('c::DOUBLE / m', 6)} AS similarity FROM p JOIN mass ON mass.asset_id = p.asset_id AND mass.seg = p.a"""
VPAIRS = f"un AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS embedding FROM embeddings), vp AS (SELECT x.vec_id AS a, y.vec_id AS b, {r('list_dot_product(x.embedding, y.embedding)', 6)} AS cosine FROM un x JOIN un y ON x.vec_id < y.vec_id), pairs AS (SELECT * FROM vp WHERE cosine >= 0.4e0)"
ORACLES["vector_pairs"] = f"WITH {VPAIRS} SELECT a, b, {r('cosine')} AS cosine FROM pairs"
ORACLES["vector_components"] = f"""WITH RECURSIVE {VPAIRS}, ed AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT DISTINCT a AS node, a AS other FROM ed UNION SELECT reach.node, ed.b FROM reach JOIN ed ON ed.a = reach.other),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT node AS vec_id, component, (dense_rank() OVER (ORDER BY component))::INT AS vector_group, row_number() OVER (PARTITION BY component ORDER BY label DESC, node) > 1 AS deduplicated FROM comp JOIN embeddings ON vec_id = node"""

# Text, names, media.
ORACLES["prompt_fit"] = f"""WITH k AS (SELECT unnest(['erthing', 'moves', 'ntion', 'reblen', 'src1', 'thand']) AS w), t AS (SELECT doc_id, list_sort(list(w) FILTER (contains(lower(concat_ws(' ', text, source, lang, CASE WHEN doc_id % 3 = 0 THEN 'moves waits' END)), w))) AS terms FROM documents, k GROUP BY doc_id, text, source, lang)
SELECT doc_id, coalesce(len(terms), 0)::INT AS n_terms, {r(f'least({d(0.08)}, {d(0.02)} * coalesce(len(terms), 0))')} AS score, coalesce(array_to_string(terms[1:3], '|'), '') AS first_terms FROM t"""
ORACLES["parsed_fields"] = f"""WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, {r("k::DOUBLE / nullif(event_id % 4, 0)", 6)} AS ratio, CASE WHEN event_id % 7 > 1 THEN {r("k::DOUBLE", 6)} END AS number, {r(clamp("('0.0' || k)::DOUBLE"))} AS metric FROM e"""
_u = lambda key, label: f"(('0x' || substr(md5({key}::VARCHAR || ':' || printf('%.3f', t) || ':{label}'), 1, 8))::BIGINT / 4294967295e0)"
_SEEDED = {"sharpness": ("id", "sharpness", 0.48, 0.42), "contrast": ("name", "contrast", 0.42, 0.42), "brightness": ("src", "brightness", 0.38, 0.36), "motion_energy": ("prox", "motion", 0.25, 0.55), "distinctiveness": ("prox", "distinctive", 0.28, 0.58), "center_focus": ("id", "center", 0.4, 0.42)}
ORACLES["hash_unit"] = f"""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_type AS src, p_brand AS prox, greatest(p_size::DOUBLE, 1e0) AS u FROM part), n AS (SELECT *, greatest(4, least(10, (ceil(u / 8) + 2)::INT)) AS n FROM p),
g AS (SELECT *, {r('i * (u / (n + 1))', 3)} AS t FROM n, range(1, 11) x(i) WHERE i <= n), v AS (SELECT id AS asset_id, t AS timestamp_sec, {', '.join(f'{r(f"{d(b)} + {d(w)} * {_u(k, lab)}")} AS {c}' for c, (k, lab, b, w) in _SEEDED.items())} FROM g)
SELECT *, {r(clamp(f'{d(0.26)} * sharpness + {d(0.16)} * contrast + {d(0.22)} * motion_energy + {d(0.2)} * distinctiveness + {d(0.16)} * center_focus'))} AS score FROM v"""
MEDIA = """md AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN '/media/Originals/' || p_partkey || '/' || replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '-') || '.' || CASE WHEN p_partkey % 3 = 0 THEN 'mov' ELSE 'mp4' END
  ELSE '/media/Proxy/' || p_partkey || '/' || replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '-') || '_proxy.mp4' END AS path FROM part),
mn AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'source' ELSE 'proxy' END AS role, split_part(split_part(path, '/', 5), '.', 1) AS stem, split_part(path, '.', 2) AS ext FROM md),
mk AS (SELECT *, upper(regexp_replace(regexp_replace(stem, '_proxy$', ''), '[^A-Za-z0-9]+', '', 'g')) AS clip_key, p_size::DOUBLE AS dur, CASE WHEN p_size % 5 <> 0 THEN p_size % 4 + 22e0 END AS fps FROM mn)"""
ORACLES["media_names"] = f"""WITH {MEDIA} SELECT p_partkey, role, clip_key, array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(stem, '[_-]+', ' ', 'g')), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title,
trim(regexp_replace(lower(stem), '[^a-z0-9]+', '-', 'g'), '-') AS slug, ext, true AS is_video FROM mk"""
ORACLES["proxy_match"] = f"""WITH {MEDIA}, p AS (SELECT s.path AS sp, x.path AS pp, least(1e0, {d(0.4)} + {d(0.35)} + CASE WHEN contains(lower(x.stem), lower(s.stem)) OR contains(lower(s.stem), lower(x.stem)) THEN {d(0.1)} ELSE 0e0 END + CASE WHEN s.ext = x.ext THEN {d(0.05)} ELSE 0e0 END
  + CASE WHEN abs(s.dur - x.dur) < 0.2e0 THEN {d(0.1)} ELSE 0e0 END + CASE WHEN abs(s.fps - x.fps) < 0.2e0 THEN {d(0.05)} ELSE 0e0 END) AS score FROM mk s JOIN mk x ON s.clip_key = x.clip_key AND s.role = 'source' AND x.role = 'proxy'),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY sp ORDER BY score DESC, pp) = 1)
SELECT sp AS source_path, pp AS proxy_path, {r('score', 2)} AS confidence, CASE WHEN score >= 0.85e0 THEN 'strong' WHEN score >= 0.7e0 THEN 'likely' WHEN score >= 0.55e0 THEN 'possible' ELSE 'weak' END AS reason FROM b
UNION ALL SELECT path, NULL, 1e0, 'source-only' FROM mk WHERE role = 'source' AND path NOT IN (SELECT sp FROM b)
UNION ALL SELECT path, path, {d(0.45)}, 'proxy-only' FROM mk WHERE role = 'proxy' AND clip_key NOT IN (SELECT clip_key FROM mk WHERE role = 'source')"""

# Evaluation and history.
CHECKS = """ob AS (SELECT lang, source, sum(quality)::DOUBLE AS value FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
ex AS (SELECT DISTINCT lang, source, 2e0 AS "min", CASE WHEN lang = 'en' THEN 12e0 END AS "max", CASE WHEN source = 'src3' THEN 3e0 END AS exact FROM documents),
ck AS (SELECT ex.lang, ex.source, "min", "max", exact, value, coalesce(value >= "min", false) AND ("max" IS NULL OR coalesce(value <= "max", false)) AND (exact IS NULL OR coalesce(value = exact, false)) AS passed FROM ex LEFT JOIN ob USING (lang, source))"""
ORACLES["expectation_checks"] = f"WITH {CHECKS} SELECT * FROM ck"
ORACLES["expectation_totals"] = f"WITH {CHECKS} SELECT lang, count(*) AS checks, count(*) FILTER (passed) AS passed, bool_and(passed) AS all_passed FROM ck GROUP BY lang"
ORACLES["dataset_fingerprint"] = "WITH t AS (SELECT p_brand, list_sort(list(DISTINCT p_name)) AS t FROM part GROUP BY p_brand) SELECT p_brand, len(t)::INT AS n, substr(md5(array_to_string(t, '|') || '|' || len(t)), 1, 12) AS fingerprint FROM t"
ORACLES["history_compare"] = f"""WITH h AS (SELECT o_orderkey AS run_id, o_totalprice AS v, o_orderstatus AS mode, lag(o_totalprice) OVER w AS b, lag(o_orderstatus) OVER w AS mb FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_orderkey % 100 ORDER BY o_orderdate, o_orderkey))
SELECT run_id, {r('v - b', 3)} AS delta, {r('(v - b) * 100 / b', 1)} AS delta_pct, CASE WHEN mode <> mb THEN 'mode' ELSE '' END AS changed FROM h WHERE b IS NOT NULL"""
ORACLES["last_match"] = "SELECT o_orderkey AS run_id, o_orderpriority AS dataset_fingerprint, o_totalprice AS total_runtime_sec FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1"
ORACLES["timecodes"] = """WITH e AS (SELECT event_id, strftime(ts, '%H:%M:%S') AS c, extract('hour' FROM ts) * 3600e0 + extract('minute' FROM ts) * 60 + floor(extract('second' FROM ts)) AS s, floor(value * 20)::BIGINT AS k FROM events)
SELECT event_id, c || ':00' AS timecode, s AS seconds, CASE WHEN k < 3600 THEN '' ELSE lpad((k // 3600)::VARCHAR, 2, '0') || ':' END || lpad((k % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0') AS clock FROM e"""


# Greedy folds, one row after the other.
def _kept(p: str, src: str, most: float, limit: int | None = None) -> str:
    """{p}kept: asset_id, k (place among the kept), i, s, e of the rows of src (asset_id, i from 1, s, e) that keep apart."""
    over = "least(x.e, q.e) - greatest(x.s, q.s)"
    clash = f"len(list_filter(f.kept, lambda x: CASE WHEN {over} > 0 THEN coalesce(({over}) / nullif(least(x.e - x.s, q.e - q.s), 0e0), 0e0) ELSE 0e0 END >= {d(most)})) > 0"
    full = f"len(f.kept) >= {limit} OR " if limit else ""
    return f"""{p}f AS (SELECT asset_id, 0::BIGINT AS i, []::STRUCT(i BIGINT, s DOUBLE, e DOUBLE)[] AS kept FROM (SELECT DISTINCT asset_id FROM {src})
  UNION ALL SELECT f.asset_id, q.i, CASE WHEN {full}{clash} THEN f.kept ELSE list_append(f.kept, {{'i': q.i, 's': q.s, 'e': q.e}}) END FROM {p}f f JOIN {src} q ON q.asset_id = f.asset_id AND q.i = f.i + 1),
{p}kept AS (SELECT asset_id, x.i AS i, x.s AS s, x.e AS e, (k - 1)::INT AS k FROM (SELECT asset_id, unnest(kept) AS x, unnest(range(1, len(kept) + 1)) AS k FROM (SELECT asset_id, arg_max(kept, i) AS kept FROM {p}f GROUP BY asset_id)))"""


ORACLES["peak_windows"] = f"""WITH RECURSIVE {AUDIO}, p0 AS (SELECT asset_id, rms, {r('t / 60000', 3)} AS t FROM audio WHERE NOT silent AND rms >= {d(0.05)}),
p1 AS (SELECT *, greatest(0e0, t - 5.4e0 / 2) AS a0 FROM p0), p2 AS (SELECT asset_id, rms, t, {r('a0', 3)} AS s, {r('least(43.2e0, a0 + 5.4e0)', 3)} AS e FROM p1),
p3 AS (SELECT asset_id, s, e, row_number() OVER (PARTITION BY asset_id ORDER BY rms DESC, t, s, e) AS i FROM p2 WHERE e - s >= 1.5e0), {_kept('p', 'p3', 0.7, 3)}
SELECT asset_id, k AS pos, s AS start_sec, e AS end_sec FROM pkept"""
ORACLES["seed_dedupe"] = f"""WITH RECURSIVE {SPANS_E}, d0 AS (SELECT asset_id, {r('s / 60000', 3)} AS s, {r('s / 60000 + 1 + event_id % 5', 3)} AS e FROM es),
d1 AS (SELECT asset_id, {r('greatest(0e0, s)', 3)} AS s, {r('least(e, 43.2e0)', 3)} AS e FROM d0), d2 AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY {r('e - s', 3)}, s, e) AS i FROM d1 WHERE e - s >= 1), {_kept('d', 'd2', 0.9)}
SELECT asset_id, s AS start_sec, e AS end_sec FROM dkept"""

_ACLIP = "ac AS (SELECT asset_id, event_id % 40 + 0.5e0 AS t, max(rms) AS rms, bool_and(silent) AS silent FROM audio GROUP BY ALL)"
_SEED_LEN = "greatest(1.5e0, least(6e0, e - s))"


def refinement(said: str, heard: str) -> str:
    """x0 to rkept and fine: seeds sd (asset_id, dur, seed, s, e, c) refined and kept apart, of the spans and sound rows that pass."""
    return f"""x0 AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY asset_id ORDER BY s, e) <= {d(0.9)} THEN 0 ELSE 1 END AS o FROM sp WHERE {said}), x1 AS (SELECT *, sum(o) OVER (PARTITION BY asset_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM x0),
x2 AS (SELECT asset_id, k, min(s) AS a, max(e) AS b, string_agg(trim(text), ' ' ORDER BY s, e, trim(text)) AS text FROM x1 GROUP BY ALL), x3 AS (SELECT *, {_ASK} AS q FROM x2),
x4 AS (SELECT *, lead(a) OVER w AS na, lead(b) OVER w AS nb, coalesce(lead(q) OVER w, false) AS nq FROM x3 WINDOW w AS (PARTITION BY asset_id ORDER BY a, b)),
x5 AS (SELECT sd.asset_id, seed, min(a) AS a, max(b) AS b, count(*) AS n, max({{'a': a, 'b': b, 'q': q, 'na': na, 'nb': nb, 'nq': nq}}) AS l FROM sd JOIN x4 ON x4.asset_id = sd.asset_id AND b >= s - 0.75e0 AND a <= e + 0.75e0 GROUP BY ALL),
tr AS (SELECT asset_id, seed, a, CASE WHEN coalesce((l.q AND NOT l.nq AND l.na - l.b <= 1.6e0) OR (n = 1 AND NOT l.q AND NOT l.nq AND l.na - l.b <= {d(0.95)}), false) THEN greatest(b, l.nb) ELSE b END AS b FROM x5),
y0 AS (SELECT *, NOT silent AND rms >= {d(0.05)} AS loud FROM ac WHERE {heard}), y1 AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY t) - row_number() OVER (PARTITION BY asset_id, loud ORDER BY t) AS run, t - lag(t) OVER (PARTITION BY asset_id ORDER BY t) AS g FROM y0),
y2 AS (SELECT asset_id, coalesce(avg(g), 1e0) AS step FROM y1 GROUP BY ALL), y3 AS (SELECT asset_id, run, min(t) AS a, max(t) AS b FROM y1 WHERE loud GROUP BY ALL),
y4 AS (SELECT sd.*, greatest(0e0, a - step / 2) AS a, least(dur, b + step / 2) AS b FROM sd JOIN y2 USING (asset_id) JOIN y3 USING (asset_id) QUALIFY row_number() OVER (PARTITION BY asset_id, seed ORDER BY greatest(a - c, c - b, 0e0), a) = 1),
au AS (SELECT asset_id, seed, {r('a', 3)} AS a, {r('b', 3)} AS b FROM y4 WHERE b - a >= 1 AND abs((a + b) / 2 - c) <= 2),
z0 AS (SELECT sd.*, a, b, (a <= c AND c <= b)::INT AS holds, greatest(0e0, least(e, b) - greatest(s, a)) AS lap, pos FROM sd JOIN scenes USING (asset_id)),
sc AS (SELECT * FROM (SELECT * FROM z0 QUALIFY row_number() OVER (PARTITION BY asset_id, seed ORDER BY holds DESC, CASE WHEN holds = 1 THEN 0e0 ELSE -lap END, pos) = 1) WHERE holds = 1 OR lap > 0),
du AS (SELECT asset_id, seed, {r(f'greatest(0e0, c - {_SEED_LEN} / 2)', 3)} AS a, {r(f'least(dur, c + {_SEED_LEN} / 2)', 3)} AS b FROM sd),
fine AS (SELECT du.asset_id, du.seed, CASE WHEN tr.b - tr.a >= 1 THEN {{'a': tr.a, 'b': tr.b, 'st': 'turn-snap', 'cf': {d(0.93)}}} WHEN au.seed IS NOT NULL THEN {{'a': au.a, 'b': au.b, 'st': 'audio-snap', 'cf': {d(0.74)}}}
  WHEN sc.seed IS NOT NULL AND sc.b - sc.a <= 8 THEN {{'a': sc.a, 'b': sc.b, 'st': 'scene-snap', 'cf': {d(0.62)}}} ELSE {{'a': du.a, 'b': du.b, 'st': CASE WHEN sc.seed IS NOT NULL THEN 'scene-duration' ELSE 'duration-rule' END, 'cf': {d(0.48)}}} END AS x
  FROM du LEFT JOIN tr USING (asset_id, seed) LEFT JOIN au USING (asset_id, seed) LEFT JOIN sc USING (asset_id, seed)),
ro AS (SELECT asset_id, seed, x.a AS s, x.b AS e, x.st AS st, x.cf AS cf, row_number() OVER (PARTITION BY asset_id ORDER BY -x.cf, -(x.b - x.a), seed) AS i FROM fine), {_kept('r', 'ro', 0.9)}"""


ORACLES["seed_refinement"] = f"""WITH RECURSIVE {ASSETS}, {SCENES('assets', 'asset_id', 'duration_sec')}, {AUDIO}, {_ACLIP}, {CONV},
sd AS (SELECT asset_id, duration_sec AS dur, i::INT AS seed, i * 3e0 AS s, least(i * 3e0 + 4, duration_sec) AS e, (i * 3e0 + least(i * 3e0 + 4, duration_sec)) / 2 AS c FROM assets, range(0, 4) x(i) WHERE i * 3e0 < least(i * 3e0 + 4, duration_sec)),
{refinement('asset_id % 3 = 0', 'asset_id % 3 <> 1 AND t >= 3')}
SELECT ro.asset_id, ro.seed AS seed_id, ro.s AS start_sec, ro.e AS end_sec, st AS boundary_strategy, cf AS boundary_confidence FROM ro JOIN rkept USING (asset_id, i)"""

ORACLES["leader_dedup"] = f"""WITH RECURSIVE {BINS}, mass AS (SELECT asset_id, seg, sum(weight) AS m FROM bins GROUP BY ALL), sim AS (SELECT x.asset_id, x.seg AS a, y.seg AS b, sum(least(x.weight, y.weight)) AS c FROM bins x JOIN bins y ON x.asset_id = y.asset_id AND x.bin = y.bin AND x.seg <> y.seg GROUP BY ALL),
near AS (SELECT sim.asset_id, a, b FROM sim JOIN mass ON mass.asset_id = sim.asset_id AND mass.seg = sim.a WHERE {r('c::DOUBLE / m', 6)} >= {d(0.35)}),
pl AS (SELECT asset_id, seg, row_number() OVER (PARTITION BY asset_id ORDER BY m DESC, seg) AS i FROM mass),
bf AS (SELECT pl.asset_id, pl.seg, pl.i, list_sort(list(q.i) FILTER (q.i < pl.i)) AS before FROM pl LEFT JOIN near ON near.asset_id = pl.asset_id AND near.b = pl.seg LEFT JOIN pl q ON q.asset_id = near.asset_id AND q.seg = near.a GROUP BY ALL),
ld AS (SELECT asset_id, 0::BIGINT AS i, []::BIGINT[] AS lead, 0::BIGINT AS leader FROM (SELECT DISTINCT asset_id FROM pl)
  UNION ALL SELECT ld.asset_id, bf.i, CASE WHEN len(list_filter(coalesce(before, []), lambda x: list_contains(lead, x))) > 0 THEN lead ELSE list_append(lead, bf.i) END, coalesce(list_filter(coalesce(before, []), lambda x: list_contains(lead, x))[1], bf.i) FROM ld JOIN bf ON bf.asset_id = ld.asset_id AND bf.i = ld.i + 1)
SELECT ld.asset_id, bf.seg AS segment_id, q.seg AS leader, (dense_rank() OVER (PARTITION BY ld.asset_id ORDER BY ld.leader) - 1)::INT AS dedup_group, bf.seg <> q.seg AS deduplicated FROM ld JOIN bf USING (asset_id, i) JOIN pl q ON q.asset_id = ld.asset_id AND q.i = ld.leader"""

_unit = lambda x: f"floor(({x}) * 1e4 + 0.5e0)::BIGINT"
_if = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE 0e0 END"
_SPEECH_TURN = f"coalesce(speech_ratio, 0e0) >= {d(0.85)}"
ORACLES["story_sequence"] = f"""WITH RECURSIVE {TAKES},
b0 AS (SELECT *, asset_id % 50 AS scope, row_number() OVER (PARTITION BY asset_id % 50 ORDER BY asset_id, within_asset_rank) AS pos2, (segment_id % 5) * {d(0.02)} AS fit, {_z('visual_novelty')} AS nov, {_z('motion_energy')} AS mot, {_z('subject_clarity')} AS cla, count(*) OVER (PARTITION BY asset_id % 50) AS n FROM takes WHERE is_selected),
b1 AS (SELECT scope, pos2 AS p, take_id, n, NOT speech AS vis, score_total >= 0.75e0 AS strong, score_total AS tot, CASE WHEN speech THEN 'spoken beat' WHEN nov >= 0.8e0 AND mot >= 0.7e0 THEN 'dynamic' WHEN mot < 0.45e0 THEN 'calm' WHEN cla >= 0.8e0 THEN 'clear detail' ELSE 'transition-ready' END AS role,
  {_unit(f"score_total + fit + {_if('coalesce(hook_strength, 0e0) >= 0.7e0', d(0.03))} + CASE WHEN NOT speech THEN {d(0.09)} + {_if('nov >= 0.7e0', d(0.04))} + {_if('fit > 0', d(0.02))} ELSE {d(0.03)} - {_if(chr(39) * 2 + ' = trim(transcript_excerpt)', d(0.03))} END")} AS os,
  {_unit(f"score_total + least({d(0.05)}, fit) + {_if('coalesce(story_alignment, 0e0) >= 0.7e0', d(0.03))} + CASE WHEN NOT speech THEN {d(0.08)} + {_if('mot <= 0.55e0', d(0.04))} ELSE {_if(_SPEECH_TURN, d(0.03))} END")} AS rs,
  {_unit(f"score_total + least({d(0.06)}, fit) + {_if('speech AND ' + _SPEECH_TURN, d(0.02))}")} AS fs FROM b0),
op AS (SELECT scope, p, CASE WHEN n = 1 THEN {_unit('tot')} ELSE os END AS sc FROM b1 QUALIFY row_number() OVER (PARTITION BY scope ORDER BY os DESC, p) = 1),
re AS (SELECT b1.scope, b1.p, rs AS sc, n FROM b1 JOIN op ON op.scope = b1.scope AND op.p <> b1.p WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY b1.scope ORDER BY vis DESC, rs DESC, b1.p) = 1),
st AS (SELECT b1.scope, b1.p, op.sc, 0 AS i, vis AS v1, role AS r1, vis AS v2, role AS r2, strong AS s1, list_append([b1.p], coalesce(re.p, -1)) AS used FROM op JOIN b1 USING (scope, p) LEFT JOIN re ON re.scope = op.scope
  UNION ALL (SELECT scope, p, sc, i, vis, role, v1, r1, strong, list_append(used, p) FROM (SELECT st.scope, b1.p, st.i + 1 AS i, vis, role, v1, r1, strong, used,
    fs + CASE WHEN vis <> v1 THEN CASE WHEN vis THEN 1300 ELSE 1200 END ELSE -400 END + CASE WHEN role <> r1 THEN 400 ELSE -300 END + CASE WHEN strong AND s1 THEN 100 ELSE 0 END - CASE WHEN vis = v1 AND vis = v2 THEN 500 ELSE 0 END - CASE WHEN role = r1 AND role = r2 THEN 400 ELSE 0 END AS sc
    FROM st JOIN b1 ON b1.scope = st.scope AND NOT list_contains(used, b1.p)) QUALIFY row_number() OVER (PARTITION BY scope ORDER BY sc DESC, p) = 1))
SELECT scope, take_id, i::INT AS order_index, sc / 1e4 AS sequence_score FROM (SELECT scope, p, sc, i FROM st UNION ALL SELECT scope, p, sc, n - 1 FROM re) JOIN b1 USING (scope, p)"""


from . import field_oracles  # noqa: E402, F401  (adds the SQL of derived columns)
from . import source_oracles  # noqa: E402, F401
