"""DuckDB SQL for the queries of what is detected, decoded, written and read."""

from __future__ import annotations

from . import oracles as o
from .field_oracles import LABELLED, _cnt, _has
from .oracles import ORACLES, clamp, d, r

ORACLES["scene_cuts"] = f"""WITH RECURSIVE {o.AUDIO}, cl AS (SELECT asset_id, floor(max(t)) + 7200e0 AS dur FROM audio GROUP BY asset_id),
fr AS (SELECT asset_id, t, rms, row_number() OVER (PARTITION BY asset_id ORDER BY t, rms) AS i FROM audio), un AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE floor(rms * 1e4 + 0.5e0)::BIGINT END AS u FROM fr),
nb AS (SELECT *, sum(u) OVER w - u AS s, count(*) OVER w - 1 AS n FROM un WINDOW w AS (PARTITION BY asset_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
cand AS (SELECT asset_id, t FROM nb JOIN cl USING (asset_id) WHERE u >= 2000 AND n > 0 AND u * n * 100 >= 150 * s AND dur - t >= 3600),
cuts AS (SELECT asset_id, 0e0 AS a, 0 AS k FROM cl UNION ALL SELECT asset_id, a, k FROM (SELECT c.asset_id, min(x.t) AS a, c.k + 1 AS k FROM cuts c JOIN cand x ON x.asset_id = c.asset_id AND x.t - c.a >= 3600 GROUP BY c.asset_id, c.k)),
own AS (SELECT asset_id, k AS pos, a, coalesce(lead(a) OVER (PARTITION BY asset_id ORDER BY k), dur) AS b, count(*) OVER (PARTITION BY asset_id) AS n FROM cuts JOIN cl USING (asset_id)),
rest AS (SELECT cl.asset_id, cl.dur FROM cl JOIN own ON own.asset_id = cl.asset_id AND own.n = 1), {o.SCENES('rest', 'asset_id', 'dur')}
SELECT asset_id, pos, a AS start_sec, b AS end_sec FROM own WHERE n > 1 UNION ALL SELECT asset_id, pos, a, b FROM scenes"""

_sum = lambda lst, test, value: f"list_sum(list_transform(list_filter({lst}, lambda i: {test}), lambda i: {value}))"
_spread = lambda n, s, q: f"sqrt(({n} * {q} - {s} * {s})::DOUBLE) / (255 * {n})"
ORACLES["frame_measures"] = f"""WITH p AS (SELECT label AS asset_id, vec_id, list_transform(embedding::DOUBLE[], lambda x: greatest(0, least(255, floor((x + 1) * 127.5e0)::BIGINT))) AS px FROM embeddings),
q AS (SELECT *, range(1, 65) AS ix, lag(px) OVER (PARTITION BY asset_id ORDER BY vec_id) AS bx FROM p),
c AS (SELECT *, list_filter(ix, lambda i: (i - 1) // 8 BETWEEN 2 AND 5 AND (i - 1) % 8 BETWEEN 2 AND 5) AS cx FROM q),
m AS (SELECT asset_id, vec_id, {_sum('ix', 'i % 8 <> 0', 'abs(px[i + 1] - px[i])')} + {_sum('ix', 'i <= 56', 'abs(px[i + 8] - px[i])')} AS steps, list_sum(px) AS s, list_sum(list_transform(px, lambda x: x * x)) AS s2,
  list_sum(list_transform(cx, lambda i: px[i])) AS c1, list_sum(list_transform(cx, lambda i: px[i] * px[i])) AS c2, CASE WHEN bx IS NOT NULL THEN list_sum(list_transform(ix, lambda i: abs(px[i] - bx[i]))) END AS moved FROM c),
v AS (SELECT asset_id, vec_id::DOUBLE AS timestamp_sec, {r(clamp(f'steps::DOUBLE / (255 * 112) * {d(3.2)}'))} AS sharpness, {r(clamp(f'{_spread(64, "s", "s2")} * {d(2.4)}'))} AS contrast, {r(clamp('s::DOUBLE / (255 * 64)'))} AS brightness,
  {r(clamp(f'coalesce(moved::DOUBLE / (255 * 64) * {d(3.4)}, {d(0.32)})'))} AS motion_energy, {r(clamp(f'coalesce(moved::DOUBLE / (255 * 64) * 3e0, {d(0.32)})'))} AS distinctiveness, {r(clamp(f'{_spread(16, "c1", "c2")} * 2e0'))} AS center_focus FROM m)
SELECT *, {r(clamp(f'{d(0.26)} * sharpness + {d(0.16)} * contrast + {d(0.22)} * motion_energy + {d(0.2)} * distinctiveness + {d(0.16)} * center_focus'))} AS score FROM v"""

ORACLES["timeline_documents"] = f"""WITH {o.ITEMS}, f AS (SELECT scope, order_index::INT AS pos, label AS name, CASE WHEN asset_id % 9 > 0 THEN 'reel-' || asset_id % 9 ELSE asset_name END AS asset_uid, start_sec AS s, greatest(0e0, len) AS len,
  {r('coalesce(sum(greatest(0e0, len)) OVER (PARTITION BY scope ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)', 3)} AS off, asset_id % 6 * 60 + 10 + asset_id % 10 + (asset_id % 8) / 24e0 AS base FROM items)
SELECT scope, pos, name, asset_uid, {r('off', 6)} AS offset_sec, {r('base + s', 6)} AS start_sec, {r('len', 6)} AS duration_sec FROM f"""

ORACLES["project_documents"] = f"""WITH {o.SEGMENTS} SELECT a.asset_id AS project_id, a.asset_name AS project_name, 'the "story" of' || chr(10) || a.asset_name AS story_summary, a.duration_sec, '00:00:00:00' AS source_timecode, true AS has_proxy,
's' || segment_id AS segment, (pos - 1)::INT AS pos, (pos - 1)::INT AS take_pos, start_sec, end_sec, transcript_excerpt, sharpness, stability, pos = 1 AS is_best_take, prefilter_score AS score_total FROM assets a LEFT JOIN seg USING (asset_id)"""

ORACLES["run_history"] = """WITH x AS (SELECT o_orderpriority || ' ' || extract('year' FROM o_orderdate) AS run_id, extract('year' FROM o_orderdate)::INT AS year, count(*) AS n_orders, max(o_totalprice) AS total_runtime_sec FROM orders GROUP BY ALL)
SELECT run_id, year, n_orders, total_runtime_sec, CASE WHEN year % 2 = 0 THEN 'story' END AS fixture_set, CASE WHEN year % 2 = 0 THEN n_orders % 2 = 0 END AS passed FROM x"""

_FIELDS = "['media_path', 'transcript_excerpt', 'story_prompt', 'analysis_mode', 'transcript_status', 'speech_mode_source', 'keyframe_sec', 'context_start', 'context_end', 'metrics', 'keyframe_max_width']"
ORACLES["evidence_fields"] = f"""WITH {o.SEGMENTS}, e AS (SELECT *, greatest(end_sec - start_sec, 0e0) AS len, {r('coalesce(lag(start_sec) OVER w, start_sec)', 3)} AS context_start, {r('coalesce(lead(end_sec) OVER w, end_sec)', 3)} AS context_end FROM seg WINDOW w AS (PARTITION BY asset_id ORDER BY pos))
SELECT segment_id, context_start, context_end, array_to_string(list_transform([1, 2, 3], lambda i: {r('start_sec + (len / 4) * i', 3)}::VARCHAR), '|') AS keyframes, CASE WHEN segment_id % 13 < 11 THEN {_FIELDS}[(segment_id % 13 + 1)::INT] ELSE '' END AS differs, segment_id % 13 = 11 AS reused FROM e"""

_MOVED = lambda trim, extend: f"CASE dc WHEN 'trim' THEN {trim} WHEN 'extend' THEN {extend} END"
ORACLES["boundary_payloads"] = f"""WITH {o.DOUBT}, a AS (SELECT segment_id, segment_id % 7 AS n, start_sec AS s, end_sec AS e, duration_sec AS dur, CASE WHEN segment_id % 7 < 4 THEN (segment_id % 10) / 10e0 ELSE 0e0 END AS conf,
  {r(f'greatest(0.25e0, least(0.75e0, {d(0.12)} * greatest(0e0, end_sec - start_sec)))', 3)} AS dt FROM doubt),
b AS (SELECT *, CASE WHEN n < 2 THEN 'trim' WHEN n = 2 THEN 'extend' WHEN n = 3 AND conf >= {d(0.85)} THEN 'split' ELSE 'keep' END AS dc FROM a)
SELECT segment_id, CASE WHEN n = 4 THEN '1' END AS salvaged, n < 5 AS answered, CASE WHEN n < 2 THEN 'late start' WHEN n = 3 THEN 'two: parts' END AS reason, dc AS decision, {r('conf')} AS confidence,
{r(_MOVED('1.5e0', 'greatest(0e0, s - dt)'), 3)} AS new_start, {r(_MOVED('greatest(least(e - 1.5e0, s + dt) + 1.5e0, e - dt)', 'least(dur, e + dt)'), 3)} AS new_end, CASE WHEN dc = 'split' THEN {r('(s + e) / 2', 3)} END AS split_at FROM b"""

_N = "segment_id"
_COUNTS = {
    "candidate_segment_count": "true", "deduplicated_segment_count": f"{_N} % 13 = 0", "dedup_eliminated_count": f"{_N} % 13 = 0 AND {_N} % 7 <> 0", "prefilter_shortlisted_count": f"{_N} % 7 <> 0", "vlm_target_count": f"{_N} % 3 = 0 AND {_N} % 7 <> 0",
    "filtered_before_vlm_count": f"{_N} % 7 = 0", "transcript_excerpt_segment_count": "trim(transcript_excerpt) <> ''", "speech_fallback_segment_count": "speech AND trim(transcript_excerpt) = ''", "clip_scored_count": f"{_N} % 5 <> 0 AND visual_novelty IS NOT NULL",
    "clip_gated_count": f"{_N} % 11 = 0", "semantic_boundary_eligible_count": f"ambiguity >= {d(0.6)}", "semantic_boundary_request_count": f"{_N} % 4 < 2", "semantic_boundary_validated_count": f"{_N} % 4 = 0", "semantic_boundary_skipped_count": f"{_N} % 4 = 2",
    "semantic_boundary_fallback_count": f"{_N} % 4 = 1", "semantic_boundary_threshold_targeted_count": f"{_N} % 4 = 0", "semantic_boundary_floor_targeted_count": f"{_N} % 4 = 1", "semantic_boundary_applied_count": f"{_N} % 8 = 0", "semantic_boundary_noop_count": f"{_N} % 8 = 4",
    "ai_live_segment_count": f"{_N} % 3 = 0", "ai_cached_segment_count": f"{_N} % 3 = 1", "ai_fallback_segment_count": f"{_N} % 3 = 2", "speech_structure_segment_count": f"{_N} % 3 < 2", "speech_structure_question_answer_count": f"{_N} % 3 = 0", "speech_structure_monologue_count": f"{_N} % 3 = 1",
}
_ASSETS = {
    "asset_count": "true", "audio_signal_asset_count": "asset_id % 3 <> 0", "audio_silent_asset_count": "asset_id % 3 = 0", "transcript_target_asset_count": "asset_id % 2 = 0", "transcript_skipped_asset_count": "asset_id % 5 = 1", "transcript_probed_asset_count": "asset_id % 4 = 0",
    "transcript_probe_rejected_asset_count": "asset_id % 8 = 0", "transcribed_asset_count": "asset_id % 6 = 0", "transcript_failed_asset_count": "asset_id % 50 = 0", "transcript_cached_asset_count": "asset_id % 12 = 0", "transcript_runtime_probed_asset_count": "asset_id % 4 = 0",
    "transcript_runtime_probe_rejected_asset_count": "asset_id % 8 = 0", "deterministic_preprocessing_cache_hit_asset_count": "asset_id % 7 <> 0", "deterministic_preprocessing_cache_rebuilt_asset_count": "asset_id % 7 = 0",
}
_many = lambda before, n, noun, after="": f"{before!r} || {n} || ' {noun}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END || {after!r}"
_mode = lambda fallbacks, skipped: f"CASE WHEN {fallbacks} > 0 THEN 'degraded' WHEN {skipped} > 0 THEN 'partial' ELSE 'active' END"
_MODES = ("ai_runtime_mode", "transcript_runtime_mode", "semantic_boundary_runtime_mode", "cache_runtime_mode")
_any = lambda status: " OR ".join(f"{m} = '{status}'" for m in _MODES)
SUMMARY = f"""{LABELLED}, {o.DOUBT[len(o.SCORED) + 2 :]},
c1 AS (SELECT {', '.join(f'{_cnt(t)} AS {n}' for n, t in _COUNTS.items())}, count(DISTINCT (asset_id, {_N} % 10)) FILTER ({_N} % 13 < 2 AND {_N} % 7 <> 0) AS dedup_group_count FROM doubt),
c2 AS (SELECT {', '.join(f'{_cnt(t)} AS {n}' for n, t in _ASSETS.items())} FROM assets), c3 AS (SELECT count(*) AS prefilter_sample_count FROM events),
it AS (SELECT lb.*, speech, lag(speech) OVER (ORDER BY lb.scope, lb.order_index) AS before FROM lb JOIN takes USING (take_id)),
c4 AS (SELECT count(*) > 1 AS story_assembly_active, 'sequence-heuristic-v2' AS story_assembly_strategy, greatest(count(*) - 1, 0) AS story_assembly_transition_count, count(*) FILTER (speech <> before) AS story_assembly_mode_alternation_count,
  count(DISTINCT order_index = 0) AS story_assembly_group_count, count(DISTINCT speech) AS story_assembly_role_count, {_has('prompt_fit')} AS story_assembly_prompt_fit_count, count(*) FILTER (tradeoffs <> '') AS story_assembly_tradeoff_count, {_has('repetition_control')} AS story_assembly_repetition_control_count FROM it),
c5 AS (SELECT *, semantic_boundary_validated_count = 0 AS semantic_boundary_dormant, 40e0 AS vlm_budget_cap_pct, vlm_target_count < prefilter_shortlisted_count * 40e0 / 100 AS vlm_budget_was_binding, coalesce(vlm_target_count::DOUBLE / nullif(candidate_segment_count, 0) * 100, 0e0) AS vlm_target_pct_of_candidates,
  'auto' AS transcript_provider_configured, 'local' AS transcript_provider_effective, 'ready' AS transcript_status, true AS transcript_available, true AS transcript_enabled, 'small' AS transcript_model_size, '' AS transcript_detail, 17::BIGINT AS ai_live_request_count,
  1195e0 AS per_asset_analysis_sec, 4.25e0 AS take_selection_sec, 1.75e0 AS timeline_assembly_sec, {_mode('transcript_failed_asset_count', 'transcript_skipped_asset_count + transcript_runtime_probe_rejected_asset_count')} AS transcript_runtime_mode,
  {_mode('semantic_boundary_fallback_count', 'semantic_boundary_skipped_count')} AS semantic_boundary_runtime_mode, CASE WHEN semantic_boundary_validated_count > 0 THEN 'active' ELSE 'inactive' END AS semantic_boundary_targeting_mode,
  CASE WHEN ai_live_segment_count + ai_cached_segment_count = 0 THEN 'inactive' ELSE {_mode('ai_fallback_segment_count', '(filtered_before_vlm_count + ai_cached_segment_count)')} END AS ai_runtime_mode, CASE WHEN ai_cached_segment_count > 0 THEN 'active' ELSE 'partial' END AS cache_runtime_mode FROM c1, c2, c3, c4),
sm AS (SELECT *, CASE WHEN {_any('unavailable')} THEN 'unavailable' WHEN {_any('degraded')} THEN 'degraded' WHEN {_any('partial')} THEN 'partial' WHEN {_any('active')} THEN 'active' ELSE 'inactive' END AS runtime_reliability_mode,
  'AI ' || ai_runtime_mode || ', transcript ' || transcript_runtime_mode || ', semantic ' || semantic_boundary_runtime_mode || ', cache ' || cache_runtime_mode AS runtime_reliability_summary,
  concat_ws('|', CASE WHEN transcript_failed_asset_count > 0 THEN {_many('transcript fallback on ', 'transcript_failed_asset_count', 'asset')} END, CASE WHEN semantic_boundary_fallback_count > 0 THEN {_many('semantic boundary fallback on ', 'semantic_boundary_fallback_count', 'segment')} END,
    CASE WHEN ai_fallback_segment_count > 0 THEN {_many('deterministic AI fallback on ', 'ai_fallback_segment_count', 'segment')} END) AS runtime_degraded_reasons,
  concat_ws('|', CASE WHEN transcript_skipped_asset_count + transcript_probe_rejected_asset_count > 0 THEN 'transcript targeting kept cost bounded: ' || concat_ws(', ', CASE WHEN transcript_skipped_asset_count > 0 THEN {_many('', 'transcript_skipped_asset_count', 'transcript-target skip')} END,
    CASE WHEN transcript_probe_rejected_asset_count > 0 THEN {_many('', 'transcript_probe_rejected_asset_count', 'probe rejection')} END) END, CASE WHEN semantic_boundary_skipped_count > 0 THEN {_many('semantic boundary validation skipped ', 'semantic_boundary_skipped_count', 'segment')} END,
    CASE WHEN filtered_before_vlm_count > 0 THEN {_many('AI analysis skipped ', 'filtered_before_vlm_count', 'segment', ' before live VLM')} END) AS runtime_intentional_skip_reasons FROM c5),
su AS (SELECT *, runtime_reliability_mode NOT IN ('unavailable', 'inactive') AS runtime_ready FROM sm)"""
ORACLES["analysis_summary"] = f"WITH RECURSIVE {SUMMARY} SELECT * FROM su"
_activity = lambda hits, misses, what: f"CASE WHEN {hits} > 0 AND {misses} > 0 THEN 'mixed-{what}' WHEN {hits} > 0 THEN 'warm-{what}' WHEN {misses} > 0 THEN 'cold-{what}' ELSE 'inactive' END"
ORACLES["stability_record"] = f"""WITH RECURSIVE {SUMMARY} SELECT {', '.join(n for n in [*_ASSETS, 'prefilter_sample_count', *(c for c in _COUNTS if not c.startswith('speech_structure')), 'dedup_group_count', 'ai_live_request_count'])}, runtime_reliability_mode AS overall_mode, runtime_ready AS ready, runtime_reliability_summary AS summary,
ai_runtime_mode AS mode_ai, transcript_runtime_mode AS mode_transcript, semantic_boundary_runtime_mode AS mode_semantic_boundary, cache_runtime_mode AS mode_cache, runtime_degraded_reasons AS degraded_reasons, runtime_intentional_skip_reasons AS intentional_skip_reasons,
semantic_boundary_targeting_mode AS semantic_targeting_mode, transcript_status, transcript_provider_effective, 'lmstudio' AS ai_provider_effective, 'configured-parallel-requests' AS ai_execution_context, 2 AS ai_effective_concurrency,
{_activity('ai_cached_segment_count', 'ai_live_segment_count', 'cache')} AS ai_cache_activity, {_activity('deterministic_preprocessing_cache_hit_asset_count', 'deterministic_preprocessing_cache_rebuilt_asset_count', 'preprocessing')} AS deterministic_preprocessing_cache_activity FROM su"""
ORACLES["run_log"] = f"WITH su AS ({ORACLES['stability_record']}) SELECT key, key || '=' || value AS line FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM su) ON COLUMNS(*) INTO NAME key VALUE value)"
_prompt = lambda k: f"[CASE WHEN i % {k + 2} = 0 THEN 1e0 ELSE -0.5e0 END FOR i IN range(64)]"
_fit = lambda k: f"list_dot_product(v, {_prompt(k)}) / sqrt(list_dot_product({_prompt(k)}, {_prompt(k)}))"
ORACLES["image_scores"] = f"""WITH u AS (SELECT vec_id AS image, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings WHERE vec_id % 10 <> 3),
s AS (SELECT image, {r(clamp(f"(({_fit(0)} + {_fit(1)} + {_fit(2)}) / 3 - 0.5e0 * (({_fit(3)} + {_fit(4)}) / 2) + 0.5e0) / 2"))} AS clip_score FROM u)
SELECT doc_id, doc_id % 97 AS image, coalesce(clip_score, 0.5e0) AS clip_score FROM documents LEFT JOIN s ON s.image = doc_id % 97"""
ORACLES["screened_sound"] = f"""WITH e AS (SELECT user_id AS asset_id, (event_id % 400) * 0.25e0 AS t, min(event_id) AS n FROM events WHERE event_id % 400 < 396 GROUP BY ALL),
g AS (SELECT asset_id, i + 0.125e0 AS t, greatest(0e0, i + 0.125e0 - 3.5e0) AS a, i + 0.125e0 + 3.5e0 AS b FROM (SELECT DISTINCT asset_id FROM e), range(0, 99, 7) x(i)),
m AS (SELECT g.asset_id, g.t, avg(CASE WHEN n % 17 = 0 THEN 0e0 ELSE pow(10e0, -(n % 60) / 20e0) END) AS av, max(CASE WHEN n % 17 = 0 THEN 0e0 ELSE pow(10e0, -(n % 60) / 20e0) END) AS mx FROM g JOIN e ON e.asset_id = g.asset_id AND e.t BETWEEN a AND b GROUP BY ALL),
q AS (SELECT g.asset_id, g.t, sum(greatest(0e0, least(b, e.t + 0.75e0) - greatest(a, e.t))) AS quiet FROM g JOIN e ON e.asset_id = g.asset_id AND n % 5 = 0 AND e.t + 0.75e0 >= a AND e.t <= b GROUP BY ALL)
SELECT g.asset_id, g.t, {r(clamp('coalesce(av, 0e0)'))} AS rms_energy, {r(clamp('coalesce(mx, 0e0)'))} AS peak_loudness, coalesce(quiet, 0e0) >= 0.5e0 * (b - a) AS is_silent FROM g LEFT JOIN m USING (asset_id, t) LEFT JOIN q USING (asset_id, t)"""
ORACLES["transcriptions"] = f"""WITH {o.CONV}, x AS (SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 'cached' WHEN asset_id % 11 = 3 THEN 'failed' ELSE 'transcribed' END AS status, s, e, trim(text) <> '' AND (asset_id % 4 = 0 OR s < 20) AS said FROM sp),
y AS (SELECT asset_id, status, CASE WHEN status = 'failed' THEN 'ValueError: no sound' END AS error, count(*) FILTER (said AND status <> 'failed') AS n_spans, max(e) FILTER (said AND status <> 'failed') + CASE WHEN status = 'cached' THEN 1 ELSE 0 END AS last_end FROM x GROUP BY asset_id, status)
SELECT *, md5('/media/' || asset_id || '.mov|' || (asset_id * 1000 + 7) || '|' || (asset_id % 100) || '|small') AS cache_key, CASE WHEN status = 'transcribed' THEN n_spans END AS n_stored FROM y"""
ORACLES["analyzed_segments"] = f"""WITH {o.SEGMENTS}, x AS (SELECT asset_id, segment_id, pos, asset_id % 9 <> 4 AND pos % 5 <> 2 AS live, count(*) OVER (PARTITION BY asset_id) AS n FROM seg)
SELECT asset_id, segment_id, pos, CASE WHEN live THEN pos || ' of ' || n ELSE 'rule ' || pos END AS result, CASE WHEN live THEN 'live' ELSE 'fallback' END AS status, CASE WHEN NOT live THEN CASE WHEN asset_id % 9 = 4 THEN 'RuntimeError: busy' ELSE 'omitted' END END AS detail FROM x"""

#: The plan's frames, as the query of segment signals makes them.
_FRAMES = ORACLES["segment_signals"][len(f"WITH {o.ASSETS}, ") : ORACLES["segment_signals"].index("w AS (SELECT asset_id, i::INT AS sid")].replace("\nv AS (", "\nfv AS (")
_window = lambda rows, t, order: f"SELECT asset_id, s, e, row_number() OVER (PARTITION BY asset_id ORDER BY {order}, t, s, e) AS i FROM (SELECT *, {r('a0', 3)} AS s, {r('least(dur, a0 + wd)', 3)} AS e FROM (SELECT *, greatest(0e0, t - wd / 2) AS a0 FROM (SELECT x.*, duration_sec AS dur, greatest(2.5e0, least(5.5e0, duration_sec / 8)) AS wd FROM {rows} x JOIN assets USING (asset_id)))) WHERE e - s >= 1.5e0"
SEEDS = f"""{o.ASSETS}, {o.SCENES('assets', 'asset_id', 'duration_sec')}, {o.AUDIO}, {o._ACLIP}, {_FRAMES}
vq AS ({_window('fv', 't', 'score DESC, distinctiveness DESC')}), {o._kept('v', 'vq', 0.7, 3)}, hx AS (SELECT * FROM ac WHERE NOT silent AND rms >= {d(0.05)}), hq AS ({_window('hx', 't', 'rms DESC')}), {o._kept('h', 'hq', 0.7, 3)},
nq AS (SELECT asset_id, least(a, duration_sec) AS s, least(b, duration_sec) AS e, row_number() OVER (PARTITION BY asset_id ORDER BY {r('least(b, duration_sec) - least(a, duration_sec)', 3)}, a) AS i FROM scenes JOIN assets USING (asset_id) WHERE least(b, duration_sec) - least(a, duration_sec) >= 1), {o._kept('n', 'nq', 0.9)},
al AS (SELECT asset_id, 0 AS src, row_number() OVER (PARTITION BY asset_id ORDER BY s, e) AS place, s, e, 'scene' AS source, {d(0.55)} AS conf FROM nkept UNION ALL SELECT asset_id, 1, k, s, e, 'visual-peak', {d(0.72)} FROM vkept UNION ALL SELECT asset_id, 2, k, s, e, 'audio-peak', {d(0.68)} FROM hkept),
zq AS (SELECT al.asset_id, s, least(e, duration_sec) AS e, source, conf, duration_sec, row_number() OVER (PARTITION BY al.asset_id ORDER BY least(e, duration_sec) - s, s, src, place) AS i FROM al JOIN assets USING (asset_id)), {o._kept('z', 'zq', 0.9)},
seeds AS (SELECT k.asset_id, k.s, k.e, source, conf, duration_sec, (row_number() OVER (PARTITION BY k.asset_id ORDER BY k.s, k.e))::INT AS seed FROM zkept k JOIN zq q ON q.asset_id = k.asset_id AND q.i = k.i)"""
ORACLES["screened_seeds"] = f"WITH RECURSIVE {SEEDS} SELECT asset_id, s AS start_sec, e AS end_sec, source, conf AS confidence, seed AS seed_id, duration_sec FROM seeds"
ORACLES["screened_ranges"] = f"""WITH RECURSIVE {SEEDS}, {o.CONV}, sd AS (SELECT asset_id, duration_sec AS dur, seed, s, e, (s + e) / 2 AS c, source FROM seeds),
{o.refinement('true', 'true')}
SELECT ro.asset_id, ro.asset_id || '-segment-' || {o.padded('row_number() OVER (PARTITION BY ro.asset_id ORDER BY ro.s, ro.e, ro.seed)', 2)} AS segment_id, ro.s AS start_sec, ro.e AS end_sec, st AS boundary_strategy, cf AS boundary_confidence, sd.source AS seed_sources FROM ro JOIN rkept USING (asset_id, i) JOIN sd USING (asset_id, seed)"""
