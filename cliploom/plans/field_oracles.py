"""DuckDB SQL for the queries of derived columns."""

from __future__ import annotations

from . import oracles as o
from .oracles import ORACLES, clamp, d, r

_one = lambda n, *values: f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][({n} % {len(values)} + 1)::INT]"
_plural = lambda n, noun: f"({n}) || ' {noun}' || CASE WHEN ({n}) = 1 THEN '' ELSE 's' END"
_words = lambda x: f"regexp_replace({x}, '[-_]', ' ', 'g')"
_ID = "segment_id"
_TA = f"CASE WHEN {_ID} % 2 = 0 THEN 'partial-turn' ELSE 'turn-aligned' END"

REVIEWED = f"""{o.DOUBT}, rv0 AS (SELECT *, st AS strategy, op AS operation, CASE WHEN op = 'merge' THEN 'structural-continuity' ELSE '' END AS family, ({_ID} % 3)::INT AS turns, {_TA} AS alignment,
  {_ID} % 7 <> 0 AS short, {_ID} % 13 = 0 AS dup, {_ID} % 11 = 0 AS gated, {_ID} % 17 = 0 AS capped, CASE WHEN {_ID} % 5 <> 0 THEN visual_novelty END AS clip, {_one(_ID, None, 'deterministic', 'local')} AS provider, CASE WHEN {_ID} % 3 > 0 THEN {_ID} % 2 + 3 ELSE 0 END::INT AS frames,
  {_one(_ID, 'validated', 'fallback', 'skipped', None)} AS vs, {_one(_ID, 'keep', 'trim', 'split')} AS vd, CASE WHEN {_ID} % 8 = 2 THEN 'over_budget' END AS skip, {_one(_ID, 'ready', 'fallback', 'disabled', 'partial')} AS runtime, {_ID} % 5 <> 0 AS looked, {_one(_ID, 'question-answer-flow', 'monologue-continuity', '')} AS structure FROM doubt),
rv1 AS (SELECT *, CASE WHEN NOT has_speech THEN 'not-applicable' WHEN trim(transcript_excerpt) <> '' THEN 'excerpt-available' WHEN NOT looked THEN 'selective-skip' WHEN runtime = 'fallback' THEN 'fallback-no-transcript' WHEN runtime IN ('disabled', 'partial') THEN 'provider-' || runtime ELSE 'no-transcript-match' END AS ts,
  CASE WHEN dup THEN 'duplicate' WHEN gated THEN 'clip_gate' WHEN capped THEN 'budget_cap' WHEN NOT short THEN 'shortlist_filter' ELSE '' END AS blocked FROM rv0),
rv AS (SELECT asset_id, {_ID}, audio_energy, structure, short AS shortlisted, NOT short AS filtered_before_vlm, clip IS NOT NULL AS clip_scored, {r('clip')} AS clip_score, gated AS clip_gated, dup AS deduplicated, CASE WHEN dup THEN ({_ID} % 10)::INT END AS dedup_group_id, capped AS vlm_budget_capped,
  coalesce(provider <> 'deterministic', false) AS model_analyzed, coalesce(provider = 'deterministic', false) AS deterministic_fallback, frames AS evidence_keyframe_count,
  concat_ws(' -> ', CASE WHEN short THEN 'shortlisted' ELSE 'screened locally' END, CASE WHEN clip IS NOT NULL THEN 'vector scored' END, CASE WHEN dup THEN 'deduplicated' END, CASE WHEN frames > 0 THEN 'evidence' END, CASE WHEN provider <> 'deterministic' THEN 'model' END, CASE WHEN provider = 'deterministic' THEN 'rules' END, CASE WHEN vs = 'validated' THEN 'validated' END) AS analysis_path_summary,
  blocked AS blocked_reason,
  CASE strategy WHEN 'legacy' THEN 'Legacy window' WHEN 'turn-snap' THEN 'Turn snapped' WHEN 'transcript-snap' THEN 'Transcript snapped' WHEN 'audio-snap' THEN 'Audio snapped' WHEN 'scene-snap' THEN 'Scene snapped' ELSE 'Assembly merged (structural continuity)' END AS boundary_strategy_label, {r('stability')} AS boundary_confidence,
  CASE operation WHEN 'merge' THEN 'Merged from 2 regions by structural continuity' WHEN 'split' THEN 'Split from s' || {_ID} || ' by internal divider' ELSE CASE WHEN {_ID} % 4 = 1 THEN '' ELSE 'Built from 2 seeds (scene and audio peak)' END END AS lineage_summary,
  coalesce(vs, '') AS semantic_validation_status,
  CASE WHEN vs = 'validated' AND vd = 'keep' THEN 'Validation kept the boundary at ' || floor(stability * 100 + 0.5e0)::INT || '%' WHEN vs = 'validated' THEN 'Validation chose ' || vd || ': cut inside' WHEN vs = 'fallback' THEN 'Validation fell back to the rules' WHEN vs = 'skipped' THEN 'Validation skipped: ' || coalesce({_words('skip')}, 'not run') ELSE 'Cut Inside' END AS semantic_validation_summary,
  ts AS transcript_status,
  CASE WHEN ts = 'excerpt-available' AND turns > 0 THEN 'Transcript on ' || {_plural('turns', 'turn')} WHEN ts = 'excerpt-available' THEN 'Transcript' WHEN ts = 'selective-skip' THEN 'Transcription skipped for faint speech' WHEN ts = 'fallback-no-transcript' THEN 'Speech without transcript (' || mode_source || ')'
    WHEN starts_with(ts, 'provider-') THEN 'No text from the transcriber (' || ts || ')' WHEN speech THEN 'Speech scored without transcript' ELSE 'No transcript needed' END AS transcript_summary,
  mode_source AS speech_mode_source, CASE WHEN turns = 0 THEN '' ELSE {_words('alignment')} || ' on ' || {_plural('turns', 'turn')} END AS turn_summary,
  CASE WHEN structure = '' THEN '' ELSE 'Speech reads as ' || {_words('structure')} || CASE WHEN {_ID} % 2 = 0 THEN ' (asks first, short pause, and one voice)' ELSE '' END END AS speech_structure_summary FROM rv1)"""
ORACLES["review_records"] = f"WITH {REVIEWED} SELECT * EXCLUDE (audio_energy, structure) FROM rv"
ORACLES["segment_descriptions"] = f"""WITH {o.DOUBT}, p AS (SELECT *, printf('%.1f-%.1f s of %s', start_sec, end_sec, asset_name) AS place FROM doubt)
SELECT {_ID}, CASE WHEN trim(transcript_excerpt) <> '' THEN 'Spoken, ' || place || ': ' || trim(transcript_excerpt) WHEN speech THEN 'Speech without transcript, ' || place ELSE 'Visual, ' || place END AS description FROM p"""
_pt = lambda x: f"floor({x} * 100 + 0.5e0)::INT"
ORACLES["take_reasons"] = f"""WITH {o.TAKES}, n AS (SELECT *, {_one(_ID, 'sharpness', 'stability and duration fit')} AS dr, {_one(_ID, '', 'motion energy', '')} AS li FROM takes), m AS (SELECT *, CASE WHEN li <> '' THEN li ELSE dr END AS weak FROM n)
SELECT {_ID}, CASE WHEN outcome = 'best' THEN 'Best of its clip with ' || {_pt('score_total')} || '/100 for ' || dr WHEN outcome = 'alternate' THEN 'Alternate, ' || {_pt('score_gap')} || ' behind the best, for ' || dr WHEN score_total < {d(0.68)} THEN 'Backup under the threshold of 68/100, strongest in ' || dr
  WHEN duration_sec >= 18 AND score_gap > {d(0.08)} THEN 'Backup, ' || {_pt('score_gap')} || ' behind the best, mainly in ' || weak ELSE 'Backup at rank ' || within_asset_rank || ', mainly in ' || weak END AS reason FROM m"""
_ROLE = f"CASE WHEN {o._z('visual_novelty')} >= 0.8e0 AND {o._z('motion_energy')} >= {d(0.7)} THEN 'dynamic' WHEN {o._z('motion_energy')} < {d(0.45)} THEN 'calm' WHEN {o._z('subject_clarity')} >= 0.8e0 THEN 'clear detail' ELSE 'transition-ready' END"
ORACLES["sequence_fields"] = f"""WITH {o.DOUBT} SELECT {_ID}, {_ROLE} AS visual_role, CASE WHEN {_ID} % 5 = 0 THEN 'opener' WHEN speech THEN 'spoken beat' ELSE {_ROLE} END AS story_role,
{r("least(end_sec - start_sec, CASE WHEN speech THEN 7.5e0 WHEN op = 'merge' OR starts_with(st, 'assembly-merge:') THEN 7e0 WHEN st IN ('scene-snap', 'audio-snap', 'transcript-snap') OR coalesce(stability, 0e0) >= 0.6e0 THEN 6.5e0 ELSE 5e0 END)")} AS duration, {r(f"coalesce((end_sec - start_sec) / nullif({_ID} % 3, 0), 0e0)")} AS part FROM doubt"""
ORACLES["clip_scores"] = f"WITH {o.DOUBT} SELECT {_ID}, CASE WHEN {_ID} % 5 IN (1, 2, 3) THEN visual_novelty END AS clip_score FROM doubt"
_inside = lambda x, a, b: f"greatest({a}, least({b}, {x}))"
ORACLES["validation_gates"] = f"""WITH {o.DOUBT}, q2 AS (SELECT *, (start_sec + end_sec) / 2 AS c, (start_sec - 1e0 + end_sec + 0.5e0) / 2 AS c1, (start_sec + 2e0 + (start_sec + 2e0 + {_ID} % 3)) / 2 AS c2, end_sec + 0.5e0 > start_sec - 1e0 AS v1, {_ID} % 3 > 0 AS v2 FROM doubt)
SELECT {_ID}, {r("abs(c - CASE WHEN v1 AND v2 THEN (c1 + c2) / 2 WHEN v1 THEN c1 ELSE c2 END)")} AS drift, CASE WHEN {_ID} % 3 = 0 THEN 'pending' ELSE 'not_eligible' END AS status, CASE WHEN {_ID} % 3 = 0 THEN 'skipped' ELSE 'not_eligible' END AS status_without_model, CASE WHEN {_ID} % 3 = 0 THEN 'ai_unavailable' ELSE '' END AS skip_without_model,
{r(_inside(_inside(_inside(f'start_sec + ({_ID} % 9 - 4)', '0e0', 'duration_sec'), 'start_sec - 1.5e0', 'start_sec + 1.5e0'), '0e0', 'duration_sec'), 3)} AS moved_start,
op IN ('split', 'merge') OR {_ID} % 3 >= 2 OR coalesce(speech AND stability >= {d(0.85)} AND (starts_with(st, 'transcript-') OR st = 'turn-snap'), false) AS split_supported FROM q2"""
ORACLES["label_lists"] = """WITH i0 AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), i1 AS (SELECT p_partkey, list_concat(w, ['', upper(w[1]), w[1]]) AS items FROM i0),
i2 AS (SELECT *, list_filter(items, lambda x, i: trim(x) <> '' AND list_position(items, x) = i) AS labels, list_filter(items, lambda x, i: trim(x) <> '' AND list_position(list_transform(items, lambda y: lower(y)), lower(x)) = i) AS spellings FROM i1),
i3 AS (SELECT *, labels[1:(p_partkey % 4)::INT] AS few FROM i2)
SELECT p_partkey, CASE len(few) WHEN 0 THEN 'overall balance' WHEN 1 THEN few[1] WHEN 2 THEN few[1] || ' and ' || few[2] ELSE array_to_string(few[1:len(few) - 1], ', ') || ', and ' || few[len(few)] END AS told, array_to_string(labels, '|') AS labels, array_to_string(spellings, '|') AS spellings FROM i3"""
ORACLES["text_gates"] = """SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) >= 8 AND len(regexp_split_to_array(trim(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+')) >= 2 AS has_text, doc_id % 6 <= 3 AS placeholder, true AS same_model, lower(source) = lower(lang) OR contains(lower(source), lower(lang)) OR contains(lower(lang), lower(source)) AS other_model FROM documents"""
ORACLES["json_repairs"] = """WITH e AS (SELECT event_id, event_id % 6 AS n, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE WHEN n <> 4 THEN k END AS k, CASE WHEN n IN (0, 1, 5) THEN '[1,2]' WHEN n = 2 THEN '[1]' END AS list, CASE WHEN n IN (0, 1) THEN 'a, b' END AS text FROM e"""
ORACLES["rational_times"] = f"""WITH e AS (SELECT event_id, (event_id % 5000)::BIGINT AS n, gcd((event_id % 5000)::BIGINT, 48) AS g FROM events)
SELECT event_id, (n // g) || '/' || (48 // g) || 's' AS told, {r('n / 48e0', 6)} AS seconds FROM e"""
ORACLES["pause_stats"] = f"""WITH {o.CONV}, n AS (SELECT *, greatest(0e0, lead(s) OVER w - e) AS g, lead(s) OVER w IS NULL AS last FROM sp WINDOW w AS (PARTITION BY asset_id ORDER BY s, e))
SELECT asset_id, {r('coalesce(max(g) FILTER (NOT last), 0e0)', 3)} AS largest, CASE WHEN count(*) > 1 THEN {r('sum(g) FILTER (NOT last) / (count(*) - 1)', 3)} ELSE 1e0 END AS mean, coalesce(string_agg(printf('%.3f', e), '|' ORDER BY s, e) FILTER (NOT last), '') AS boundaries FROM n GROUP BY ALL"""
ORACLES["keyframes"] = f"""WITH {o.SEGMENTS}, k AS (SELECT *, greatest(end_sec - start_sec, 0e0) AS len FROM seg)
SELECT {_ID}, (i - 1)::INT AS pos, {r('start_sec + (len / ((CASE WHEN len <= 8 THEN 3 ELSE 4 END) + 1)) * i', 3)} AS t FROM k, range(1, 5) x(i) WHERE i <= CASE WHEN len <= 8 THEN 3 ELSE 4 END"""
ORACLES["runtime_states"] = """WITH s AS (SELECT o_orderkey AS run_id, o_orderpriority AS p, CASE WHEN o_orderkey % 97 = 0 THEN 'unavailable' WHEN o_orderkey % 5 = 0 THEN 'inactive' WHEN o_orderkey % 3 > 0 THEN 'degraded' WHEN o_orderkey % 2 > 0 THEN 'partial' ELSE 'active' END AS status,
CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 4 > 0 THEN 'mixed' WHEN o_orderkey % 3 > 0 THEN 'warm' WHEN o_orderkey % 4 > 0 THEN 'cold' ELSE 'inactive' END AS cache FROM orders),
w AS (SELECT p, ['unavailable', 'degraded', 'partial', 'active', 'inactive'][min(list_position(['unavailable', 'degraded', 'partial', 'active', 'inactive'], status))::INT] AS worst FROM s GROUP BY p)
SELECT run_id, status, cache, worst FROM s JOIN w USING (p)"""
ORACLES["boundary_answers"] = f"""WITH {o.DOUBT}, a AS (SELECT *, {r(clamp('stability + 0.1e0'))} AS sure, {_one(_ID, 'keep', 'trim', 'extend', 'split', 'keep')} AS dc, CASE WHEN {_ID} % 2 = 0 THEN start_sec + 0.3e0 END AS given, {r(f'greatest(0.25e0, least(0.75e0, {d(0.12)} * greatest(0e0, end_sec - start_sec)))', 3)} AS delta FROM doubt),
b AS (SELECT *, CASE WHEN dc = 'split' AND sure < {d(0.85)} THEN 'keep' ELSE dc END AS decision, least(end_sec - 1.5e0, start_sec + delta) AS cut FROM a)
SELECT {_ID}, decision, sure AS confidence, CASE decision WHEN 'trim' THEN {r('coalesce(given, cut)', 3)} WHEN 'extend' THEN {r('coalesce(given, greatest(0e0, start_sec - delta))', 3)} END AS new_start, CASE decision WHEN 'trim' THEN {r('greatest(cut + 1.5e0, end_sec - delta)', 3)} WHEN 'extend' THEN {r('least(end_sec, end_sec + delta)', 3)} END AS new_end, CASE WHEN decision = 'split' THEN {r('(start_sec + end_sec) / 2', 3)} END AS split_at FROM b"""
_RULES = ORACLES["rule_understanding"]
ORACLES["model_answers"] = f"""WITH rules AS ({_RULES}), t AS (SELECT *, {_ID} % 3 < 2 AS said FROM rules JOIN (WITH {o.DOUBT} SELECT {_ID} FROM doubt) USING ({_ID}))
SELECT {_ID}, CASE WHEN said THEN 'wide' ELSE shot_type END AS shot_type, camera_motion, CASE WHEN said THEN 'calm' ELSE mood END AS mood, CASE WHEN said THEN 'keep' ELSE keep_label END AS keep_label, CASE WHEN said THEN 1e0 ELSE confidence END AS confidence, CASE WHEN said THEN 'opener' ELSE story_roles END AS story_roles, quality_findings, risk_flags FROM t"""
ORACLES["task_results"] = f"""WITH {o.SEGMENTS}, t AS (SELECT asset_id, CASE {_ID} % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'l' ELSE 'f' END AS s, CASE {_ID} % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'l' ELSE 'f' END || {_ID} AS res FROM seg)
SELECT asset_id, count(*) FILTER (s = 'l') AS live, count(*) FILTER (s = 'c') AS cached, count(*) FILTER (s = 'f') AS fallback, count(*) AS requests, min(res) AS first FROM t GROUP BY asset_id
UNION ALL SELECT -1, count(*) FILTER (s = 'l'), count(*) FILTER (s = 'c'), count(*) FILTER (s = 'f'), count(*), '' FROM t"""
ORACLES["evidence_reuse"] = f"""WITH {o.SEGMENTS} SELECT {_ID}, {r('coalesce(lag(start_sec) OVER w, start_sec)', 3)} AS context_start, {r('coalesce(lead(end_sec) OVER w, end_sec)', 3)} AS context_end, {_ID} % 4 <> 0 AND {_ID} % 3 <> 0 AS reused FROM seg WINDOW w AS (PARTITION BY asset_id ORDER BY start_sec, pos)"""
_united = lambda c: f"CASE WHEN len(list_filter({c}, lambda x: x IS NOT NULL)) > 0 THEN array_to_string(list_filter({c}, lambda x, i: x IS NOT NULL AND list_position({c}, x) = i), '|') ELSE ids END"
ORACLES["gathered_sources"] = f"""WITH {o.SEGMENTS}, g AS (SELECT asset_id, {_ID}, pos, floor(pos / 3)::BIGINT AS chain, CASE WHEN pos % 2 = 0 THEN [{_one(_ID, 'scene', 'audio-peak')}, 'clip'] ELSE []::VARCHAR[] END AS a, CASE WHEN floor(pos / 3)::BIGINT % 2 = 0 THEN [{_one(_ID, 'x', 'y', 'z')}] ELSE []::VARCHAR[] END AS b FROM seg),
u AS (SELECT asset_id, chain, flatten(list(a ORDER BY pos)) AS a, flatten(list(b ORDER BY pos)) AS b, string_agg({_ID}::VARCHAR, '|' ORDER BY pos) AS ids FROM g GROUP BY ALL)
SELECT asset_id, chain, {_united('a')} AS seeds, {_united('b')} AS sources FROM u"""
ORACLES["set_expectations"] = f"""WITH {o.SEGMENTS}, s AS (SELECT asset_id, list(DISTINCT {_one(_ID, 'opener', 'bridge', 'payoff', 'detail')}) AS seen FROM seg WHERE start_sec < 6 GROUP BY asset_id),
x AS (SELECT asset_id, list_filter(['bridge', 'opener'], lambda x: NOT list_contains(seen, x)) AS m, list_filter(CASE WHEN asset_id % 2 = 0 THEN ['odd', 'payoff'] ELSE []::VARCHAR[] END, lambda x: list_contains(seen, x)) AS u FROM s)
SELECT asset_id, array_to_string(m, '|') AS missing, array_to_string(u, '|') AS unwanted, len(m) = 0 AND len(u) = 0 AS passed FROM x"""
_move = lambda new, old: f"greatest(0e0, least(duration_sec, greatest({old} - 1.5e0, least({old} + 1.5e0, coalesce({new}, {old})))))"
ORACLES["validated_segments"] = f"""WITH {o.SEGMENTS}, v AS (SELECT asset_id, {_ID}, start_sec AS s, end_sec AS e, duration_sec, {_ID} % 6 <> 0 AS has, {_one(_ID, 'keep', 'trim', 'extend', 'split')} AS dc, start_sec + ({_ID} % 5 - 2) * 0.75e0 AS ns, CASE WHEN {_ID} % 7 <> 0 THEN end_sec + ({_ID} % 3 - 1) * 2e0 END AS ne FROM seg WHERE prefilter_score IS NOT NULL AND end_sec > start_sec),
m AS (SELECT *, {r(_move('CASE WHEN has THEN ns END', 's'), 3)} AS a, {r(_move('CASE WHEN has THEN ne END', 'e'), 3)} AS b FROM v),
k AS (SELECT *, has AND dc IN ('trim', 'extend') AND b - a >= 1.5e0 AS moved, has AND dc = 'split' AND {_ID} % 8 <> 3 AND (e - s) / 2 >= 1.5e0 AS cut FROM m),
f AS (SELECT asset_id, {_ID}, CASE WHEN moved THEN a ELSE s END AS s, CASE WHEN moved THEN b WHEN cut THEN (s + e) / 2 ELSE e END AS e, moved OR cut AS applied FROM k UNION ALL SELECT asset_id, {_ID}, (s + e) / 2, e, true FROM k WHERE cut AND NOT moved)
SELECT asset_id, asset_id || '-segment-' || {o.padded(f'row_number() OVER (PARTITION BY asset_id ORDER BY s, e, {_ID})', 2)} AS segment_id, s AS start_sec, {r('e', 3)} AS end_sec, applied FROM f"""
ORACLES["seed_regions"] = f"""WITH RECURSIVE {o.ASSETS}, {o.SCENES('assets', 'asset_id', 'duration_sec')},
sh AS (SELECT asset_id, duration_sec AS d, a + CASE WHEN asset_id % 4 = 0 THEN duration_sec ELSE 0e0 END AS a, b + CASE WHEN asset_id % 4 = 0 THEN duration_sec ELSE 0e0 END AS b FROM scenes JOIN assets USING (asset_id)),
no AS (SELECT asset_id, least(a, d) AS s, least(b, d) AS e FROM sh), nq AS (SELECT asset_id, s, e, row_number() OVER (PARTITION BY asset_id ORDER BY e - s, s) AS i FROM no WHERE e - s >= 1), {o._kept('n', 'nq', 0.9)},
ev AS (SELECT asset_id, 0 AS src, s, e, 'scene' AS source, {d(0.55)} AS conf FROM nkept
  UNION ALL SELECT asset_id, 1, CASE WHEN asset_id % 3 = 0 THEN 0e0 ELSE asset_id % 5 END, CASE WHEN asset_id % 3 = 0 THEN 5.5e0 ELSE asset_id % 5 + 3e0 END, 'visual-peak', {d(0.72)} FROM assets WHERE asset_id % 3 < 2 AND asset_id % 7 <> 0
  UNION ALL SELECT asset_id, 2, asset_id % 5, asset_id % 5 + CASE WHEN asset_id % 3 = 1 THEN 0.5e0 ELSE 3.25e0 END, 'audio-peak', {d(0.68)} FROM assets WHERE asset_id % 3 < 2 AND asset_id % 7 <> 0
  UNION ALL SELECT asset_id, 2, asset_id % 40, asset_id % 40 + 8e0, 'audio-peak', {d(0.68)} FROM assets WHERE asset_id % 15 = 2 AND asset_id % 7 <> 0),
al AS (SELECT * FROM ev UNION ALL SELECT asset_id, 3, 0e0, greatest(duration_sec, 1e0), 'fallback', {d(0.3)} FROM assets WHERE asset_id % 7 <> 0 AND asset_id NOT IN (SELECT asset_id FROM ev)),
zq AS (SELECT al.asset_id, greatest(0e0, s) AS s, least(e, duration_sec) AS e, source, conf, row_number() OVER (PARTITION BY al.asset_id ORDER BY least(e, duration_sec) - greatest(0e0, s), greatest(0e0, s), src) AS i FROM al JOIN assets USING (asset_id) WHERE e > s), {o._kept('z', 'zq', 0.9)}
SELECT k.asset_id, k.s AS start_sec, k.e AS end_sec, source, conf AS confidence FROM zkept k JOIN zq q ON q.asset_id = k.asset_id AND q.i = k.i"""

_u = lambda key, label: f"(('0x' || substr(md5({key}::VARCHAR || ':' || printf('%.3f', t) || ':{label}'), 1, 8))::BIGINT / 4294967295e0)"
_FR = {"sharpness": ("id", "sharpness", 0.48, 0.42), "contrast": ("nm", "contrast", 0.42, 0.42), "brightness": ("nm", "brightness", 0.38, 0.36), "motion_energy": ("nm", "motion", 0.25, 0.55), "distinctiveness": ("nm", "distinctive", 0.28, 0.58), "center_focus": ("id", "center", 0.4, 0.42)}
_mean = lambda x: r(f"coalesce(avg(round({x}, 9)), 0e0)")
ORACLES["segment_signals"] = f"""WITH {o.ASSETS}, n AS (SELECT asset_id AS id, asset_name AS nm, greatest(duration_sec, 1e0) AS u, greatest(4, least(10, (ceil(greatest(duration_sec, 1e0) / 8) + 2)::INT)) AS n FROM assets),
g AS (SELECT *, {r('i * (u / (n + 1))', 3)} AS t FROM n, range(1, 11) x(i) WHERE i <= n), v0 AS (SELECT id AS asset_id, t, {', '.join(f'{r(f"{d(b)} + {d(w)} * {_u(k, lab)}")} AS {c}' for c, (k, lab, b, w) in _FR.items())} FROM g),
v AS (SELECT *, {r(clamp(f'{d(0.26)} * sharpness + {d(0.16)} * contrast + {d(0.22)} * motion_energy + {d(0.2)} * distinctiveness + {d(0.16)} * center_focus'))} AS score FROM v0),
w AS (SELECT asset_id, i::INT AS sid, i * 4e0 AS s, i * 4e0 + 3 AS e FROM assets, range(0, 20) x(i) WHERE i <= floor(duration_sec / 4)), ins AS (SELECT w.sid, v.* FROM w JOIN v ON v.asset_id = w.asset_id AND t >= s AND t <= e),
m AS (SELECT * FROM ins UNION ALL (SELECT w.sid, v.* FROM w JOIN v ON v.asset_id = w.asset_id WHERE NOT EXISTS (SELECT 1 FROM ins i WHERE i.asset_id = w.asset_id AND i.sid = w.sid) QUALIFY row_number() OVER (PARTITION BY w.asset_id, w.sid ORDER BY abs(t - (s + e) / 2), t) = 1))
SELECT asset_id, sid AS segment_id, {_mean('score')} AS mean_score, {_mean('sharpness')} AS mean_sharpness, {_mean('distinctiveness')} AS mean_distinctiveness, {_mean('motion_energy')} AS mean_motion_energy, {_mean('brightness')} AS mean_brightness, {_mean('contrast')} AS mean_contrast,
{_mean(f'{d(0.65)} * center_focus + {d(0.35)} * contrast')} AS subject_clarity, CASE WHEN count(*) > 1 THEN {r(clamp('1e0 - 1.6e0 * stddev_pop(motion_energy)'))} ELSE {d(0.72)} END AS stability, count(*)::INT AS n, arg_min(t, (-score, t)) AS best_sec FROM m GROUP BY ALL"""

_cnt = lambda test: f"count(*) FILTER ({test})"
COUNTERS = f"""{REVIEWED}, ct AS (SELECT count(DISTINCT asset_id) AS asset_count, count(*) AS candidate_segment_count, {_cnt('deduplicated')} AS dedup_eliminated_count, count(DISTINCT (asset_id, dedup_group_id)) FILTER (dedup_group_id IS NOT NULL) AS dedup_group_count, {_cnt('shortlisted')} AS prefilter_shortlisted_count,
  {_cnt("shortlisted AND blocked_reason = ''")} AS vlm_target_count, {_cnt('filtered_before_vlm')} AS filtered_before_vlm_count, count(DISTINCT asset_id) FILTER (coalesce(audio_energy, 0e0) > 0) AS audio_signal_asset_count, {_cnt("transcript_status = 'excerpt-available'")} AS transcript_excerpt_segment_count,
  count(DISTINCT asset_id) FILTER (transcript_status = 'selective-skip') AS transcript_skipped_asset_count, {_cnt("speech_mode_source = 'speech-signal-fallback'")} AS speech_fallback_segment_count, {_cnt('clip_scored')} AS clip_scored_count, {_cnt('clip_gated')} AS clip_gated_count,
  {_cnt("semantic_validation_status <> ''")} AS semantic_boundary_eligible_count, {', '.join(_cnt(f"semantic_validation_status = '{s}'") + f' AS semantic_boundary_{s}_count' for s in ('validated', 'skipped', 'fallback'))}, {_cnt('model_analyzed')} AS ai_live_segment_count, {_cnt('deterministic_fallback')} AS ai_fallback_segment_count,
  sum(evidence_keyframe_count)::BIGINT AS keyframe_count, {_cnt("structure <> ''")} AS speech_structure_segment_count, {_cnt("structure = 'question-answer-flow'")} AS speech_structure_question_answer_count, {_cnt("structure = 'monologue-continuity'")} AS speech_structure_monologue_count,
  {', '.join(_cnt(f"blocked_reason = '{b}'") + f' AS blocked_{b}_count' for b in ('duplicate', 'clip_gate', 'budget_cap', 'shortlist_filter'))} FROM rv),
counters AS (SELECT *, semantic_boundary_validated_count = 0 AS semantic_boundary_dormant, 40e0 AS vlm_budget_cap_pct, vlm_target_count < prefilter_shortlisted_count * 40e0 / 100 AS vlm_budget_was_binding, {r('coalesce(vlm_target_count * 100e0 / nullif(candidate_segment_count, 0), 0e0)')} AS vlm_target_pct_of_candidates,
  CASE WHEN ai_live_segment_count = 0 THEN 'inactive' WHEN ai_fallback_segment_count > 0 THEN 'degraded' WHEN filtered_before_vlm_count > 0 THEN 'partial' ELSE 'active' END AS ai_runtime_mode,
  CASE WHEN semantic_boundary_eligible_count = 0 THEN 'inactive' WHEN semantic_boundary_fallback_count > 0 THEN 'degraded' WHEN semantic_boundary_skipped_count > 0 THEN 'partial' ELSE 'active' END AS semantic_boundary_runtime_mode, CASE WHEN semantic_boundary_validated_count > 0 THEN 'active' ELSE 'inactive' END AS semantic_boundary_targeting_mode FROM ct)"""
ORACLES["run_counters"] = f"WITH {COUNTERS} SELECT * FROM counters"
ORACLES["runtime_record"] = f"""WITH {COUNTERS} SELECT *, 1195e0 AS per_asset_analysis_sec, 4.25e0 AS take_selection_sec, 1.75e0 AS timeline_assembly_sec, 1201e0 AS total_runtime_sec, '20:01 (1201.00s)' AS total_runtime, {r('1201e0 / nullif(asset_count, 0)', 3)} AS sec_per_asset, {r('1201e0 / nullif(vlm_target_count, 0)', 3)} AS sec_per_target,
2 AS ai_concurrency, 2 AS ai_effective_concurrency, 'configured-parallel-requests' AS ai_execution_context, CASE WHEN ai_live_segment_count > 0 THEN 'cold' ELSE 'inactive' END AS ai_cache_activity, 100e0 AS budget_pct, 'full' AS mode FROM counters"""
ORACLES["runtime_texts"] = f"""WITH {o.CONV}, {o._CLIPS}, j AS (SELECT a.asset_id, a.dur, b.dur AS before, {r('a.dur - b.dur', 3)} AS delta, {r('(a.dur - b.dur) * 100 / nullif(b.dur, 0)', 1)} AS pct, floor(a.dur * 60)::BIGINT AS s FROM clips a JOIN clips b ON b.asset_id + 1 = a.asset_id)
SELECT asset_id, CASE WHEN s < 3600 THEN printf('%02d:%02d', s // 60, s % 60) ELSE printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) END || printf(' (%.2fs)', dur * 60) AS runtime,
printf('%.2fs ', abs(delta)) || CASE WHEN asset_id % 2 = 0 AND pct IS NOT NULL THEN printf('(%.1f%%) ', abs(pct)) ELSE '' END || CASE WHEN delta > 0 THEN 'slower' WHEN delta < 0 THEN 'faster' ELSE 'unchanged' END AS told FROM j"""
ORACLES["cached_results"] = f"""WITH {o.SEGMENTS} SELECT {_ID}, asset_id || '-' || substr(md5(asset_name), 1, 10) AS asset_key, prefilter_score, CASE WHEN {_ID} % 3 = 1 THEN 'second ' ELSE 'first ' END || {_ID} AS answer FROM seg WHERE {_ID} % 3 <> 0 AND {_ID} % 2 = 0"""
ORACLES["screening_artifacts"] = f"""WITH {o.AUDIO}, a AS (SELECT *, bool_or(event_id % 701 = 0) OVER (PARTITION BY asset_id) AS bad FROM audio WHERE event_id % 50 <> 0 AND event_id % 40 <> 1)
SELECT asset_id, event_id, {r('t / 7', 3)} AS timestamp_sec, {r('rms / 3')} AS rms_energy FROM a WHERE NOT bad"""
ORACLES["last_runs"] = """WITH a AS (SELECT 'last' AS what, o_orderkey AS run_id, o_orderpriority AS dataset_fingerprint, o_orderstatus AS fixture_set FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1),
b AS (SELECT 'evaluated', o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b"""
ORACLES["asset_ids"] = f"WITH {o.MEDIA} SELECT path AS source_path, 'asset-' || {o.padded('row_number() OVER (ORDER BY path)', 3)} AS asset_id FROM md"
ORACLES["model_ids"] = """WITH n AS (SELECT *, 'org--' || p_name || '-' || p_size AS slug FROM part) SELECT p_partkey, slug, slug || '@' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'default' END AS key FROM n"""
_CHANGES = f"""ch AS (SELECT 'c' || p_partkey AS name, {_one('p_partkey', 'umbrella', 'implementation', 'implementation', 'odd')} AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'c' || (p_partkey * 2) END AS parent, (p_size % 7)::INT AS phase, ['c' || (p_partkey + 1), 'c' || (p_partkey + p_size * 9)] AS deps FROM part),
nd AS (SELECT ch.name, ch.phase, dep, k.name AS known, k.phase AS kphase FROM (SELECT name, phase, unnest(deps) AS dep FROM ch) ch LEFT JOIN ch k ON k.name = dep)"""
ORACLES["change_checks"] = f"""WITH {_CHANGES} SELECT name, 'kind' AS error, kind AS about FROM ch WHERE kind = 'odd' UNION ALL SELECT name, 'parent_of_umbrella', parent FROM ch WHERE kind = 'umbrella' AND parent IS NOT NULL
UNION ALL SELECT name, 'parent', parent FROM ch WHERE kind = 'implementation' AND parent IS NOT NULL AND parent NOT IN (SELECT name FROM ch) UNION ALL SELECT name, 'dependency', dep FROM nd WHERE known IS NULL UNION ALL SELECT name, 'phase', dep FROM nd WHERE known IS NOT NULL AND phase <= kphase"""
ORACLES["change_blocks"] = f"WITH {_CHANGES} SELECT dep AS name, string_agg(name, '|' ORDER BY name) AS blocks FROM nd WHERE known IS NOT NULL GROUP BY dep"
_told = lambda pairs: f"concat_ws('|', {', '.join(f'CASE WHEN {test} THEN {label!r} END' for label, test in pairs)})"
_V, _P, _WHOLE = "vis", "fit > 0", f"NOT vis AND {o._SPEECH_TURN}"
_MC, _RC = "vis <> v1", "role <> r1"
LABELLED = f"""path AS ({ORACLES['story_sequence']}), {o.TAKES},
f0 AS (SELECT take_id, asset_id % 50 AS scope, NOT speech AS vis, {_ROLE.replace('CASE WHEN', "CASE WHEN speech THEN 'spoken beat' WHEN", 1)} AS role, score_total AS tot, (segment_id % 5) * {d(0.02)} AS fit, {o._z('visual_novelty')} AS nov, {o._z('hook_strength')} AS hook, {o._z('motion_energy')} AS mot, {o._z('story_alignment')} AS sto, speech_ratio FROM takes WHERE is_selected),
f1 AS (SELECT f0.*, order_index AS i, count(*) OVER (PARTITION BY f0.scope) AS n, lag(vis) OVER w AS v1, lag(role) OVER w AS r1, lag(tot) OVER w AS t1, coalesce(lag(vis, 2) OVER w, lag(vis) OVER w) AS v2, coalesce(lag(role, 2) OVER w, lag(role) OVER w) AS r2 FROM f0 JOIN path USING (take_id) WINDOW w AS (PARTITION BY f0.scope ORDER BY order_index)),
lb AS (SELECT scope, i AS order_index, take_id, CASE WHEN n = 1 THEN 'local_strength'
  WHEN i = 0 THEN {_told([('local_strength', 'true'), ('opener_fit', _V), ('visual_novelty', f'vis AND nov >= {d(0.7)}'), ('hook_strength', f'hook >= {d(0.7)}'), ('prompt_fit', _P), ('prompt_led_opener', f'vis AND {_P}')])}
  WHEN i = n - 1 AND n >= 3 THEN {_told([('local_strength', 'true'), ('release_fit', 'true'), ('calm_release', f'vis AND mot <= {d(0.55)}'), ('complete_turn', _WHOLE), ('story_alignment', f'sto >= {d(0.7)}'), ('prompt_fit', _P)])}
  ELSE {_told([('local_strength', 'true'), ('mode_variety', _MC), ('repetition_control', f'{_MC} OR {_RC}'), ('spoken_progression', f'{_MC} AND NOT vis'), ('release_transition', f'{_MC} AND vis'), ('role_variety', _RC), ('complete_turn', _WHOLE), ('paired_strength', 'tot >= 0.75e0 AND t1 >= 0.75e0'), ('prompt_fit', _P)])} END AS drivers,
  CASE WHEN n = 1 THEN '' WHEN i = 0 THEN {_told([('preferred_for_prompt_fit', f'{_P} AND tot < {d(0.78)}')])} WHEN i = n - 1 AND n >= 3 THEN '' ELSE {_told([('same_mode_repeat', 'vis = v1'), ('same_role_repeat', 'role = r1'), ('third_same_mode_avoided', 'vis = v1 AND vis = v2'), ('third_same_role_avoided', 'role = r1 AND role = r2')])} END AS tradeoffs FROM f1)"""
ORACLES["sequence_labels"] = f"WITH {LABELLED} SELECT * FROM lb"
_has = lambda label: f"count(*) FILTER (list_contains(string_split(drivers, '|'), {label!r}))"
ORACLES["sequence_counters"] = f"WITH {LABELLED} SELECT scope, count(*) AS n_items, count(*) - 1 AS transitions, {_has('prompt_fit')} AS prompt_fit_count, {_has('repetition_control')} AS repetition_control_count, count(*) FILTER (tradeoffs <> '') AS tradeoff_count FROM lb GROUP BY scope"

_DEPENDENCIES = """pp AS (SELECT p_partkey AS p, p_partkey // 10 AS t FROM part),
ne AS (SELECT p AS after, p - 1 AS before FROM pp WHERE p % 10 <> 0 UNION SELECT p, p + 4 FROM pp WHERE p % 10 = 0 AND t % 7 = 0 UNION SELECT p, p + 2 FROM pp WHERE p % 10 = 0 AND t % 11 = 0
  UNION SELECT p, p + 3 FROM pp WHERE p % 10 = 6 AND t % 11 = 0 UNION SELECT p, p FROM pp WHERE p % 10 = 5 AND t % 13 = 0 UNION SELECT p, p - 10 FROM pp WHERE p % 100 = 10),
dp AS (SELECT * FROM ne WHERE before IN (SELECT p FROM pp)),
re AS (SELECT before AS a, after AS b FROM dp UNION SELECT re.a, dp.after FROM re JOIN dp ON dp.before = re.b),
cy AS (SELECT a AS node FROM re WHERE a = b)"""
ORACLES["change_cycles"] = f"""WITH RECURSIVE {_DEPENDENCIES},
sc AS (SELECT x.a AS node, min(x.b) AS component, count(*) AS size FROM re x JOIN re y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
nx AS (SELECT s.node, min(after) AS next_node FROM sc s JOIN dp ON dp.before = s.node JOIN sc o ON o.node = after AND o.component = s.component GROUP BY s.node),
fo AS (SELECT node AS a, next_node AS b FROM nx UNION SELECT fo.a, nx.next_node FROM fo JOIN nx ON nx.node = fo.b)
SELECT s.node, component, size, next_node, EXISTS (SELECT 1 FROM fo WHERE fo.a = s.node AND fo.b = s.node) AS on_cycle FROM sc s JOIN nx ON nx.node = s.node"""
ORACLES["changes_held_up"] = f"WITH RECURSIVE {_DEPENDENCIES} SELECT DISTINCT node FROM (SELECT node FROM cy UNION ALL SELECT re.b FROM re JOIN cy ON cy.node = re.a)"
