"""DuckDB SQL for the rows of the registered queries, where SQL can express them.

Each builder gives the common table expressions of one operator over a table `src` (doc_id, text, ...), named with the
prefix `p`; the queries and the pipeline are put together from them.
"""

from __future__ import annotations

import string

from . import sharding as sharding_rules
from .quality import MAX_BOILERPLATE, MAX_LOST, MAX_REPEATED, MIN_UNPUNCTUATED, MIN_WORDS

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = f"translate(coalesce({{0}}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_SYMBOLS = "(length({0}) - length(translate({0}, '#*$%&|<>', '')))"


def quality(src: str, p: str) -> str:
    """{p}judged: doc_id, counts and verdict; {p}clean: doc_id and the text without its failing lines."""
    failing = f"""n > 0 AND ((seps >= 2 AND 5 * seps >= n) OR 10 * {_SYMBOLS.format('line')} > chars OR (n >= 8 AND length(line) - length(replace(line, '!', '')) >= n)
      OR (n >= {MIN_UNPUNCTUATED} AND NOT regexp_matches(line, '[.!?;:…。！？；：।؟]'))
      OR (n <= {MAX_BOILERPLATE} AND regexp_matches(line, 'licensed under|all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|we use cookies|subscribe to our|sign up for our|click here to|share this (?:post|page|article)|copyright (?:©|\\(c\\))|powered by', 'i')))"""
    return f"""{p}w AS (SELECT doc_id, text, {_WORDS.format('text')} AS ws FROM {src}),
{p}g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM {p}w)),
{p}twice AS (SELECT doc_id, gram FROM {p}g GROUP BY ALL HAVING count(*) > 1),
{p}rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM {p}g JOIN {p}twice USING (doc_id, gram), range(0, 3) r(j) GROUP BY doc_id),
{p}l0 AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM {src})),
{p}l1 AS (SELECT *, {_WORDS.format('line')} AS lw FROM {p}l0),
{p}l2 AS (SELECT doc_id, line, pos, len(lw) AS n, len(list_filter(lw, lambda w: w IN ('|', '>', '>>', '·', '»', '•', '→'))) AS seps, length(array_to_string(lw, '')) AS chars FROM {p}l1),
{p}l3 AS (SELECT *, {failing} AS bad, n > 0 AND row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup FROM {p}l2),
{p}doc AS (SELECT doc_id, coalesce(sum(n) FILTER (bad), 0)::BIGINT AS lost, count(*) FILTER (dup) AS dups, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS stay FROM {p}l3 GROUP BY doc_id),
{p}j0 AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {_SYMBOLS.format("coalesce(text, '')")}::BIGINT AS n_symbols, dups AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, lost AS n_lost_words
  FROM {p}w JOIN {p}doc USING (doc_id) LEFT JOIN {p}rep r USING (doc_id)),
{p}j1 AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM {p}j0),
{p}judged AS (SELECT *, NOT base_failed AND 100 * n_lost_words <= {MAX_LOST} * n_words AS kept FROM {p}j1),
{p}clean AS (SELECT doc_id, stay AS text FROM {p}judged JOIN {p}doc USING (doc_id) WHERE kept)"""


def line_dedup(src: str, p: str) -> str:
    """{p}lines: doc_id, n_lines, n_dropped, text without the lines of keys in ten or more documents."""
    return f"""{p}l0 AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM {src})),
{p}l1 AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM {p}l0),
{p}common AS (SELECT key FROM {p}l1 WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
{p}l2 AS (SELECT l.*, c.key IS NOT NULL AS gone FROM {p}l1 l LEFT JOIN {p}common c USING (key)),
{p}lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM {p}l2 GROUP BY doc_id)"""


def ngram_join(src: str, p: str) -> str:
    """{p}joined: doc_id, n_shingles, component_id."""
    return f"""{p}w AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS ws FROM {src}),
{p}s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], chr(10)) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM {p}w)),
{p}n AS (SELECT doc_id, count(*) AS n FROM {p}s GROUP BY doc_id),
{p}c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM {p}s x JOIN {p}s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
{p}e0 AS (SELECT a, b FROM {p}c JOIN {p}n na ON na.doc_id = a JOIN {p}n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
{p}e AS (SELECT a, b FROM {p}e0 UNION ALL SELECT b, a FROM {p}e0),
{p}r AS (SELECT DISTINCT a AS node, a AS other FROM {p}e UNION SELECT {p}r.node, {p}e.b FROM {p}r JOIN {p}e ON {p}e.a = {p}r.other),
{p}least AS (SELECT node, min(other) AS least FROM {p}r GROUP BY node),
{p}joined AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, d.doc_id) AS component_id FROM {src} d LEFT JOIN {p}n USING (doc_id) LEFT JOIN {p}least ON node = d.doc_id)"""


def decontamination(src: str, p: str) -> str:
    """{p}hit: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    words = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""{p}i AS (SELECT item_id, {words.format(_LOWER.format('text'))} AS ws FROM benchmark),
{p}iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM {p}i WHERE len(ws) > 0)),
{p}d AS (SELECT doc_id, {words.format(_LOWER.format('text'))} AS ws FROM {src}),
{p}dw AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM {p}d, (SELECT DISTINCT k FROM {p}iw))),
{p}m AS (SELECT doc_id, i, {p}dw.k, item_id FROM {p}dw JOIN {p}iw USING (k, g)),
{p}c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM {p}m, range(0, 10) r(j) WHERE j < k GROUP BY doc_id),
{p}t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM {p}m GROUP BY doc_id),
{p}hit AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM {p}d LEFT JOIN {p}c USING (doc_id) LEFT JOIN {p}t USING (doc_id))"""


def mixing(src: str, p: str, seed: int = 7) -> str:
    """{p}mix: doc_id, source, size, source_size, target, epochs, taken."""
    return f"""{p}z AS (SELECT doc_id, source, len({_WORDS.format('text')})::BIGINT AS size, (1e0 + len({_WORDS.format('text')})) / (1e0 + len({_WORDS.format('text')}) + {_SYMBOLS.format("coalesce(text, '')")}) AS q,
  -ln((('0x' || substr(md5('{seed}:' || doc_id), 1, 12))::BIGINT + 0.5e0) / {float(2**48)!r}e0) AS e FROM {src}),
{p}s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM {p}z GROUP BY source),
{p}s1 AS (SELECT *, [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM {p}s0),
{p}s2 AS (SELECT *, 3e0 * source_size AS cap, 3e0 * source_size / w AS lev FROM {p}s1),
{p}s3 AS (SELECT *, coalesce(sum(cap) OVER o, 0e0) AS cap_before, coalesce(sum(w) OVER o, 0e0) AS w_before, sum(source_size) OVER ()::DOUBLE AS budget, sum(w) OVER () AS w_all FROM {p}s2 WINDOW o AS (ORDER BY lev, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{p}s4 AS (SELECT *, (budget - cap_before) / (w_all - w_before) AS fill FROM {p}s3),
{p}s5 AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(fill, lev) FROM {p}s4 WHERE fill <= lev) * w, cap)) AS target FROM {p}s4),
{p}o AS (SELECT z.doc_id, z.source, size, source_size, target, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5e0) / source_size) ELSE 0 END::BIGINT AS epochs,
  coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY e / q, z.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM {p}z z JOIN {p}s5 s ON s.source IS NOT DISTINCT FROM z.source),
{p}mix AS (SELECT doc_id, source, size, source_size, target, epochs, (epochs * size + greatest(0, least(size, floor(target + 0.5e0) - epochs * source_size - ahead)))::BIGINT AS taken FROM {p}o)"""


def collocations(src: str, p: str) -> str:
    """{p}mined: lang, rank, phrase, a, l, r, n, score."""
    gram = "array_to_string(ws[i:i + k - 1], ' ')"
    return f"""{p}t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format('text')}, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM {src}),
{p}w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM {p}t),
{p}g AS (SELECT lang, k, {gram} AS phrase, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM {p}w, range(1, 5) r(k)) GROUP BY ALL),
{p}n AS (SELECT lang, sum(f) AS n FROM {p}g WHERE k = 1 GROUP BY lang),
{p}f AS (SELECT *, string_split(phrase, ' ') AS ws FROM {p}g WHERE f >= 30),
{p}c AS (SELECT lang, phrase, k, f AS a, array_to_string(ws[1:c], ' ') AS one, array_to_string(ws[c + 1:k], ' ') AS two, c FROM (SELECT *, unnest(range(1, k)) AS c FROM {p}f)),
{p}s AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, c, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM {p}c c JOIN {p}f x ON x.lang = c.lang AND x.phrase = one JOIN {p}f y ON y.lang = c.lang AND y.phrase = two
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c) = 1),
{p}sub AS (SELECT DISTINCT lang, {gram} AS phrase, f FROM (SELECT lang, ws, f, m AS k, unnest(range(1, {p}f.k - m + 2)) AS i FROM {p}f, range(2, 4) r(m) WHERE m < {p}f.k)),
{p}left AS (SELECT * FROM {p}s s WHERE NOT EXISTS (SELECT 1 FROM {p}sub u WHERE u.lang = s.lang AND u.phrase = s.phrase AND 100 * u.f >= 80 * s.a)),
{p}mined AS (SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INT AS rank, phrase, a, l, r, n::BIGINT AS n, score FROM {p}left JOIN {p}n USING (lang) QUALIFY rank <= 2000)"""


def divergence(src: str, p: str) -> str:
    """{p}audit: lang, source, part, item, value, rank."""
    terms = r"regexp_extract_all({0}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
    share = "1 + 1000000000::HUGEINT * ({0} + 2)::HUGEINT // ({1} + 2 * v)"
    return f"""{p}d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {terms.format(_LOWER.format('text'))} AS ws FROM {src}),
{p}w AS (SELECT id, lang, source, unnest(ws) AS term FROM {p}d),
{p}k AS (SELECT lang, term FROM {p}w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
{p}v AS (SELECT g.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM {p}d) g LEFT JOIN {p}k k ON k.lang = g.lang GROUP BY g.lang),
{p}c AS (SELECT lang, source, term, count(*) AS c FROM {p}w JOIN {p}k USING (lang, term) GROUP BY ALL),
{p}n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM {p}d) g LEFT JOIN {p}c c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
{p}q AS (SELECT lang, term, {share.format("c", "n")} AS q FROM (SELECT lang, term, sum(c) AS c FROM {p}c GROUP BY ALL) JOIN (SELECT lang, sum(n) AS n FROM {p}n GROUP BY lang) USING (lang) JOIN {p}v USING (lang)),
{p}p AS (SELECT n.lang, n.source, k.term, coalesce(c, 0) AS c, {share.format("coalesce(c, 0)", "n")} AS p FROM {p}n n JOIN {p}k k USING (lang) JOIN {p}v v USING (lang) LEFT JOIN {p}c c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
{p}f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM {p}p a JOIN {p}p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
{p}pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM {p}n a JOIN {p}n b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN {p}f f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
{p}term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM {p}p JOIN {p}q USING (lang, term) WHERE c > 0 AND p > q),
{p}audit AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM {p}pair UNION ALL SELECT * FROM {p}term) QUALIFY part = 'pair' OR rank <= 10)"""


def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


def crc32(src: str, p: str) -> str:
    """{p}crc: doc_id, text, text_crc32, by a fold over the bytes."""
    return f"""{p}table AS (SELECT [{",".join(str(_crc_entry(i)) for i in range(256))}]::UBIGINT[] AS entries),
{p}bytes AS MATERIALIZED (SELECT doc_id, text, list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT)) AS bytes FROM {src}),
{p}crc AS MATERIALIZED (SELECT doc_id, text, xor(list_reduce(bytes, lambda a, x: xor(a >> 8::UBIGINT, entries[xor(a & 255::UBIGINT, x)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM {p}bytes, {p}table)"""


def sharding(src: str, p: str) -> str:
    """{p}dealt: doc_id, size, text_crc32, place of every row; ids are taken to be unique."""
    one, two = sharding_rules.MULTIPLIERS
    word = "4294967296::UBIGINT"

    def network(source: str) -> str:
        """A subquery with x put through the network; a level for each step, as columns of one level would be spelled out in the next."""
        rows = f"(SELECT *, x // m AS l, x % m AS r, 0::UBIGINT AS a, 0::UBIGINT AS b FROM {source})"
        for key in sharding_rules.round_keys(sharding_rules.SEED):
            rows = f"(SELECT * REPLACE (r AS l, xor(l, xor(b, b >> 13::UBIGINT) % m) AS r) FROM (SELECT *, xor(a, a >> 15::UBIGINT) * {two}::UBIGINT % {word} AS b FROM (SELECT * EXCLUDE (a, b), (r + {key}::UBIGINT) % {word} * {one}::UBIGINT % {word} AS a FROM {rows})))"
        return f"(SELECT doc_id, l * m + r AS x FROM {rows})"

    return f"""{crc32(src, p)},
{p}n AS (SELECT count(*)::UBIGINT AS n, (1::UBIGINT << greatest(1, (ceil(log2(count(*))) + 1)::BIGINT // 2)::UBIGINT) AS m FROM {src}),
{p}rows AS MATERIALIZED (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, text_crc32, (row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1)::UBIGINT AS x FROM {p}crc),
{p}walk AS (SELECT doc_id, x FROM {network(f"(SELECT doc_id, m, x FROM {p}rows, {p}n)")}
  UNION ALL SELECT doc_id, x FROM {network(f"(SELECT w.doc_id, m, w.x FROM {p}walk w, {p}n WHERE w.x >= n)")}),
{p}dealt AS (SELECT r.doc_id, size, text_crc32, w.x AS place FROM {p}rows r JOIN {p}walk w USING (doc_id), {p}n WHERE w.x < n)"""


ORACLES: dict[str, str] = {
    "op1_source_mixing": f"WITH {mixing('documents', 'm_')} SELECT doc_id, size, source_size, target, taken, source FROM m_mix",
    "op4_decontamination": f"WITH {decontamination('documents', 'd_')} SELECT * FROM d_hit",
    "op6_ngram_join": f"WITH RECURSIVE {ngram_join('documents', 'j_')} SELECT * FROM j_joined",
    "op7_quality_rules": f"WITH {quality('documents', 'q_')} SELECT * FROM q_judged",
    "op8_line_dedup": f"WITH {line_dedup('documents', 'l_')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM l_lines",
    "op11_collocations": f"WITH {collocations('documents', 'c_')} SELECT * REPLACE (rank::BIGINT AS rank) FROM c_mined",
    "op12_source_divergence": f"WITH {divergence('documents', 'v_')} SELECT * FROM v_audit",
    "op13_sharding": f"WITH RECURSIVE {sharding('documents', 's_')} SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {sharding_rules.SHARDS})::INT AS shard, (place // {sharding_rules.SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard FROM s_dealt",
}

#: The pipeline: rows of corpus_pipeline.run.
PIPELINE: str | None = f"""WITH RECURSIVE {quality('documents', 'q_')},
{line_dedup('q_clean', 'l_')},
k1 AS (SELECT doc_id, text FROM l_lines),
{ngram_join('k1', 'j_')},
k2 AS (SELECT doc_id, text FROM k1 JOIN j_joined USING (doc_id) WHERE doc_id = component_id),
{decontamination('k2', 'd_')},
k3 AS (SELECT k2.doc_id, k2.text, lang, source FROM k2 JOIN d_hit ON d_hit.doc_id = k2.doc_id JOIN documents o ON o.doc_id = k2.doc_id WHERE NOT contaminated),
{mixing('k3', 'm_')}
SELECT m.doc_id, m.source, size, source_size, target, epochs, taken, text, lang, length(text)::BIGINT AS n_chars FROM m_mix m JOIN k3 ON k3.doc_id = m.doc_id WHERE taken > 0"""
