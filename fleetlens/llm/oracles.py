"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

MIXING = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size,
    CAST(CASE source WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS weight
  FROM documents GROUP BY source),
totals AS (SELECT sum(size) AS t, sum(weight) FILTER (WHERE size > 0) AS w FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN weight * t / w / size ELSE CAST(weight > 0 AS DOUBLE) END AS rate FROM sizes, totals),
parts AS (SELECT source, rate, greatest(CAST(ceil(rate / 64.0) AS INT), 1) AS pieces FROM rates WHERE rate > 0),
chances(source, part, k, p, cdf) AS (
  SELECT source, rate / pieces, 0, exp(-(rate / pieces)), exp(-(rate / pieces)) FROM parts
  UNION ALL
  SELECT source, part, k + 1, p * part / (k + 1), cdf + p * part / (k + 1) FROM chances
  WHERE k + 1 < ceil(part + 10 * sqrt(part) + 20)),
docs AS (SELECT row_number() OVER () AS r, * FROM documents),
draws AS (
  SELECT r, d.source, CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || i), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, pieces + 1)) AS t(i)),
counts AS (
  SELECT r, count(*) AS n FROM draws JOIN chances c ON draws.source IS NOT DISTINCT FROM c.source AND u >= cdf GROUP BY r)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy
FROM docs JOIN counts USING (r), unnest(range(0, n)) AS t(copy)
"""

HOST_RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
places AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM docs),
triples AS (SELECT *, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM places WINDOW w AS (PARTITION BY r ORDER BY i)),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM triples WHERE c IS NOT NULL),
repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows, unnest([0, 1, 2]) AS t(k) WHERE n > 1 GROUP BY r),
measured AS (
  SELECT d.r, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS BIGINT) AS n_dup_lines,
    coalesce(w.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN repeated w USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f1, 5 * n_symbols > n_words AS f2,
    5 * n_dup_lines > greatest(n_words, 10) AS f3, word_chars > 15 * n_words AS f4 FROM measured),
long AS (SELECT r, source, k, [f1, f2, f3, f4][k] AS f FROM judged, unnest([1, 2, 3, 4]) AS t(k)),
hosts AS (SELECT source, k, count(*) AS n, sum(CAST(f AS INT)) AS bad FROM long GROUP BY source, k),
sums AS (SELECT k, count(*) AS hosts, sum(n) AS t, sum(CAST(n AS DOUBLE) * n) AS n2, sum(bad) / sum(n) AS m, sum(CAST(bad AS DOUBLE) * bad / n) AS f2 FROM hosts GROUP BY k),
shares AS (SELECT k, m, t - n2 / t - (hosts - 1) AS room, CASE WHEN m > 0 AND m < 1 THEN (f2 - t * m * m) / (m * (1 - m)) - (hosts - 1) END AS b FROM sums),
priors AS (SELECT k, m, CASE WHEN b IS NULL OR room <= 0 OR b <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, room / b - 1)) END AS w FROM shares),
verdicts AS (SELECT source, bool_or((bad + w * m) / (n + w) > 0.5) AS bad_host FROM hosts JOIN priors USING (k) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 AS base_failed, NOT (f1 OR f2 OR f3 OR f4 OR bad_host) AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""

JACCARD = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
keyed AS (SELECT doc_id, s, md5(array_to_string(list_sort(s), chr(10))) AS set_key FROM sets),
classes AS (SELECT set_key, min(doc_id) AS rep, count(*) AS copies, any_value(s) AS s FROM keyed GROUP BY set_key),
grams AS (SELECT rep, copies, len(s) AS n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.copies) AS ca, any_value(b.copies) AS cb, count(*) AS c, any_value(a.n + b.n) AS n
  FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
links AS (SELECT * FROM pairs WHERE c / (n - c) >= 0.8),
edges AS (SELECT a, b, cb AS copies FROM links UNION ALL SELECT b, a, ca FROM links),
reach(node, other) AS (SELECT rep, rep FROM classes UNION SELECT node, e.b FROM reach JOIN edges e ON e.a = other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
counts AS (SELECT a AS rep, count(*) AS n_sets, sum(copies) AS n_docs FROM edges GROUP BY a)
SELECT doc_id, root AS class_id, c.rep AS copy_of, CAST(coalesce(n_docs, 0) + copies - 1 AS BIGINT) AS n_links, coalesce(n_sets, 0) AS n_set_links
FROM keyed JOIN classes c USING (set_key) JOIN roots ON node = c.rep LEFT JOIN counts ON counts.rep = c.rep
"""

#: A table of CRC-32 steps by byte, and the CRC-32 of an ASCII text.
CRC_TABLE = """crc_steps AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) AS r(b)))"""


def crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


PERIODIC = rf"""
WITH {CRC_TABLE},
given AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, {crc32("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents, crc_steps),
placed AS (SELECT *, len(w) AS n, h // 10 AS g FROM given),
loops AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM placed),
periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM loops),
texts AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END) END AS w
  FROM periods),
grams AS (SELECT r, i, array_to_string(w[i + 1:i + 6], ' ') AS gram FROM texts, unnest(range(n - 5)) AS t(i) WHERE n >= 12),
pairs AS (SELECT b.r, b.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.gram = b.gram AND a.i < b.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
chains AS (
  SELECT r, q, min(i) - q AS s, count(*) + 5 + q AS l FROM islands GROUP BY r, q, island HAVING count(*) + 5 >= greatest(q, 12 - q)),
runs AS (
  SELECT * FROM chains x WHERE NOT EXISTS (SELECT 1 FROM chains y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, arg_min({{'s': s, 'l': l, 'q': q}}, [-l, s, q]) AS best
  FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, i FROM runs, unnest(range(s + q, s + l)) AS t(i)),
kept AS (
  SELECT x.r, string_agg(x.w[x.i + 1], ' ' ORDER BY x.i) AS body FROM (SELECT r, w, unnest(range(n)) AS i FROM texts) x
  LEFT JOIN dropped d ON d.r = x.r AND d.i = x.i WHERE d.i IS NULL GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

_BIG = 1_000_000
_STATE_NEXT = (2, 2, 3, 2)
_KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def _keep_cost(state: int) -> str:
    return "CASE initial " + " ".join(f"WHEN '{i}' THEN cut + c{s}" for i, s in _KEEPS[state].items()) + f" ELSE {_BIG} END"


def _least_cost(state: int) -> str:
    return f"least(3 + c{state}, CASE WHEN forced THEN {_BIG} ELSE least(2 + cut + c{_STATE_NEXT[state]}, {_keep_cost(state)}) END) AS b{state}"


_LETTER = "CASE WHEN 3 + c{s} = v{s} THEN 'D' WHEN 2 + v{n} = v{s} THEN 'I' WHEN NOT forced AND {keep} = v{s} THEN 'K' ELSE 'R' END"

REPAIR = rf"""
WITH RECURSIVE {CRC_TABLE},
given AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations, crc_steps),
damaged AS (
  SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS pos FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY pos) || left(role, 1) AS pair
  FROM placed),
turns AS (
  SELECT *, blank OR again AS forced, CAST(truncated AND NOT blank AND NOT again AS INT) AS cut, count(*) OVER (PARTITION BY c) AS n FROM judged),
costs AS (
  SELECT c, n + 1 AS pos, 0 AS v0, 4 AS v1, 2 AS v2, 0 AS v3, '' AS l0, '' AS l1, '' AS l2, '' AS l3 FROM (SELECT DISTINCT c, n FROM turns)
  UNION ALL
  SELECT c, pos, v0, v1, v2, v3, {", ".join(_LETTER.format(s=s, n=_STATE_NEXT[s], keep=_keep_cost(s)) for s in range(4))}
  FROM (SELECT *, least(b0, 2 + v2) AS v0, least(b1, 2 + v2) AS v1 FROM (
    SELECT *, least(b2, 2 + b3) AS v2, least(b3, 2 + b2) AS v3 FROM (
      SELECT *, {", ".join(map(_least_cost, range(4)))} FROM (
        SELECT t.c, t.pos, forced, cut, initial, v0 AS c0, v1 AS c1, v2 AS c2, v3 AS c3 FROM costs k JOIN turns t ON t.c = k.c AND t.pos = k.pos - 1))))),
steps AS (
  SELECT k.c, k.pos, [l0, l1, l2, l3] AS letters, z.n, role, text, initial FROM costs k JOIN (SELECT DISTINCT c, n FROM turns) z ON z.c = k.c LEFT JOIN turns t ON t.c = k.c AND t.pos = k.pos),
edits AS (
  SELECT c, 1 AS pos, 0 AS state, '' AS audit, '' AS body FROM (SELECT DISTINCT c FROM turns)
  UNION ALL
  SELECT c, CASE WHEN letter = 'I' THEN pos ELSE pos + 1 END,
    CASE WHEN letter = 'D' THEN state WHEN letter = 'K' AND initial = 's' THEN 1 ELSE up END, audit || letter,
    CASE letter WHEN 'D' THEN body WHEN 'K' THEN body || chr(10) || role || ':' || text
      ELSE body || chr(10) || CASE up WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'R' THEN text ELSE '' END END
  FROM (
    SELECT e.*, [2, 2, 3, 2][state + 1] AS up, s.role, s.text, s.initial,
      CASE WHEN e.pos <= n THEN letters[state + 1] WHEN state IN (1, 2) THEN 'I' END AS letter
    FROM edits e JOIN steps s ON s.c = e.c AND s.pos = e.pos) WHERE letter IS NOT NULL),
ended AS (SELECT e.c, audit, body FROM edits e JOIN (SELECT DISTINCT c, n FROM turns) USING (c) WHERE pos = n + 1 AND state IN (0, 3)),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
    sum(cut) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v0, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(substr(body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM given) LEFT JOIN counts USING (c) LEFT JOIN ended USING (c) LEFT JOIN (SELECT c, v0 FROM costs WHERE pos = 1) USING (c)
"""

ORACLES = {
    "op3_poisson_mixing": MIXING,
    "op7_host_rules": HOST_RULES,
    "op8_ngram_jaccard": JACCARD,
    "op12_conversation_repair": REPAIR,
    "op13_periodic_runs": PERIODIC,
}
