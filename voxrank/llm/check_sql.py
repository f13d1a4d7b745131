"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from voxrank.llm.chat_format import BODY, END, NEXT, START
from voxrank.llm.hard_negatives import LEAST_PERCENT, MOST_PERCENT, NEGATIVES, POSITIVES
from voxrank.llm.line_suffixes import MIN_WORDS as RUN_WORDS
from voxrank.llm.quality_rules import DELTA, GRID, MAX_REPEAT_PERCENT, MIN_WORDS, RISK, RULES
from voxrank.llm.source_audit import LEAST_DOCUMENTS, MOST_TERMS, PRIOR, SCALE

_WORD = r"[^\x20\x09-\x0D]+"
_CAPITALS = "[^A-ZÄÖÜÉÈÊÇÀÂÎÔÛÑÁÍÓÚ]"


def _escaped(name: str) -> str:
    return f"replace(replace(replace({name}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, (lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role) AS opens FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped("text")}) + CASE WHEN opens THEN {len(START + BODY + END)} + length({_escaped("role")})
      ELSE {len(NEXT)} END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

QUALITY = f"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
base AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '{_CAPITALS}', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations
  FROM split LEFT JOIN covered c USING (doc_id)),
measured AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    n_symbols::DOUBLE / greatest(word_chars, 1) AS symbols, n_capitals::DOUBLE / greatest(word_chars, 1) AS capitals,
    n_exclamations::DOUBLE / greatest(word_chars, 1) AS exclamations,
    n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeated_words, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS repeated_lines
  FROM base),
good AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
scored AS (
  SELECT doc_id, stratum, good, r.rule, r.score FROM (
    SELECT doc_id, stratum, good, unnest([{", ".join(f"{{'rule': '{r}', 'score': {r}}}" for r in RULES)}]) AS r
    FROM measured JOIN good USING (doc_id) WHERE NOT base_failed)),
tried AS (
  SELECT stratum, rule, step, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS n_bad,
    count(*) FILTER (good AND score > step::DOUBLE / {len(GRID)}) AS k,
    count(*) FILTER (NOT good AND score > step::DOUBLE / {len(GRID)}) AS caught
  FROM scored, (SELECT unnest(range({len(GRID)})) AS step) GROUP BY ALL),
tests AS (SELECT count(DISTINCT stratum) * {len(RULES)} AS m FROM scored),
tails AS (
  SELECT stratum, rule, step, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln({RISK / len(RULES)}::DOUBLE) + (n - i) * ln(1 - {RISK / len(RULES)}::DOUBLE))) AS tail
  FROM (SELECT *, unnest(range(k + 1)) AS i FROM tried WHERE n > 0 AND k <= n * {RISK / len(RULES)}::DOUBLE) GROUP BY ALL),
admitted AS (
  SELECT t.*, min((coalesce(tail, 2) <= {DELTA}::DOUBLE / m)::INT) OVER (PARTITION BY t.stratum, t.rule ORDER BY t.step DESC) AS valid,
    round(caught::DOUBLE / greatest(n_bad, 1) - k::DOUBLE / greatest(n, 1), 12) AS gain
  FROM tried t CROSS JOIN tests LEFT JOIN tails USING (stratum, rule, step)),
chosen AS (
  SELECT stratum, rule, arg_max(step, gain * 1000 + step / 1e9)::DOUBLE / {len(GRID)} AS cutoff
  FROM admitted WHERE valid = 1 AND gain > 0 GROUP BY ALL),
rejected AS (
  SELECT doc_id, {", ".join(f"max(cutoff) FILTER (rule = '{r}') AS c_{r}" for r in RULES)}
  FROM measured LEFT JOIN chosen USING (stratum) GROUP BY doc_id),
named AS (
  SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN {r} > c_{r} THEN '{r}' END" for r in RULES)}], lambda x: x IS NOT NULL), ',') AS rejected_by
  FROM measured JOIN rejected USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM named
"""

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS same FROM grams GROUP BY doc_id),
all_docs AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(same, '') AS same FROM documents LEFT JOIN sizes USING (doc_id)),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN all_docs x ON x.doc_id = a JOIN all_docs y ON y.doc_id = b WHERE 5 * common >= 4 * (x.n + y.n - common)
  UNION ALL SELECT x.doc_id, y.doc_id FROM all_docs x JOIN all_docs y ON x.n = 0 AND y.n = 0 AND x.doc_id <> y.doc_id),
reach AS (SELECT doc_id AS a, doc_id AS b FROM all_docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
counted AS (
  SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT y.same) FILTER (x.same <> y.same) AS n_text_links
  FROM links JOIN all_docs x ON x.doc_id = a JOIN all_docs y ON y.doc_id = b GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_text_links, 0)::BIGINT AS n_text_links
FROM classes LEFT JOIN counted USING (doc_id)
"""

#: A line is in a later copy of a run just if a shortest stretch of enough words through it,
#: from its first line on or back from its last line, occurs earlier.
LINES = f"""
WITH numbered AS (
  SELECT doc_id, l, k FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
lines AS (
  SELECT doc_id, l, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i,
    sum(len(regexp_extract_all(l, '{_WORD}'))) OVER (PARTITION BY doc_id ORDER BY k) AS upto,
    len(regexp_extract_all(l, '{_WORD}')) AS n
  FROM numbered WHERE regexp_matches(l, '{_WORD}')),
stretches AS (
  SELECT a.doc_id, a.i AS low, min(b.i) AS high FROM lines a JOIN lines b
    ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= {RUN_WORDS} GROUP BY ALL
  UNION
  SELECT a.doc_id, max(b.i), a.i FROM lines a JOIN lines b
    ON a.doc_id = b.doc_id AND b.i <= a.i AND a.upto - b.upto + b.n >= {RUN_WORDS} GROUP BY a.doc_id, a.i),
contents AS (
  SELECT s.doc_id, s.low, s.high, md5(string_agg(l.l, chr(10) ORDER BY l.i)) AS c
  FROM stretches s JOIN lines l ON l.doc_id = s.doc_id AND l.i BETWEEN s.low AND s.high GROUP BY ALL),
later AS (
  SELECT doc_id, low, high FROM (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id, low) AS r FROM contents) WHERE r > 1),
gone AS (SELECT DISTINCT l.doc_id, l.k FROM later s JOIN lines l ON l.doc_id = s.doc_id AND l.i BETWEEN s.low AND s.high),
texts AS (
  SELECT n.doc_id, count(g.k) AS removed, string_agg(n.l, chr(10) ORDER BY n.k) FILTER (g.k IS NULL) AS kept
  FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.k = n.k GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(removed, 0)::BIGINT AS removed_lines,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(kept, ''))::BIGINT END AS kept_chars,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN texts USING (doc_id)
"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

AUDIT = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
said AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, {_FOLD}), '{_TERM}')) AS term FROM docs),
kept AS (SELECT lang, term FROM said GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCUMENTS}),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS n_all
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN vocabulary USING (lang) LEFT JOIN counted USING (lang, source) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (n_all + {PRIOR} * v)::HUGEINT AS p
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
  SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY lang) + {PRIOR} * v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL) JOIN vocabulary USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS value
    FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
  ON d.lang = a.lang AND d.s = a.source AND d.t = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM dense JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""

NEGATIVES_SQL = f"""
WITH usable AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= {MOST_PERCENT} * positive_score
QUALIFY rank <= {NEGATIVES}
"""

CHECKS = {
    "op5_quality_rules": QUALITY, "op6_chosen_path": JACCARD, "op7_chat_format": CHAT, "op10_line_suffixes": LINES,
    "op12_source_audit": AUDIT, "op13_hard_negatives": NEGATIVES_SQL,
}
