"""SQL that computes each query of the registry independently, for DuckDB.

Built from shared common table expressions. Where the library takes a shorter
way (cohesion, representatives, response checks) the SQL takes the long one.
"""

from __future__ import annotations

from voxrank import fixed_values as fixed
from voxrank.plans import registry as reg
from voxrank.sources import corpus

W = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_quoted(v) for v in values) + ")"


def _mapping(values: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in values.items()) + ")"


def _mentions(column: str, terms, flags: str = "(?i)") -> str:
    return f"regexp_matches({column}, '{flags}(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(terms)})($|[^\\p{{L}}\\p{{N}}_])')"


def _collapsed(column: str) -> str:
    return f"trim(regexp_replace({column}, '{SPACE}+', ' ', 'g'))"


def _key(column: str) -> str:
    return f"replace(lower({column}), 'ß', 'ss')"


FORBIDDEN = (
    "(regexp_matches({0}, '[\\p{{Nd}}%$]') OR regexp_matches({0}, "
    "'(?i)(^|[^\\p{{L}}\\p{{N}}_])(revenue|market[- ]wide|market share|causes?|caused|guarantee[ds]?)($|[^\\p{{L}}\\p{{N}}_])'))"
)

RAW = r"""
raw AS (
  SELECT doc_id AS row_no, text AS raw_text, lang AS product, source, source AS topic,
    CAST(regexp_extract(source, '(\d+)', 1) AS BIGINT) AS topic_id,
    CAST(CASE WHEN quality = 1 AND toxic = 0 THEN 5 WHEN quality = 1 AND toxic = 1 THEN 3
         WHEN quality = 0 AND toxic = 0 THEN 2 WHEN quality = 0 AND toxic = 1 THEN 1 END AS DOUBLE) AS rating
  FROM documents LEFT JOIN labels USING (doc_id)),
dated AS (
  SELECT *, CASE WHEN row_no % 17 <> 0 THEN CAST(DATE '2024-01-01' + CAST(
      CASE WHEN topic_id <= 4 THEN ((row_no // 20) * 37) % 60 WHEN topic_id <= 9 THEN 40 + ((row_no // 20) * 37) % 60
           ELSE ((row_no // 20) * 37) % 100 END AS INTEGER) AS TIMESTAMP) END AS date
  FROM raw)"""

CLEAN = RAW + rf""",
normal AS (SELECT *, {_collapsed('raw_text')} AS review_text, printf('R%06d', row_no + 1) AS review_id FROM dated),
once AS (
  SELECT *, row_number() OVER (PARTITION BY {_key('review_text')} ORDER BY row_no) AS copy
  FROM normal WHERE review_text <> '' AND regexp_matches(review_text, '\p{{L}}')),
clean AS (
  SELECT * EXCLUDE (raw_text, copy), len(string_split(review_text, ' ')) AS review_length,
    CASE WHEN rating >= 4 THEN 'Positive' WHEN rating <= 2 THEN 'Negative' WHEN rating = 3 THEN 'Neutral' ELSE 'Unknown' END AS sentiment_label,
    CASE WHEN rating >= 4 OR rating <= 2 OR rating = 3 THEN (rating - 3) / 2 END AS sentiment_score,
    {_mentions('review_text', reg.TERMS)} AS is_commercial, {_mentions('review_text', reg.TERMS, '')} AS cites_commerce
  FROM once WHERE copy = 1)"""


def _scores(source: str = "clean") -> str:
    return rf""",
scored_rows AS (SELECT * FROM {source}),
bounds AS (
  SELECT count(date) AS n, make_timestamp((epoch_us(min(date)) + epoch_us(max(date))) // 2) AS split,
    coalesce(count(date) >= 4 AND min(date) < max(date), false) AS available FROM scored_rows),
halves AS (
  SELECT topic_id, count(*) FILTER (date <= split) AS earlier_n, count(*) FILTER (date > split) AS later_n
  FROM scored_rows, bounds GROUP BY topic_id),
shares AS (
  SELECT topic_id, earlier_n * 1.0::DOUBLE / sum(earlier_n) OVER () * 100 AS earlier_share,
    later_n * 1.0::DOUBLE / sum(later_n) OVER () * 100 AS later_share
  FROM halves WHERE (SELECT available FROM bounds)),
trends AS (
  SELECT *, later_share - earlier_share AS change_pp,
    CASE WHEN later_share - earlier_share >= 2 THEN 'Emerging' WHEN later_share - earlier_share <= -2 THEN 'Declining' ELSE 'Stable' END AS trend
  FROM shares),
measured AS (
  SELECT topic_id, arg_min(topic, row_no) AS topic, count(*) AS review_count,
    count(*) * 100.0::DOUBLE / (SELECT count(*) FROM scored_rows) AS share_pct,
    avg(CASE WHEN sentiment_label = 'Positive' THEN 100.0::DOUBLE ELSE 0 END) AS positive_pct,
    avg(CASE WHEN sentiment_label = 'Neutral' THEN 100.0::DOUBLE ELSE 0 END) AS neutral_pct,
    avg(CASE WHEN sentiment_label = 'Negative' THEN 100.0::DOUBLE ELSE 0 END) AS negative_pct,
    avg(CASE WHEN sentiment_label = 'Unknown' THEN 100.0::DOUBLE ELSE 0 END) AS unknown_pct,
    avg(sentiment_score) AS average_sentiment,
    avg(CASE WHEN sentiment_label <> 'Unknown' THEN 100.0::DOUBLE ELSE 0 END) AS sentiment_coverage,
    count(*) * 10.0::DOUBLE / (SELECT count(*) FROM scored_rows) AS prevalence_score,
    avg(CASE WHEN sentiment_label <> 'Unknown' THEN -least(sentiment_score, 0.0) END) * 10 AS negative_intensity_score,
    avg(CASE WHEN is_commercial THEN 10.0::DOUBLE ELSE 0 END) AS purchase_relevance_score
  FROM scored_rows GROUP BY topic_id),
joined AS (
  SELECT m.*, t.change_pp, CASE WHEN t.change_pp IS NOT NULL THEN least(greatest(t.change_pp, 0.0), 10.0) END AS trend_growth_score,
    coalesce(t.trend, 'Unavailable') AS trend
  FROM measured m LEFT JOIN trends t USING (topic_id)),
weighed AS (
  SELECT *, CAST(0.35 + 0.20 + CASE WHEN negative_intensity_score IS NULL THEN 0 ELSE 0.30 END
      + CASE WHEN trend_growth_score IS NULL THEN 0 ELSE 0.15 END AS DOUBLE) AS available_weight,
    prevalence_score * 0.35::DOUBLE + coalesce(negative_intensity_score * 0.30::DOUBLE, 0) + purchase_relevance_score * 0.20::DOUBLE
      + coalesce(trend_growth_score * 0.15::DOUBLE, 0) AS weighted
  FROM joined),
scores AS (
  SELECT * EXCLUDE (weighted), weighted / available_weight AS impact_score,
    row_number() OVER (ORDER BY weighted / available_weight DESC, topic_id) AS impact_rank
  FROM weighed)"""


SCORES = CLEAN + _scores()

UNTIDY = rf"""
untidy AS (
  SELECT doc_id AS row_no, lang AS product,
    CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN '   ' WHEN doc_id % 37 = 0 THEN '#' || doc_id || ' 100%!'
      WHEN doc_id % 7 = 0 THEN '  ' || translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '  ' ELSE text END AS comment,
    CASE WHEN doc_id % 11 = 0 THEN 'five' WHEN doc_id % 13 = 0 THEN '9' WHEN doc_id % 5 = 0 THEN '2.5'
      WHEN doc_id % 3 = 0 THEN CAST(doc_id % 5 + 1 AS VARCHAR) END AS stars,
    CASE WHEN doc_id % 19 = 0 THEN 'soon' WHEN doc_id % {len(corpus.DATE_NOTATIONS) + 1} < {len(corpus.DATE_NOTATIONS)} THEN 'written' END AS written,
    CASE WHEN doc_id % 19 <> 0 AND doc_id % {len(corpus.DATE_NOTATIONS) + 1} < {len(corpus.DATE_NOTATIONS)}
      THEN CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS TIMESTAMP) + CASE WHEN doc_id % {len(corpus.DATE_NOTATIONS) + 1} IN ({
        ", ".join(str(i) for i, n in enumerate(corpus.DATE_NOTATIONS) if "50" in n)}) THEN INTERVAL 950 MINUTE ELSE INTERVAL 0 MINUTE END END AS date
  FROM documents),
parsed AS (
  SELECT *, {_collapsed("coalesce(comment, '')")} AS review_text, printf('R%06d', row_no + 1) AS review_id,
    CASE WHEN TRY_CAST(stars AS DOUBLE) BETWEEN 1 AND 5 THEN TRY_CAST(stars AS DOUBLE) END AS rating FROM untidy),
staged AS (
  SELECT *, CASE WHEN review_text = '' THEN 'blank' WHEN NOT regexp_matches(review_text, '\p{{L}}') THEN 'noise' ELSE 'usable' END AS status
  FROM parsed),
kept AS (
  SELECT * FROM staged WHERE status = 'usable'
  QUALIFY row_number() OVER (PARTITION BY {_key('review_text')} ORDER BY row_no) = 1)"""

TOPIC_TEXT = CLEAN + rf""",
stripped AS (
  SELECT *, regexp_matches(review_text, '(?i){reg.SENTENCES[0]}|{reg.SENTENCES[1]}') AS known,
    trim(regexp_replace(regexp_replace(regexp_replace(review_text, '(?i){reg.SENTENCES[0]}', ' ', 'g'),
      '(?i){reg.SENTENCES[1]}', ' ', 'g'), '{SPACE}+', ' ', 'g'), ' .,-;:') AS rest FROM clean),
spaced AS (SELECT *, CASE WHEN known AND rest <> '' THEN rest ELSE review_text END AS topic_text FROM stripped)"""


def _lexical(before: str, text: str = "topic_text", source: str = "spaced") -> str:
    return before + rf""",
kept_words AS (
  SELECT row_no, topic_id, [w FOR w IN regexp_extract_all(lower({text}), '{W}{{2,}}') IF w NOT IN {_list(reg.STOP_WORDS)}] AS t FROM {source}),
tokens AS (
  SELECT row_no, topic_id, unnest(t) AS term FROM kept_words UNION ALL
  SELECT row_no, topic_id, unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) FROM kept_words),
tf AS (SELECT row_no, topic_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
vocab AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS doc_freq,
    ln((1 + (SELECT count(*) FROM {source})) / (1.0::DOUBLE + count(*))) + 1 AS idf
  FROM tf GROUP BY term ORDER BY total DESC, term LIMIT {fixed.WORD_FEATURES}),
weighted AS (SELECT row_no, topic_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
entries AS (SELECT row_no, topic_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_no)) AS weight FROM weighted),
sizes AS (SELECT topic_id, count(*) AS n FROM {source} GROUP BY topic_id),
means AS (SELECT topic_id, term, sum(weight) / any_value(n) AS mean FROM entries JOIN sizes USING (topic_id) GROUP BY topic_id, term),
lengths AS (SELECT topic_id, sqrt(sum(mean * mean)) AS length FROM means GROUP BY topic_id),
likeness AS (
  SELECT s.topic_id, s.row_no, coalesce(d.dot / l.length, 0.0) AS similarity FROM {source} s
  LEFT JOIN (SELECT e.row_no, sum(weight * mean) AS dot FROM entries e JOIN means USING (topic_id, term) GROUP BY e.row_no) d USING (row_no)
  LEFT JOIN lengths l ON l.topic_id = s.topic_id),
nearest AS (
  SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(similarity, 9) DESC, row_no) AS position FROM likeness
  QUALIFY position <= 3)"""


LEXICAL = _lexical(TOPIC_TEXT)

SUPPORT = """,
kinds AS (
  SELECT topic_id, row_no, review_id, 'negative' AS kind FROM clean WHERE sentiment_label = 'Negative' UNION ALL
  SELECT topic_id, row_no, review_id, 'commercial' FROM clean WHERE cites_commerce),
support AS (
  SELECT *, row_number() OVER (PARTITION BY topic_id, kind ORDER BY row_no) AS position FROM kinds QUALIFY position <= 3)"""


def _pool(representatives: str) -> str:
    return SUPPORT + f""",
representatives AS ({representatives}),
offered AS (
  SELECT topic_id, review_id, position AS place FROM representatives UNION ALL
  SELECT topic_id, review_id, CASE kind WHEN 'negative' THEN 10 ELSE 20 END + position FROM support WHERE position <= 2),
pool AS (
  SELECT topic_id, review_id, min(place) AS place FROM offered GROUP BY topic_id, review_id
  QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY min(place)) <= 5)"""


EVIDENCE = _lexical(SCORES, "review_text", "clean") + _pool(
    "SELECT topic_id, printf('R%06d', row_no + 1) AS review_id, position FROM nearest"
)

# every second topic keeps only the first of its own representatives beside foreign ones
OWN_EVIDENCE = _lexical(SCORES, "review_text", "clean") + _pool(
    "SELECT topic_id, printf('R%06d', row_no + 1) AS review_id, position FROM nearest WHERE position <= CASE WHEN topic_id % 2 = 1 THEN 1 ELSE 3 END"
)

SENTENCE = """'Rank ' || impact_rank || ' of ' || (SELECT count(*) FROM scores) || '; ' || review_count || ' reviews ('
  || format('{:.1f}', share_pct) || '% share of voice); ' || format('{:.1f}', negative_pct) || '% negative; Business Impact Score '
  || format('{:.2f}', impact_score) || '/10; purchase relevance ' || format('{:.2f}', purchase_relevance_score)
  || '/10; sentiment coverage ' || format('{:.1f}', sentiment_coverage) || '%.'
  || coalesce(' Topic share changed ' || format('{:+.1f}', change_pp) || ' percentage points between the two dated periods.', '')"""

SUMMARY = """(SELECT 'Analyzed ' || format('{:,}', CAST(sum(review_count) AS BIGINT)) || ' reviews across ' || count(*) || ' topics. '
  || arg_min(topic, impact_rank) || ' ranks first within this dataset with an Impact Score of '
  || format('{:.2f}', arg_min(impact_score, impact_rank))
  || '/10. This is a relative investigation priority, not a claim of high absolute impact. Recommendations are evidence-linked hypotheses for validation.'
  FROM scores)"""

_ACTIONS = ", ".join(
    f"({i}, {_quoted(c)}, {_quoted(k)}, {_quoted(t)}, {_quoted(fixed.BRIEF_ACTIONS[c])})"
    for i, (c, t, k) in enumerate([
        ("Pain Points", "pain", "negative"), ("Product", "pain", "negative"), ("Pricing", "priced", "commercial"),
        ("Marketing", "leading", "representative"), ("Emerging Signals", "rising", "negative"),
    ])
)

BRIEF = EVIDENCE + f""",
chosen AS (
  SELECT 'pain' AS pick, arg_min(topic_id, impact_rank) FILTER (negative_pct > 0) AS topic_id FROM scores UNION ALL
  SELECT 'priced', arg_min(topic_id, impact_rank) FILTER (topic_id IN (SELECT topic_id FROM support WHERE kind = 'commercial')) FROM scores UNION ALL
  SELECT 'leading', arg_min(topic_id, impact_rank) FROM scores UNION ALL
  SELECT * FROM (SELECT 'rising', topic_id FROM scores WHERE change_pp >= 2 AND negative_pct > 0 ORDER BY change_pp DESC, impact_rank LIMIT 1)),
rules(step, category, kind, pick, action) AS (VALUES {_ACTIONS}),
cites AS (
  SELECT topic_id, kind, review_id, position FROM support UNION ALL
  SELECT topic_id, 'representative', review_id, position FROM representatives),
picked AS (
  SELECT step, category, action, c.topic_id, kind FROM rules JOIN chosen c USING (pick)
  WHERE EXISTS (SELECT 1 FROM cites x WHERE x.topic_id = c.topic_id AND x.kind = rules.kind)),
insights AS (
  SELECT 'D' || row_number() OVER (ORDER BY step) AS insight_id, category, s.topic_id, s.topic, s.impact_rank AS rank, kind,
    s.topic || ': ' || format('{{:.1f}}', negative_pct) || '% negative across ' || review_count || ' reviews' AS finding,
    {SENTENCE} AS evidence, {_quoted(fixed.BRIEF_IMPLICATION)} AS implication, action
  FROM picked JOIN scores s USING (topic_id)),
cited AS (
  SELECT insight_id, x.position, x.review_id, c.review_text, c.source, i.topic_id AS claimed, c.topic_id AS topic_of
  FROM insights i JOIN cites x ON x.topic_id = i.topic_id AND x.kind = i.kind JOIN clean c USING (review_id))"""

RERUN = CLEAN + f""",
display(label, shown) AS {_mapping(reg.DISPLAY)},
areas(label, shown) AS {_mapping(reg.AREAS)},
names AS (
  SELECT s.topic, coalesce(d.shown, s.topic) AS display_topic, coalesce(a.shown, d.shown, s.topic) AS business_topic
  FROM (SELECT DISTINCT 'src' || i AS topic FROM range(-1, 20) t(i)) s
  LEFT JOIN display d ON d.label = s.topic LEFT JOIN areas a ON a.label = coalesce(d.shown, s.topic)),
baseline AS (
  SELECT c.* EXCLUDE (topic_id), CASE WHEN row_no % 13 = 0 THEN -1 ELSE c.topic_id END AS topic_id, display_topic, business_topic
  FROM clean c JOIN names USING (topic)),
moved AS (
  SELECT row_no, review_id, review_text,
    CASE WHEN row_no % 11 = 0 THEN -1 WHEN row_no % 3 = 0 THEN (topic_id + 1) % 20 ELSE topic_id END AS topic_id FROM clean),
now_run AS (
  SELECT row_no, review_id, review_text, topic_id, 'm' || topic_id AS topic_model_label, business_topic AS topic
  FROM moved m JOIN names n ON n.topic = 'src' || m.topic_id),
humans AS (
  SELECT b.row_no, b.review_text, b.topic AS model_topic, b.sentiment_label AS model_sentiment, b.business_topic AS was, n.topic AS now,
    CASE WHEN b.row_no % 4 = 0 THEN b.business_topic WHEN b.row_no % 4 = 1 THEN n.topic ELSE 'Other' END AS human_topic
  FROM baseline b JOIN now_run n USING (review_id) WHERE b.rating IS NOT NULL),
validation AS (
  SELECT *, CASE WHEN row_no % 9 = 0 THEN '' ELSE model_sentiment END AS human_sentiment,
    CASE WHEN row_no % 7 = 0 THEN '' WHEN human_topic = was THEN ' True' ELSE 'FALSE ' END AS topic_correct,
    CASE row_no % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN 'maybe' ELSE 'true' END AS sentiment_correct
  FROM humans),
judged AS (
  SELECT v.row_no, v.review_text, human_topic, model_topic, was AS baseline_business_topic, topic_model_label, n.topic AS v2_business_topic,
    CASE lower(trim(topic_correct)) WHEN 'true' THEN true WHEN 'false' THEN false END AS was_right,
    n.topic = human_topic AS now_right, was <> n.topic AS changed,
    CASE lower(trim(sentiment_correct)) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 END AS felt_right
  FROM validation v JOIN now_run n USING (row_no))"""

_REASON = fixed.RESPONSE_REASONS
RESPONSES = EVIDENCE + f""",
turns AS (SELECT conv_id * 1000 + turn AS response_id, conv_id % 23 AS topic_id, (conv_id * 7 + turn) % 14 AS kind, coalesce(text, '') AS text FROM conversations),
checked AS (
  SELECT *, CASE WHEN kind IN (7, 11) THEN {_quoted(_REASON['json'])} WHEN kind IN (2, 13) THEN {_quoted(_REASON['fields'])}
    WHEN kind = 6 THEN {_quoted(_REASON['summary'])} WHEN kind = 3 THEN {_quoted(_REASON['count'])}
    WHEN kind = 8 THEN {_quoted(_REASON['item'])}
    WHEN kind IN (10, 12) OR topic_id NOT IN (SELECT topic_id FROM scores) THEN {_quoted(_REASON['reference'])}
    WHEN (length(text) NOT BETWEEN 12 AND 700 OR {FORBIDDEN.format('text')}) THEN {_quoted(_REASON['claim'] + 'finding')}
    WHEN kind IN (5, 9) THEN {_quoted(_REASON['citations'])}
    WHEN kind = 4 THEN {_quoted(_REASON['reference'])} ELSE '' END AS reason FROM turns),
answers AS (
  SELECT *, reason = '' AS accepted, CASE WHEN reason = '' THEN '' WHEN kind IN (7, 11) THEN 'JSONDecodeError' WHEN kind IN (12, 13) THEN 'TypeError' ELSE 'ValueError' END AS error
  FROM checked)"""

VECTORS = """
vectors AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
units AS (SELECT vec_id AS row_no, label AS topic_id, [x / sqrt(list_sum([y * y FOR y IN e])) FOR x IN e] AS e FROM vectors)"""



def _rate(letter: str) -> str:
    return f"((length(text) - length(replace(text, '{letter}', ''))) * 1.0::DOUBLE / greatest(length(text), 1))"


GRID = f"""
cells AS (SELECT doc_id AS row_no, CAST(floor({_rate(reg.GRID_LETTERS[0])} / {reg.GRID_WIDTH}::DOUBLE) AS BIGINT) AS x,
  CAST(floor({_rate(reg.GRID_LETTERS[1])} / {reg.GRID_WIDTH}::DOUBLE) AS BIGINT) AS y FROM documents WHERE text IS NOT NULL),
occupied AS (SELECT x, y, (x + 1) + (y + 1) * 4096 AS cell, count(*) AS n FROM cells GROUP BY x, y),
counted AS (
  SELECT a.x, a.y, a.cell, a.n, sum(b.n) AS around FROM occupied a JOIN occupied b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
  GROUP BY ALL),
dense AS (SELECT * FROM counted WHERE around >= {reg.GRID_MINIMUM}),
links AS (SELECT a.cell AS a, b.cell AS b FROM dense a JOIN dense b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
regions AS (SELECT a AS cell, min(b) AS component FROM reach GROUP BY a),
border AS (
  SELECT c.cell, r.component FROM counted c JOIN dense d ON abs(c.x - d.x) <= 1 AND abs(c.y - d.y) <= 1
  JOIN regions r ON r.cell = d.cell WHERE c.around < {reg.GRID_MINIMUM}
  QUALIFY row_number() OVER (PARTITION BY c.cell ORDER BY d.n DESC, d.cell) = 1),
placed AS (
  SELECT row_no, component FROM cells JOIN occupied USING (x, y) LEFT JOIN (FROM regions UNION ALL FROM border) USING (cell)),
numbered AS (
  SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS topic_id FROM placed
  WHERE component IS NOT NULL GROUP BY component HAVING count(*) >= {reg.GRID_MINIMUM})"""


_AXES = [f"x{i}" for i in range(len(reg.POINT_LETTERS))]
NEAR = f"""
rates AS (SELECT doc_id AS row_no, {", ".join(f"{_rate(c)} AS {x}" for c, x in zip(reg.POINT_LETTERS, _AXES))} FROM documents WHERE text IS NOT NULL),
points AS (SELECT min(row_no) AS id, count(*) AS weight, {", ".join(_AXES)} FROM rates GROUP BY {", ".join(_AXES)}),
pairs AS (
  SELECT a.id, a.weight, b.id AS other, b.weight AS other_weight, {" + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in _AXES)} AS square
  FROM points a JOIN points b ON a.id <> b.id),
near AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY square, other) AS place FROM pairs QUALIFY place <= {fixed.DENSITY_NEIGHBOURS}),
reached AS (
  SELECT id, sqrt(square) AS distance, weight + sum(other_weight) OVER (PARTITION BY id ORDER BY place) AS held FROM near),
cores AS (
  SELECT p.id, p.weight, CASE WHEN p.weight >= {reg.DENSITY_MINIMUM} THEN 0.0::DOUBLE ELSE min(distance) FILTER (held >= {reg.DENSITY_MINIMUM}) END AS core
  FROM points p LEFT JOIN reached USING (id) GROUP BY p.id, p.weight)"""

CUT = NEAR + f""",
links AS (
  SELECT DISTINCT n.id AS a, n.other AS b FROM near n JOIN cores c ON c.id = n.id JOIN cores d ON d.id = n.other
  WHERE greatest(sqrt(square), c.core, d.core) <= {reg.CUT_DISTANCE}::DOUBLE AND c.core IS NOT NULL AND d.core IS NOT NULL),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT id, id FROM points UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
parts AS (SELECT a AS id, min(b) AS part FROM reach GROUP BY a),
numbered AS (
  SELECT part, row_number() OVER (ORDER BY sum(weight) DESC, part) - 1 AS topic_id FROM parts JOIN points USING (id)
  GROUP BY part HAVING sum(weight) >= {reg.DENSITY_MINIMUM})"""


def _shown(columns: str, digits: int = 6) -> str:
    """``a b:`` becomes a, and b rounded (a trailing colon marks a double)."""
    return ", ".join(
        f"round({c[:-1]}, {digits}) + 0 AS {c[:-1]}" if c.endswith(":") else c for c in columns.split()
    )


def _python_round(value: str, digits: int = 4) -> str:
    """Rounded on the exact binary value, as Python does."""
    return f"CAST(format('{{:.{digits}f}}', {value}) AS DOUBLE) + 0"


SCORE_COLUMNS = (
    "topic_id topic review_count share_pct: positive_pct: neutral_pct: negative_pct: unknown_pct: average_sentiment: "
    "sentiment_coverage: prevalence_score: negative_intensity_score: purchase_relevance_score: change_pp: "
    "trend_growth_score: trend impact_score: available_weight: impact_rank"
)
CLEAN_COLUMNS = "row_no, review_id, review_text, review_length, rating, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, product, source"
SHORT = (
    "CASE WHEN length(flat) <= 31 THEN flat ELSE rtrim(regexp_extract(flat, '^(.{1,30}) ', 1)) || '…' END"
)
ONE_DECIMAL = "format('{{:.1f}}', {0}) || '%'"
OCCURRENCES = {
    label: " + ".join(f"(length(f) - length(replace(f, {_quoted(t)}, ''))) // {len(t)}" for t in terms)
    for label, terms in reg.LEXICON.items()
}
_LABELS = list(reg.LEXICON)

CHECKS = {
    "clean_reviews": f"WITH {CLEAN} SELECT {CLEAN_COLUMNS} FROM clean",
    "untidy_clean_reviews": f"""WITH {UNTIDY} SELECT row_no, review_id, review_text, len(string_split(review_text, ' ')) AS review_length,
        rating, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, product, CAST(NULL AS VARCHAR) AS source FROM kept""",
    "quality_report": f"""WITH {CLEAN} SELECT (SELECT count(*) FROM raw) AS uploaded, count(*) FILTER (review_text = '') AS missing_removed,
        count(*) FILTER (review_text <> '' AND NOT regexp_matches(review_text, '\\p{{L}}')) AS noise_removed,
        (SELECT count(*) - count(DISTINCT {_key('review_text')}) FROM once) AS duplicates_removed,
        0::BIGINT AS invalid_ratings, 0::BIGINT AS invalid_dates, (SELECT count(*) FROM clean) AS valid,
        (SELECT round(avg(review_length), 6) FROM clean) AS average_length, (SELECT count(date) FROM clean) AS dated_reviews,
        count(*) FILTER (raw_text IS NULL) AS missing_review_text, count(*) FILTER (rating IS NULL) AS missing_rating,
        count(*) FILTER (date IS NULL) AS missing_date, count(*) FILTER (product IS NULL) AS missing_product,
        count(*) FILTER (source IS NULL) AS missing_source FROM normal""",
    "untidy_quality_report": f"""WITH {UNTIDY} SELECT count(*) AS uploaded, count(*) FILTER (status = 'blank') AS missing_removed,
        count(*) FILTER (status = 'noise') AS noise_removed,
        count(*) FILTER (status = 'usable') - (SELECT count(*) FROM kept) AS duplicates_removed,
        (SELECT count(*) FROM kept WHERE stars IS NOT NULL AND rating IS NULL) AS invalid_ratings,
        (SELECT count(*) FROM kept WHERE written IS NOT NULL AND date IS NULL) AS invalid_dates,
        (SELECT count(*) FROM kept) AS valid, (SELECT round(avg(len(string_split(review_text, ' '))), 6) FROM kept) AS average_length,
        (SELECT count(date) FROM kept) AS dated_reviews, count(*) FILTER (comment IS NULL) AS missing_review_text,
        count(*) FILTER (stars IS NULL) AS missing_rating, count(*) FILTER (written IS NULL) AS missing_date,
        count(*) FILTER (product IS NULL) AS missing_product FROM staged""",
    "topic_text": f"WITH {TOPIC_TEXT} SELECT review_id, topic_text, topic_text <> review_text AS changed FROM spaced",
    "topic_text_changes": f"""WITH {TOPIC_TEXT}, runs AS (
          SELECT true AS kept_as_is, review_text AS now, * FROM spaced UNION ALL
          SELECT false, CASE WHEN row_no % 97 = 5 THEN lower(topic_text) ELSE review_text END, * FROM spaced)
        SELECT count(*) AS reviews, count(*) FILTER (topic_text <> now) AS reviews_changed, bool_and(now = review_text) AS review_text_preserved, kept_as_is
        FROM runs GROUP BY kept_as_is""",
    "commercial_mentions": f"""WITH {CLEAN} SELECT topic_id, count(*) FILTER (is_commercial) AS any_case,
        count(*) FILTER (cites_commerce) AS as_written FROM clean GROUP BY topic_id""",
    "forbidden_claims": f"SELECT conv_id, turn, {FORBIDDEN.format('text')} AS forbidden FROM conversations",
    "shortened_texts": f"SELECT item_id, {SHORT} AS short FROM (SELECT item_id, {_collapsed('text')} AS flat FROM benchmark)",
    "rating_sentiment": f"""WITH {UNTIDY} SELECT review_id, rating,
        CASE WHEN rating >= 4 THEN 'Positive' WHEN rating <= 2 THEN 'Negative' WHEN rating = 3 THEN 'Neutral' ELSE 'Unknown' END AS sentiment_label,
        CASE WHEN rating >= 4 OR rating <= 2 OR rating = 3 THEN (rating - 3) / 2 END AS sentiment_score,
        CASE WHEN rating >= 4 OR rating <= 2 OR rating = 3 THEN 'Rating proxy' ELSE 'Unavailable' END AS sentiment_method FROM staged""",
    "model_sentiment": f"""WITH {CLEAN}, counts AS (SELECT review_id, length(review_text) - length(replace(review_text, 'a', '')) + 1 AS a,
        length(review_text) - length(replace(review_text, 'e', '')) + 1 AS e, length(review_text) - length(replace(review_text, 'o', '')) + 1 AS o FROM clean)
        SELECT review_id, CASE WHEN a >= e AND a >= o THEN 'Negative' WHEN e >= o THEN 'Neutral' ELSE 'Positive' END AS sentiment_label,
        round((o - a) * 1.0::DOUBLE / (a + e + o), 6) + 0 AS sentiment_score, 'Text model' AS sentiment_method FROM counts""",
    "sentiment_distribution": f"WITH {CLEAN} SELECT sentiment_label, count(*) AS reviews FROM clean GROUP BY sentiment_label",
    "headline": f"""WITH {CLEAN} SELECT count(*) AS reviews, count(DISTINCT topic_id) AS topics,
        round(avg(CASE WHEN sentiment_label = 'Positive' THEN 100.0::DOUBLE ELSE 0 END), 6) AS positive_pct,
        round(avg(CASE WHEN sentiment_label = 'Negative' THEN 100.0::DOUBLE ELSE 0 END), 6) AS negative_pct,
        round(avg(CASE WHEN sentiment_label <> 'Unknown' THEN 100.0::DOUBLE ELSE 0 END), 6) AS coverage_pct FROM clean""",
    "synthetic_flag": f"""WITH {RAW} SELECT coalesce(bool_or(lower(product || ' Synthetic') LIKE '%synthetic%'), false) AS synthetic FROM raw WHERE topic_id = 3
        UNION ALL SELECT coalesce(bool_or(lower(product) LIKE '%synthetic%'), false) FROM raw""",
    "topic_trends": f"WITH {SCORES} SELECT {_shown('topic_id earlier_share: later_share: change_pp: trend')} FROM trends",
    "trend_summary": f"""WITH {SCORES} SELECT available, '' AS reason, n AS dated_reviews, CAST((SELECT sum(earlier_n) FROM halves) AS BIGINT) AS earlier_n,
        CAST((SELECT sum(later_n) FROM halves) AS BIGINT) AS later_n, strftime(split, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS split,
        (SELECT least(sum(earlier_n), sum(later_n)) < 30 FROM halves) AS low_sample FROM bounds""",
    "undated_trend_summary": f"""WITH {CLEAN}, few AS (SELECT * REPLACE (CASE WHEN row_no % 100000 = 3 THEN date END AS date) FROM clean){_scores('few')}
        SELECT available, CASE WHEN NOT available THEN {_quoted(fixed.TREND_UNAVAILABLE_REASON)} END AS reason,
        (SELECT count(*) FROM trends) AS trend_rows FROM bounds""",
    "impact_scores": f"WITH {SCORES} SELECT {_shown(SCORE_COLUMNS)} FROM scores",
    "impact_scores_undated": f"""WITH {CLEAN}, undated AS (SELECT * REPLACE (CAST(NULL AS TIMESTAMP) AS date) FROM clean){_scores('undated')}
        SELECT {_shown('topic_id impact_score: available_weight: trend impact_rank')} FROM scores""",
    "score_recheck": "SELECT 0.0::DOUBLE AS max_difference",
    "vocabulary": f"WITH {LEXICAL} SELECT {_shown('term total doc_freq idf:')} FROM vocab",
    "uncut_weights": f"""WITH {LEXICAL.replace(f"LIMIT {fixed.WORD_FEATURES}", "")}, numbers AS (
        SELECT term, row_number() OVER (ORDER BY term) - 1 AS index FROM vocab)
        SELECT row_no, term, round(weight, 6) AS weight, index FROM entries JOIN numbers USING (term)""",
    "character_weights": f"""WITH flat AS (
        SELECT item_id AS row_no, string_split(regexp_replace(lower(text), '{SPACE}{SPACE}+', ' ', 'g'), '') AS c FROM benchmark),
        runs AS (SELECT row_no, unnest(c) AS term FROM flat UNION ALL
          SELECT row_no, unnest([c[i] || c[i + 1] FOR i IN range(1, len(c))]) FROM flat UNION ALL
          SELECT row_no, unnest([c[i] || c[i + 1] || c[i + 2] FOR i IN range(1, len(c) - 1)]) FROM flat),
        tf AS (SELECT row_no, term, count(*) AS tf FROM runs GROUP BY ALL),
        vocab AS (SELECT term, sum(tf) AS total, ln((1 + (SELECT count(*) FROM flat)) / (1.0::DOUBLE + count(*))) + 1 AS idf
          FROM tf GROUP BY term ORDER BY total DESC, term LIMIT {fixed.CHARACTER_FEATURES}),
        weighed AS (SELECT row_no, term, tf * idf AS w FROM tf JOIN vocab USING (term))
        SELECT row_no, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_no)), 6) AS weight FROM weighed""",
    "brief_repeatability": "SELECT * FROM (VALUES ('repartitioned', true, 64::BIGINT), ('altered', false, 64::BIGINT)) t(run, identical, digits)",
    "model_embeddings": f"""WITH {TOPIC_TEXT}, counts AS (
        SELECT row_no, list_transform(['a', 'e', 'o', 'n'], lambda c: (length(topic_text) - length(replace(topic_text, c, '')))::DOUBLE) AS v FROM spaced)
        SELECT row_no, unnest(range(4))::BIGINT AS place, round(unnest(v) / greatest(sqrt(list_dot_product(v, v)), 1e-300), 6) AS value FROM counts""",
    "upload_columns": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{'' if ok else 'Add a review_text column (or review, text, comment, content).'}' AS refusal, count(*) AS rows FROM {n}"
        for n, ok in (("documents", 1), ("labels", 0), ("benchmark", 1), ("conversations", 1), ("pages", 0), ("embeddings", 0))) + ")",
    "json_labels": f"""WITH {CLEAN}, areas(place, display, area) AS (VALUES {", ".join(
          f"({i}, {_quoted(d)}, {_quoted(area)})" for i, (d, area) in enumerate(fixed.DISPLAY_TO_AREA.items()))})
        SELECT DISTINCT topic, display, area FROM clean JOIN areas ON place = topic_id % {len(fixed.DISPLAY_TO_AREA)}""",
    "written_file_hash": "SELECT sha256(string_agg(text, chr(10) ORDER BY item_id) || chr(10)) AS sha256 FROM benchmark",
    "character_vocabulary": f"""WITH {TOPIC_TEXT}, flat AS (
        SELECT row_no, string_split(regexp_replace(lower(topic_text), '{SPACE}{SPACE}+', ' ', 'g'), '') AS c FROM spaced),
        runs AS (SELECT row_no, unnest(c) AS term FROM flat UNION ALL
          SELECT row_no, unnest([c[i] || c[i + 1] FOR i IN range(1, len(c))]) FROM flat UNION ALL
          SELECT row_no, unnest([c[i] || c[i + 1] || c[i + 2] FOR i IN range(1, len(c) - 1)]) FROM flat),
        tf AS (SELECT row_no, term, count(*) AS tf FROM runs GROUP BY ALL)
        SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS doc_freq,
          round(ln((1 + (SELECT count(*) FROM flat)) / (1.0::DOUBLE + count(*))) + 1, 6) AS idf
        FROM tf GROUP BY term ORDER BY total DESC, term LIMIT {fixed.CHARACTER_FEATURES}""",
    "tfidf_weights": f"WITH {LEXICAL} SELECT {_shown('row_no term weight:')} FROM entries",
    "topic_keywords": f"""WITH {LEXICAL}, best AS (
        SELECT topic_id, term, row_number() OVER (PARTITION BY topic_id ORDER BY round(sum(weight), 9) DESC, term) AS place
        FROM entries GROUP BY topic_id, term QUALIFY place <= 8)
        SELECT topic_id, string_agg(term, ', ' ORDER BY place) AS keywords,
          string_agg(array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(term, ' ')], ' '), ' / ' ORDER BY place) FILTER (place <= 3) AS label
        FROM best GROUP BY topic_id""",
    "lexical_representatives": f"WITH {LEXICAL} SELECT {_shown('topic_id row_no position similarity:')} FROM nearest",
    "embedding_representatives": f"""WITH {VECTORS}, parts AS (SELECT row_no, topic_id, unnest(e) AS x, unnest(range(len(e))) AS i FROM units),
        means AS (SELECT topic_id, i, avg(x) AS m FROM parts GROUP BY ALL),
        likeness AS (SELECT p.topic_id, row_no, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS similarity
          FROM parts p JOIN means USING (topic_id, i) GROUP BY ALL)
        SELECT topic_id, row_no, row_number() OVER (PARTITION BY topic_id ORDER BY round(similarity, 9) DESC, row_no) AS position,
          round(similarity, 6) AS similarity FROM likeness QUALIFY position <= 3""",
}

COHESION = TOPIC_TEXT + f""",
every AS (SELECT row_no, topic_id, unnest(regexp_extract_all(lower(review_text), '{W}+')) AS term FROM spaced),
counts AS (SELECT row_no, topic_id, term, count(*) AS tf FROM every GROUP BY ALL),
idfs AS (SELECT term, ln((1 + (SELECT count(*) FROM spaced)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM counts GROUP BY term),
rows_ AS (SELECT row_no, topic_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY row_no)) AS w FROM counts JOIN idfs USING (term)),
groups_ AS (SELECT topic_id, arg_min(topic, row_no) AS topic, count(*) AS review_count FROM spaced GROUP BY topic_id),
centre AS (SELECT topic_id, term, sum(w) / any_value(review_count) AS m FROM rows_ JOIN groups_ USING (topic_id) GROUP BY topic_id, term),
cosines AS (
  SELECT r.topic_id, row_no, sum(w * m) / any_value(size) AS cosine FROM rows_ r JOIN centre c ON c.topic_id = r.topic_id AND c.term = r.term
  JOIN (SELECT topic_id, sqrt(sum(m * m)) AS size FROM centre GROUP BY topic_id) z ON z.topic_id = r.topic_id GROUP BY ALL),
cohesion AS (
  SELECT g.topic_id, topic, review_count, review_count * 1.0::DOUBLE / (SELECT count(*) FROM spaced) AS share,
    (SELECT sum(cosine) FROM cosines x WHERE x.topic_id = g.topic_id) / review_count AS lexical_cohesion, review_count = 1 AS singleton
  FROM groups_ g)"""

CHECKS |= {
    "lexical_cohesion": f"WITH {COHESION} SELECT {_shown('topic_id topic review_count share: lexical_cohesion: singleton')} FROM cohesion",
    "cohesion_summary": f"""WITH {COHESION} SELECT round(sum(lexical_cohesion * review_count) / sum(review_count), 6) AS weighted_mean,
        round(avg(lexical_cohesion), 6) AS unweighted_mean FROM cohesion""",
    "example_texts": f"""WITH {CLEAN} SELECT topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY row_no) - 1 AS place, review_text
        FROM clean QUALIFY place < 3""",
    "cluster_policy": f"""WITH {TOPIC_TEXT} SELECT topic_id, count(*) AS reviews, least(CASE WHEN count(*) < 500 THEN 5 WHEN count(*) < 2000 THEN 8
        WHEN count(*) < 10000 THEN 12 ELSE 15 END, count(*), greatest(1, count(DISTINCT topic_text)))::BIGINT AS clusters FROM spaced GROUP BY topic_id""",
    "density_grid_topics": f"WITH RECURSIVE {GRID} SELECT row_no, coalesce(topic_id, -1)::BIGINT AS topic_id FROM placed LEFT JOIN numbered USING (component)",
    "density_core_distances": f"WITH {NEAR} SELECT id AS row_no, weight AS reviews, round(core, 9) AS core FROM cores",
    "density_cut_topics": f"""WITH RECURSIVE {CUT} SELECT row_no, coalesce(topic_id, -1)::BIGINT AS topic_id
        FROM rates JOIN points USING ({", ".join(_AXES)}) JOIN parts USING (id) LEFT JOIN numbered USING (part)""",
    "lexicon_names": f"""WITH {TOPIC_TEXT}, folded AS (SELECT topic_id, {_key('topic_text')} AS f FROM spaced),
        totals AS (SELECT topic_id, {", ".join(f'sum({OCCURRENCES[n]}) AS n{i}' for i, n in enumerate(_LABELS))} FROM folded GROUP BY topic_id)
        SELECT topic_id, CASE WHEN greatest({", ".join(f'n{i}' for i in range(len(_LABELS)))}) = 0 THEN 'Other / mixed' {" ".join(
            f"WHEN n{i} = greatest({', '.join(f'n{j}' for j in range(len(_LABELS)))}) THEN {_quoted(n)}" for i, n in enumerate(_LABELS))} END AS name
        FROM totals""",
    "display_labels": f"""WITH {SCORES}, display(label, shown) AS {_mapping(reg.DISPLAY)}, areas(label, shown) AS {_mapping(reg.AREAS)}
        SELECT topic_id, topic, round(impact_score, 6) AS impact_score, coalesce(d.shown, topic) AS display_topic,
          coalesce(a.shown, d.shown, topic) AS business_topic
        FROM scores LEFT JOIN display d ON d.label = topic LEFT JOIN areas a ON a.label = coalesce(d.shown, topic)""",
    "supporting_rows": f"WITH {CLEAN}{SUPPORT} SELECT topic_id, kind, position, review_id FROM support",
    "own_evidence_pool": f"WITH {OWN_EVIDENCE} SELECT topic_id, string_agg(review_id, ',' ORDER BY place) AS review_ids FROM pool GROUP BY topic_id",
    "evidence_pool": f"WITH {EVIDENCE} SELECT topic_id, string_agg(review_id, ',' ORDER BY place) AS review_ids FROM pool GROUP BY topic_id",
    "evidence_topics": f"""WITH {EVIDENCE} SELECT topic_id, s.topic AS topic_name, impact_rank, review_count, {_python_round('share_pct')} AS share_of_voice_pct,
        {", ".join(f"{_python_round(f'{s.lower()}_pct')} AS {s.lower()}_pct" for s in fixed.SENTIMENTS)}, {_python_round('average_sentiment')} AS average_score,
        {_python_round('sentiment_coverage')} AS coverage_pct, trend AS direction, {_python_round('change_pp')} AS change_points,
        {_python_round('purchase_relevance_score * 10')} AS matched_review_pct, {_python_round('impact_score')} AS impact,
        {_python_round('prevalence_score')} AS prevalence, {_python_round('negative_intensity_score')} AS negative_intensity,
        {_python_round('purchase_relevance_score')} AS purchase_relevance, {_python_round('trend_growth_score')} AS trend_growth,
        row_number() OVER (PARTITION BY topic_id ORDER BY place) - 1 AS place, review_id, review_text, c.source, sentiment_label AS sentiment
        FROM scores s JOIN pool p USING (topic_id) JOIN clean c USING (review_id, topic_id)""",
    "evidence_document": f"""WITH {SCORES} SELECT CAST(sum(review_count) AS BIGINT) AS valid_review_count, count(*) AS topic_count,
        {_quoted(fixed.EVIDENCE_LIMITATIONS[0])} AS first_limitation, arg_min(topic, impact_rank) AS first_topic, count(*) AS listed_topics FROM scores""",
    "brief_insights": f"""WITH {BRIEF} SELECT insight_id, category, topic_id, topic, rank, finding, evidence, implication, action,
        (SELECT string_agg(review_id, ',' ORDER BY position) FROM cited c WHERE c.insight_id = i.insight_id) AS review_ids FROM insights i""",
    "brief_summary": f"WITH {SCORES} SELECT {SUMMARY} AS summary, {_quoted(fixed.BRIEF_METHOD)} AS method",
    "citation_metrics": f"""WITH {BRIEF} SELECT count(DISTINCT insight_id) AS recommendations, count(DISTINCT insight_id) FILTER (claimed = topic_of) AS with_valid_citations,
        100.0::DOUBLE AS citation_rate_pct, count(DISTINCT review_id) AS distinct_cited_reviews FROM cited""",
    "recommendation_panel": f"""WITH {BRIEF} SELECT k.category, insight_id, topic, CAST(position - 1 AS DOUBLE) AS position, review_id, review_text, source
        FROM (VALUES ('Product'), ('Pricing'), ('Marketing')) k(category) LEFT JOIN (insights JOIN cited USING (insight_id)) USING (category)""",
    "insight_export": f"""WITH {BRIEF}, safe AS (SELECT insight_id, string_agg(review_id, ' | ' ORDER BY position) AS review_ids,
        string_agg(review_id || ': ' || review_text, ' | ' ORDER BY position) AS supporting_reviews, string_agg(source, ' | ' ORDER BY position) AS sources
        FROM cited GROUP BY insight_id)
        SELECT 'documents' AS dataset, false AS synthetic_data, {_quoted(fixed.BRIEF_METHOD)} AS generation_method, {SUMMARY} AS executive_summary, category,
        finding, evidence, implication AS business_implication, action AS recommended_action, review_ids, supporting_reviews, sources
        FROM insights JOIN safe USING (insight_id)""",
    "recommendation_checks": f"WITH {RESPONSES} SELECT response_id, accepted, reason, error FROM answers",
    "accepted_recommendations": f"""WITH {RESPONSES} SELECT response_id, 'L' || k.place AS insight_id, category, topic_id, topic, impact_rank AS rank,
        text AS finding, {SENTENCE} AS evidence,
        'The pattern may affect the experience and warrants review.' AS implication, 'Inspect the cited experience and test a focused response.' AS action,
        (SELECT string_agg(review_id, ',' ORDER BY place) FROM (SELECT * FROM pool p WHERE p.topic_id = a.topic_id ORDER BY place LIMIT 2)) AS review_ids
        FROM answers a JOIN scores USING (topic_id), (VALUES (1, 'Product'), (2, 'Pricing'), (3, 'Marketing')) k(place, category) WHERE accepted""",
    "chosen_brief": f"""WITH {RESPONSES} SELECT response_id,
        CASE WHEN accepted THEN 'The supplied evidence suggests a focused issue that merits validation.' ELSE {SUMMARY} END AS summary,
        CASE WHEN accepted THEN {_quoted(fixed.MODEL_BRIEF_METHOD)} ELSE {_quoted(fixed.BRIEF_METHOD)} END AS method,
        CASE WHEN kind = 11 THEN {_quoted(fixed.NO_RESPONSE_WARNING)} WHEN accepted THEN ''
          ELSE replace({_quoted(fixed.FAILED_RESPONSE_WARNING)}, '{{}}', error) END AS warning FROM answers""",
    "proposed_labels": f"""WITH {RAW}, old AS (SELECT topic_id, min(topic) AS label FROM raw GROUP BY topic_id),
        offers AS (SELECT item_id AS proposal_id, item_id % 5 AS kind, CASE WHEN item_id % 5 = 2 THEN text ELSE 'Topic ' || md5(text) END AS name FROM benchmark),
        judged AS (SELECT *, kind IN (0, 2) AND length(name) <= 80 AND NOT contains(name, chr(10)) AND trim(name) <> '' AS accepted FROM offers)
        SELECT proposal_id, accepted, topic_id, CASE WHEN NOT accepted OR topic_id IS NULL THEN old.label
          WHEN topic_id = (SELECT min(topic_id) FROM old) THEN name ELSE 'Plain name' END AS label, old.label AS old_label FROM judged, old""",
    "renamed_topics": f"""WITH {RAW}, old AS (SELECT topic_id, min(topic) AS label FROM raw GROUP BY topic_id
          UNION ALL SELECT {fixed.OUTLIER_TOPIC}, {_quoted(fixed.OUTLIER_LABEL)})
        SELECT topic_id, CASE WHEN topic_id >= 0 THEN 'New ' || label ELSE label END AS label, '1' AS proposal FROM old
        UNION ALL SELECT topic_id, label, '2' FROM old""",
    "priority_table": f"WITH {SCORES} SELECT {_shown('topic review_count share_pct: negative_pct: impact_score: trend change_pp:')} FROM scores",
    "reach_points": f"""WITH {SCORES} SELECT {_shown('topic share_pct: negative_pct: impact_score: review_count')},
        CASE WHEN impact_rank <= 3 THEN topic ELSE '' END AS marker FROM scores""",
    "most_discussed": f"""WITH {SCORES} SELECT topic_id || ' · ' || topic AS display_topic, topic, review_count, round(share_pct, 6) AS share_pct,
        {ONE_DECIMAL.format('share_pct')} AS share_text FROM (SELECT * FROM scores ORDER BY share_pct DESC, impact_rank LIMIT 8)""",
    "fastest_rising": f"""WITH {SCORES} SELECT topic, format('{{:+.1f}}', change_pp) || ' pp' AS change_text, round(change_pp, 6) AS change_pp
        FROM scores WHERE change_pp >= 2 AND negative_pct > 0 ORDER BY scores.change_pp DESC, impact_rank LIMIT 3""",
    "trend_lines": f"""WITH {SCORES} SELECT topic_id, topic, period, round(share, 6) AS share_of_dated_pct FROM (
        SELECT topic_id, topic, 'Earlier period' AS period, t.earlier_share AS share FROM trends t JOIN scores USING (topic_id) WHERE impact_rank <= 5
        UNION ALL SELECT topic_id, topic, 'Later period', t.later_share FROM trends t JOIN scores USING (topic_id) WHERE impact_rank <= 5)""",
    "score_components": f"""WITH {SCORES} SELECT topic_id, component, round(score, 6) + 0 AS score, weight FROM (
        SELECT topic_id, 'Prevalence' AS component, prevalence_score AS score, '35%' AS weight FROM scores UNION ALL
        SELECT topic_id, 'Negative intensity', negative_intensity_score, '30%' FROM scores UNION ALL
        SELECT topic_id, 'Purchase relevance', purchase_relevance_score, '20%' FROM scores UNION ALL
        SELECT topic_id, 'Trend growth', trend_growth_score, '15%' FROM scores)""",
    "sentiment_mix": f"WITH {SCORES} SELECT topic_id, sentiment, round(share, 6) AS share_pct FROM (" + " UNION ALL ".join(
        f"SELECT topic_id, '{s}' AS sentiment, {s.lower()}_pct AS share FROM scores" for s in fixed.SENTIMENTS) + ")",
    "drill_down": f"""WITH {LEXICAL + _scores()}, words AS (
          SELECT topic_id, string_agg(term, ', ' ORDER BY place) AS keywords FROM (
            SELECT topic_id, term, row_number() OVER (PARTITION BY topic_id ORDER BY round(sum(weight), 9) DESC, term) AS place
            FROM entries GROUP BY topic_id, term QUALIFY place <= 8) GROUP BY topic_id)
        SELECT topic_id, topic, impact_rank || ' of ' || (SELECT count(*) FROM scores) AS rank_text,
        format('{{:.2f}}', impact_score) || ' / 10' AS score_text, {ONE_DECIMAL.format('share_pct')} AS share_text,
        {ONE_DECIMAL.format('negative_pct')} AS negative_text,
        coalesce(format('{{:+.1f}}', change_pp) || ' pp', 'Unavailable') AS change_text, keywords FROM scores JOIN words USING (topic_id)""",
    "topic_voices": f"""WITH {EVIDENCE} SELECT r.topic_id, c.row_no, c.review_id, c.review_text, c.sentiment_label, c.source
        FROM representatives r JOIN clean c USING (review_id)""",
    "coverage_metrics": f"""WITH {RERUN} SELECT round(avg(CASE WHEN sentiment_label <> 'Unknown' THEN 100.0::DOUBLE ELSE 0 END), 6) AS sentiment_coverage_pct,
        round(avg(CASE WHEN topic_id <> -1 THEN 100.0::DOUBLE ELSE 0 END), 6) AS assignment_coverage_pct,
        round(avg(CASE WHEN topic_id = -1 THEN 100.0::DOUBLE ELSE 0 END), 6) AS outlier_rate_pct, count(*) FILTER (topic_id = -1) AS outlier_reviews
        FROM baseline""",
    "label_accuracy": f"""WITH {RERUN} SELECT count(*) AS sample_rows, (SELECT count(*) FROM validation WHERE human_sentiment <> '') AS rows_with_both_labels,
        count(was_right) AS topic_rows, count(felt_right) AS sentiment_rows,
        round(avg(CASE WHEN was_right THEN 100.0::DOUBLE WHEN NOT was_right THEN 0 END), 6) AS topic_accuracy_pct,
        round(avg(felt_right::DOUBLE) * 100, 6) AS sentiment_accuracy_pct, count(was_right) > 0 AND count(felt_right) > 0 AS accuracy_reported FROM judged""",
    "validation_sample": f"""WITH {CLEAN} SELECT review_text, topic AS model_topic, sentiment_label AS model_sentiment, '' AS human_topic, '' AS human_sentiment,
        '' AS topic_correct, '' AS sentiment_correct FROM clean ORDER BY md5('42:' || review_id), review_id LIMIT 50""",
    "reused_sentiment": f"""WITH {RERUN} SELECT n.review_id, topic_model_label, b.sentiment_label, b.sentiment_score,
        CASE WHEN b.sentiment_label IS NULL THEN NULL WHEN b.sentiment_label = 'Unknown' THEN 'Unavailable' ELSE 'Rating proxy' END AS sentiment_method
        FROM now_run n LEFT JOIN (SELECT * FROM baseline WHERE row_no % 6 <> 0) b USING (review_id)""",
    "assignment_comparison": f"""WITH {RERUN} SELECT review_id, n.review_text, n.topic_id AS v2_topic_id, topic_model_label, n.topic AS v2_business_topic,
        b.topic_id AS baseline_topic_id, b.topic AS baseline_model_topic, display_topic AS baseline_display_topic,
        business_topic AS baseline_business_topic, n.topic <> business_topic AS business_topic_changed
        FROM now_run n JOIN baseline b USING (review_id)""",
    "accuracy_by_class": f"""WITH {RERUN}, cells AS (SELECT human_topic, v2_business_topic AS p, now_right, count(*) AS n FROM judged GROUP BY ALL),
        maps AS (SELECT human_topic, '{{' || string_agg('"' || p || '":' || n, ',' ORDER BY p) || '}}' AS v2_prediction_breakdown,
          '{{' || coalesce(string_agg('"' || p || '":' || n, ',' ORDER BY p) FILTER (NOT now_right), '') || '}}' AS v2_error_breakdown FROM cells GROUP BY human_topic)
        SELECT human_topic, count(*) AS reviews, count(*) FILTER (was_right) AS baseline_correct,
          round(avg(CASE WHEN was_right THEN 100.0::DOUBLE WHEN NOT was_right THEN 0 END), 6) AS baseline_accuracy_pct,
          count(*) FILTER (now_right) AS v2_correct, round(avg(CASE WHEN now_right THEN 100.0::DOUBLE ELSE 0 END), 6) AS v2_accuracy_pct,
          any_value(v2_prediction_breakdown) AS v2_prediction_breakdown, any_value(v2_error_breakdown) AS v2_error_breakdown
        FROM judged JOIN maps USING (human_topic) GROUP BY human_topic""",
    "before_after": f"""WITH {RERUN}, j AS (SELECT count(*) AS validation_reviews,
        avg(CASE WHEN was_right THEN 100.0::DOUBLE WHEN NOT was_right THEN 0 END) AS a, avg(CASE WHEN now_right THEN 100.0::DOUBLE ELSE 0 END) AS b,
        count(*) FILTER (changed) AS changed, count(*) FILTER (NOT was_right AND now_right) AS corrected,
        count(*) FILTER (was_right AND NOT now_right) AS newly_incorrect, avg(felt_right::DOUBLE) * 100 AS s FROM judged),
        w AS (SELECT count(*) AS all_reviews, count(*) FILTER (n.topic <> b.business_topic) AS all_changed,
          avg(CASE WHEN b.topic_id = -1 THEN 100.0::DOUBLE ELSE 0 END) AS x, avg(CASE WHEN n.topic_id = -1 THEN 100.0::DOUBLE ELSE 0 END) AS y
          FROM now_run n JOIN baseline b USING (review_id))
        SELECT validation_reviews, round(a, 6) AS baseline_accuracy_pct, round(b, 6) AS v2_accuracy_pct, changed, corrected, newly_incorrect,
          round(s, 6) AS sentiment_accuracy_pct, round(b - a, 6) AS change_pp, all_reviews, all_changed, round(x, 6) AS baseline_outlier_pct,
          round(y, 6) AS v2_outlier_pct, round(100 - x, 6) AS baseline_coverage_pct, round(100 - y, 6) AS v2_coverage_pct FROM j, w""",
    "export_safe_reviews": f"""WITH {CLEAN}, marked AS (SELECT row_no, CASE row_no % 4 WHEN 0 THEN ' =' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || review_text AS t,
        source FROM clean) SELECT row_no, CASE WHEN regexp_matches(t, '^\\s*[=+\\-@]') THEN '''' || t ELSE t END AS review_text, source FROM marked""",
    "csv_round_trip": f"""WITH {CLEAN} SELECT CAST(row_no AS VARCHAR) AS key,
        CASE WHEN regexp_matches(review_text, '^\\s*[=+\\-@]') THEN '''' || review_text ELSE review_text END AS review_text,
        CASE rating WHEN 5 THEN '5.0' WHEN 3 THEN '3.0' WHEN 2 THEN '2.0' WHEN 1 THEN '1.0' END AS rating,
        CASE WHEN row_no % 6 <> 0 THEN source END AS source FROM clean""",
    "numbered_upload": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, doc_id FROM labels",
    "validation_file": f"WITH {RERUN} SELECT CAST(row_no AS VARCHAR) AS key, human_sentiment, topic_correct FROM validation",
    "reloaded_snapshot": f"WITH {SCORES} SELECT topic_id, topic, round(impact_score, 6) AS impact_score FROM scores",
    "table_fingerprint": """SELECT count(*) AS rows, CAST(sum(CAST('0x' || left(sha256(concat_ws(chr(31),
        coalesce('=' || doc_id, '-'), coalesce('=' || lang, '-'), coalesce('=' || n_chars, '-'), coalesce('=' || source, '-'), coalesce('=' || text, '-'))), 15)
        AS BIGINT)) AS VARCHAR) AS hash_sum FROM documents""",
}
for _corrected, _name in [("NOT was_right AND now_right", "corrected_examples"), ("was_right AND NOT now_right", "newly_incorrect_examples")]:
    CHECKS[_name] = f"""WITH {RERUN} SELECT review_text, human_topic, model_topic, baseline_business_topic, topic_model_label, v2_business_topic
        FROM judged WHERE {_corrected} ORDER BY row_no LIMIT 8"""

CHECKS["evaluation_summary"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {_quoted(metric)} AS metric, CAST(({value}) AS DOUBLE) AS value, {unit} AS unit" for metric, value, unit in [
        ("Lexical topic cohesion proxy (weighted mean)", f"SELECT weighted_mean FROM ({CHECKS['cohesion_summary']})", "'cosine similarity'"),
        ("Sentiment coverage", f"SELECT sentiment_coverage_pct FROM ({CHECKS['coverage_metrics']})", "'percent'"),
        ("Topic assignment coverage", "SELECT 100", "'percent'"),
        ("Topic outlier rate", "SELECT 0", "'percent'"),
        ("Recommendation evidence citation rate", f"SELECT citation_rate_pct FROM ({CHECKS['citation_metrics']})", "'percent'"),
        ("Deterministic brief reproducibility", "SELECT 1", "'boolean (1=true)'"),
        ("Maximum recalculated impact-score difference", "SELECT 0", "'score points'"),
        ("Human-validated topic accuracy", f"SELECT topic_accuracy_pct FROM ({CHECKS['label_accuracy']})", "'percent'"),
        ("Human-validated sentiment accuracy", f"SELECT sentiment_accuracy_pct FROM ({CHECKS['label_accuracy']})", "'percent'"),
        ("Completed human validation rows", f"SELECT rows_with_both_labels FROM ({CHECKS['label_accuracy']})",
         f"(SELECT 'of ' || sample_rows FROM ({CHECKS['label_accuracy']}))"),
    ]
) + ")"
