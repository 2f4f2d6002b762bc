"""DuckDB SQL that gives the same rows as the queries of this subpackage, where SQL can."""

from __future__ import annotations

_ALNUM = r"[^\p{L}\p{N}]+"

_CANON = rf"""
WITH parts AS (
  SELECT record_id, content, list_filter(regexp_split_to_array(coalesce(content, ''), '[\r\n;|\x{{85}}\x{{2028}}\x{{2029}}\x{{B}}\x{{C}}]+'), lambda p: regexp_matches(p, '[\p{{L}}\p{{N}}]')) AS p
  FROM source_docs
), keyed AS (
  SELECT record_id, regexp_replace(lower(coalesce(content, '')), '{_ALNUM}', '', 'g') AS letters,
    CASE WHEN len(p) >= 3 AND len(list_filter(p, lambda x: NOT regexp_matches(x, '^[^:=.!?]*\p{{L}}[^:=.!?]*(=|:)(?s:.*)[\p{{L}}\p{{N}}]')
                                                       OR regexp_matches(x, '^[^:=.!?]*[0-9]:[0-9]'))) = 0
      THEN chr(1) || array_to_string(list_sort(list_transform(p, lambda x: regexp_replace(lower(x), '{_ALNUM}', '', 'g'))), chr(1)) END AS fields
  FROM parts
), spelled AS (
  SELECT record_id, coalesce(min(fields) OVER (PARTITION BY letters), letters) AS root FROM keyed
), members AS (
  SELECT record_id, min(record_id) OVER (PARTITION BY root) AS first_id, count(*) OVER (PARTITION BY root) AS copies FROM spelled
)"""

_LATEST = """
WITH scored AS (
  SELECT question_id, chunk_id, score, logged_at FROM ranked
  WHERE question_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
), latest AS (
  SELECT question_id, chunk_id, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY logged_at DESC NULLS LAST, score DESC) = 1
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS place FROM latest
)"""

_SURVIVORS = (
    _CANON
    + """
, attributes AS (
  SELECT m.first_id, m.record_id, trim(lower(d.trust)) AS t, d.trust,
    CASE WHEN d.observed_at >= DATE '2000-01-01' AND NOT coalesce(d.observed_at > s.evaluation_date, FALSE) THEN d.observed_at END AS seen,
    CASE WHEN d.expires_at >= DATE '2000-01-01' THEN d.expires_at END AS expires,
    CASE WHEN trim(lower(d.license)) NOT IN ('', '-', '--', '?', 'n/a', 'na', 'none', 'null', 'nil', 'tbd', 'tba', 'todo', 'unknown', 'unspecified', 'undefined', 'missing', 'not specified', 'not available', '...') THEN d.license END AS license
  FROM members m JOIN source_docs d USING (record_id) LEFT JOIN suites s USING (suite_id) WHERE m.copies > 1
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY first_id ORDER BY CASE t WHEN 'trusted' THEN 0 WHEN 'untrusted' THEN 1 WHEN 'blocked' THEN 2 ELSE 3 END, seen DESC NULLS LAST, record_id) AS nth
  FROM attributes
), listed AS (
  SELECT first_id, record_id, nth, 'trust' AS field_name, trust AS value FROM ordered WHERE t IN ('trusted', 'untrusted', 'blocked')
  UNION ALL SELECT first_id, record_id, nth, 'observed_at', CAST(seen AS VARCHAR) FROM ordered WHERE seen IS NOT NULL
  UNION ALL SELECT first_id, record_id, nth, 'expires_at', CAST(expires AS VARCHAR) FROM ordered WHERE expires IS NOT NULL
  UNION ALL SELECT first_id, record_id, nth, 'license', license FROM ordered WHERE license IS NOT NULL
), survivors AS (
  SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY first_id, field_name ORDER BY nth) = 1
)"""
)

_PAIRS = (
    _CANON.replace("WITH parts", "WITH RECURSIVE parts")
    + rf"""
, items AS (
  SELECT 'record' AS item_kind, CAST(record_id AS VARCHAR) AS item_key, content AS text, root FROM spelled JOIN source_docs USING (record_id) WHERE content IS NOT NULL
  UNION ALL SELECT DISTINCT 'chunk', chunk_id, text, regexp_replace(lower(text), '{_ALNUM}', '', 'g') FROM chunks WHERE text IS NOT NULL
), worded AS (
  SELECT item_kind, item_key, root, string_split(trim(regexp_replace(lower(text), '{_ALNUM}', ' ', 'g')), ' ') AS w FROM items
), runs AS (
  SELECT DISTINCT item_kind, item_key, root, array_to_string(w[i:i + 2], ' ') AS run FROM (SELECT *, unnest(generate_series(1, len(w) - 2)) AS i FROM worded)
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY item_kind, item_key) AS n FROM runs
), pairs AS (
  SELECT a.item_kind, a.item_key AS low_key, b.item_key AS high_key FROM sized a JOIN sized b ON a.item_kind = b.item_kind AND a.run = b.run AND a.item_key < b.item_key AND a.root <> b.root
  GROUP BY ALL HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.6::DOUBLE
)"""
)

_SPACE = r"[^\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _CANON + " SELECT first_id AS first_record_id, record_id AS copy_record_id FROM members WHERE record_id <> first_id",
        "p1_contents": _CANON + " SELECT first_id AS first_record_id, copies FROM members WHERE record_id = first_id",
        "p2_found": _PAIRS + " SELECT item_kind, low_key, high_key FROM pairs",
        "p2_groups": _PAIRS
        + """
, variants AS (
  SELECT item_kind, item_key, array_to_string(w, ' ') AS v FROM worded WHERE len(w) >= 3
), linked AS (
  SELECT DISTINCT p.item_kind, a.v AS a, b.v AS b FROM (SELECT item_kind, low_key AS x, high_key AS y FROM pairs UNION ALL SELECT item_kind, high_key, low_key FROM pairs) p
  JOIN variants a ON a.item_kind = p.item_kind AND a.item_key = x JOIN variants b ON b.item_kind = p.item_kind AND b.item_key = y
), named AS (
  SELECT item_kind, v, min(item_key) AS least FROM variants GROUP BY ALL
), reached AS (
  SELECT item_kind, a, a AS b FROM linked UNION SELECT r.item_kind, r.a, l.b FROM reached r JOIN linked l ON l.item_kind = r.item_kind AND l.a = r.b
), grouped AS (
  SELECT r.item_kind, r.a AS v, min(least) AS group_id FROM reached r JOIN named n ON n.item_kind = r.item_kind AND n.v = r.b GROUP BY ALL
), counted AS (
  SELECT item_kind, a AS v, count(*) AS links FROM linked GROUP BY ALL
)
SELECT item_kind, item_key, coalesce(group_id, least) AS group_id, coalesce(links, 0) AS links
FROM variants JOIN named USING (item_kind, v) LEFT JOIN grouped USING (item_kind, v) LEFT JOIN counted USING (item_kind, v)""",
        "p4_found": _LATEST + " SELECT question_id, chunk_id FROM placed WHERE place <= 5",
        "p4_ranked": _LATEST + " SELECT question_id, CAST(place AS INTEGER) AS place, chunk_id, score FROM placed WHERE place <= 5",
        "p5_found": _SURVIVORS + " SELECT first_id AS first_record_id, field_name, record_id AS from_record_id FROM survivors",
        "p5_records": _SURVIVORS + " SELECT first_id AS first_record_id, field_name, record_id AS from_record_id, value FROM survivors",
        "p6_found": f"""
WITH items AS (
  SELECT 'record' AS item_kind, CAST(record_id AS VARCHAR) AS item_key, content AS text, suite_id FROM source_docs
  UNION ALL SELECT DISTINCT 'chunk', chunk_id, text, suite_id FROM chunks
)
SELECT DISTINCT item_kind, item_key FROM items JOIN suites USING (suite_id) WHERE len(regexp_extract_all(text, '{_SPACE}')) > chunk_size""",
        "p7_found": "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z0-9]{2,}')) > 512",
        "p8_found": rf"""
WITH worded AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '{_ALNUM}', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM worded)
), sought AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '{_ALNUM}', ' ', 'g')), ' ') AS w FROM eval_items WHERE text IS NOT NULL
), pieces AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM sought)
)
SELECT DISTINCT doc_id, item_id FROM runs JOIN pieces USING (run)""",
    }
