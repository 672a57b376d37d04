"""DuckDB SQL for the queries that SQL can express."""

CHAT_FORMAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|><|text|><|end|>')
    + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
h AS (SELECT hex, max(page_id) AS holder FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT)) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM p JOIN h USING (hex)
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
sizes AS (SELECT DISTINCT least(len(words), 5) AS k FROM i WHERE len(words) > 0),
si AS (
  SELECT DISTINCT item_id, k, array_to_string(words[j:j + k - 1], ' ') AS shingle
  FROM (SELECT item_id, words, least(len(words), 5) AS k, unnest(generate_series(1, len(words) - least(len(words), 5) + 1)) AS j FROM i WHERE len(words) > 0)),
sd AS (
  SELECT DISTINCT doc_id, k, array_to_string(words[j:j + k - 1], ' ') AS shingle
  FROM (SELECT doc_id, words, k, unnest(generate_series(1, len(words) - k + 1)) AS j FROM d CROSS JOIN sizes WHERE len(words) >= k)),
n AS (SELECT item_id, count(*) AS n FROM si GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS c FROM si JOIN sd USING (k, shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS item_shingles, c AS shared, CAST(c AS DOUBLE) / n AS containment
FROM c JOIN n USING (item_id) WHERE c >= 0.8 * n
"""

CHECKS = {
    "op3_chat_format": CHAT_FORMAT,
    "op5_near_dedup": NEAR_DEDUP,
    "op7_warc": WARC,
    "op10_decontamination": DECONTAMINATION,
}
