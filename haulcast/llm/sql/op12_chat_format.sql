WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))
), ordered AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS earlier
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), written AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*/?(?:s>|ROLE\]|NEXT\]|INST\]))', '\1\\\2', 'g') AS said_by,
    regexp_replace(text, '([<\[])(\\*/?(?:s>|ROLE\]|NEXT\]|INST\]))', '\1\\\2', 'g') AS said
  FROM ordered
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = earlier THEN 6 ELSE 14 + length(said_by) END + length(said))::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
