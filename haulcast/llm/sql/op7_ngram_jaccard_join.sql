WITH RECURSIVE
words AS (
    SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
),
grams AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(w) = 0 THEN []
             WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END
    ) AS g
    FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY 1, 2
),
pairs AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE c * 1.0 / (x.n + y.n - c) >= 0.8
),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
    SELECT doc_id AS node, doc_id AS label FROM documents
    UNION
    SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.node
),
classes AS (SELECT node, min(label) AS class_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links
FROM documents JOIN classes ON node = doc_id LEFT JOIN degree ON a = doc_id
