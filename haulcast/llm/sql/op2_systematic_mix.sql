WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5(doc_id::VARCHAR) AS key
    FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
placed AS (
    SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight,
           row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM s
),
summed AS (
    SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS unfilled,
           coalesce(sum(source_size) OVER w, 0) AS filled
    FROM placed
    WINDOW w AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (
    SELECT max((total - 3 * filled)::DOUBLE / unfilled) AS level FROM summed
),
wanted AS (
    SELECT source, source_size, least(coalesce(level * weight, 3.0 * source_size), 3.0 * source_size)::DOUBLE AS target,
           ('0x' || substr(md5('mix' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
    FROM summed, level
),
numbered AS (
    SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, key NULLS FIRST, doc_id) AS k FROM d
),
steps AS (
    SELECT n.*, w.source_size, w.target, w.shift, CASE WHEN w.source_size = 0 THEN 0.0 ELSE w.target / w.source_size END AS step
    FROM numbered n JOIN wanted w ON n.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, ((floor(shift + k * step) - floor(shift + (k - 1) * step)) * size)::BIGINT AS taken
FROM steps
