WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings
), fine AS (
  SELECT place, vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM given
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.place AS a, b.place AS b FROM fine a JOIN fine b ON a.place <> b.place AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reached AS (
  SELECT place AS a, place AS b FROM given
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), named AS (
  SELECT r.a AS place, min(g.vec_id) AS component_id FROM reached r JOIN given g ON g.place = r.b GROUP BY 1
), counted AS (
  SELECT a AS place, count(*) AS n FROM links GROUP BY 1
)
SELECT g.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, g.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM given g JOIN named USING (place) LEFT JOIN counted USING (place)
