WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS "row", doc_id, source,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
      || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS own,
    CASE WHEN text IS NULL THEN '-'
      ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS altered,
    -- the reflected checksum, bit by bit over the digits of the id
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda total, byte: list_reduce(list_prepend(xor(total, byte), list_transform(range(8), lambda i: i::BIGINT)),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT "row", doc_id, source, sha256(head || own) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(head || altered) ELSE sha256(head || own) END AS presented
  FROM fields
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
    count(*) OVER (PARTITION BY source) AS size
  FROM leaves
), nodes(level, tree, pos, digest, n) AS (
  SELECT 0, tree, rank, leaf, size FROM placed
  UNION ALL
  SELECT level + 1, tree, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16
  FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 16, n
), tops(level, pos, digest, n) AS (
  SELECT 0, tree, digest, count(*) OVER () FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16
  FROM tops WHERE n > 1 GROUP BY level, pos // 16, n
), steps AS (
  SELECT p."row", t.level AS step, string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < p.rank >> (4 * t.level)) AS before,
    string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > p.rank >> (4 * t.level)) AS after
  FROM placed p JOIN nodes t ON t.n > 1 AND t.tree = p.tree AND t.pos // 16 = p.rank >> (4 * t.level + 4)
  GROUP BY p."row", t.level
  UNION ALL
  SELECT p."row", 100 + t.level, string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < p.tree >> (4 * t.level)),
    string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > p.tree >> (4 * t.level))
  FROM placed p JOIN tops t ON t.n > 1 AND t.pos // 16 = p.tree >> (4 * t.level + 4)
  GROUP BY p."row", t.level
), path AS (
  SELECT "row", coalesce(before, '') AS before, coalesce(after, '') AS after,
    row_number() OVER (PARTITION BY "row" ORDER BY step) AS step, count(*) OVER (PARTITION BY "row") AS steps
  FROM steps
), folded("row", step, digest) AS (
  SELECT "row", 0, presented FROM placed
  UNION ALL
  SELECT f."row", f.step + 1, sha256(p.before || f.digest || p.after)
  FROM folded f JOIN path p ON p."row" = f."row" AND p.step = f.step + 1
), proofs AS (
  SELECT "row", sha256(string_agg(before || after, '' ORDER BY step)) AS proof, max(steps) AS steps FROM path GROUP BY "row"
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
  f.digest AS folded_root, f.digest = r.digest AS verified
FROM placed p
JOIN nodes s ON s.n = 1 AND s.tree = p.tree
JOIN tops r ON r.n = 1
LEFT JOIN proofs q ON q."row" = p."row"
JOIN folded f ON f."row" = p."row" AND f.step = coalesce(q.steps, 0)
