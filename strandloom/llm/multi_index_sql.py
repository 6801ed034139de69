"""The links of op9 as DuckDB SQL, by comparing all pairs: for small tables."""

from __future__ import annotations

from strandloom.llm.multi_index import THRESHOLD


def near_vectors_sql() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
finite AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
ok AS (SELECT r, vec_id, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS e, count(*) OVER (PARTITION BY list_transform(e, lambda x: x + 0.0)) AS n_copies
  FROM finite),
pairs AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
degree AS (SELECT a AS r, count(*)::BIGINT AS n_links FROM pairs GROUP BY a),
reach AS (SELECT r, r AS t FROM ok UNION SELECT reach.r, pairs.b FROM reach JOIN pairs ON reach.t = pairs.a),
low AS (SELECT reach.r, min(ok.vec_id) AS component_id FROM reach JOIN ok ON reach.t = ok.r GROUP BY reach.r)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, v.vec_id) AS component_id, coalesce(v.vec_id = coalesce(component_id, v.vec_id), TRUE) AS kept, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM v LEFT JOIN degree USING (r) LEFT JOIN low USING (r) LEFT JOIN (SELECT r, n_copies FROM ok) USING (r)"""
