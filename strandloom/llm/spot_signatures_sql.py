"""The spot signatures of op4 as DuckDB SQL: the same anchors, chains, draws and likeness."""

from __future__ import annotations

import math

from strandloom.llm.spot_signatures import ANCHORS, GAP, THRESHOLD


def spot_signatures_sql() -> str:
    anchors = ", ".join(f"'{a}'" for a in dict.fromkeys(ANCHORS))
    print_of = "printf('%08x', len({0})) || '-' || md5(array_to_string({0}, ','))"
    like = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0::DOUBLE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
    return rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, ('0x' || substr(md5(text), 1, 15))::BIGINT) AS r, * FROM (SELECT doc_id, coalesce(text, '') AS text, count(*) AS held FROM documents GROUP BY ALL)),
p AS (SELECT a.r, a.doc_id, a.text, a.held, b.r AS next_r, b.text AS next_text FROM d a JOIN d b ON b.r = a.r % (SELECT count(*) FROM d) + 1),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM p),
texts AS (SELECT r, 'own' AS kind, text AS t FROM e UNION ALL SELECT r, 'edited', edited FROM e),
words AS (SELECT r, kind, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, kind, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS ws FROM texts)),
flagged AS (SELECT *, w IN ({anchors}) AS stop FROM words),
grouped AS (SELECT *, coalesce(sum(CASE WHEN stop THEN 0 ELSE 1 END) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM flagged),
items AS (SELECT r, kind, g, bool_or(stop) AS anchored, max(CASE WHEN NOT stop THEN w END) AS content, string_agg(w, ':' ORDER BY i) AS a FROM grouped GROUP BY r, kind, g),
chains AS (SELECT r, kind, CASE WHEN content IS NULL THEN a || ':' ELSE a END AS a, lead(coalesce(content, '')) OVER (PARTITION BY r, kind ORDER BY g) AS following,
  anchored OR NOT bool_or(anchored) OVER (PARTITION BY r, kind ORDER BY g ROWS BETWEEN {GAP - 1} PRECEDING AND CURRENT ROW) AS starts FROM items),
signatures AS (SELECT DISTINCT r, kind, ('0x' || substr(md5(concat_ws('|', a, following)), 1, 15))::BIGINT AS s FROM chains WHERE starts),
sets AS (SELECT r, kind, list(s ORDER BY s) AS l FROM signatures GROUP BY r, kind),
all_ AS (SELECT e.*, coalesce(o.l, []) AS own, coalesce(x.l, []) AS other, coalesce(nx.l, []) AS nxt FROM e LEFT JOIN sets o ON o.r = e.r AND o.kind = 'own' LEFT JOIN sets x ON x.r = e.r AND x.kind = 'edited' LEFT JOIN sets nx ON nx.r = e.next_r AND nx.kind = 'own')
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {print_of.format("own")} AS fingerprint, {print_of.format("other")} AS edited_fingerprint,
  {like.format("own", "other")} AS near_edited, {like.format("own", "nxt")} AS near_next, len(own)::INTEGER AS n_signatures, floor(ln(greatest(len(own), 1)) / {-math.log(THRESHOLD)!r})::INTEGER AS length_part
FROM (SELECT *, unnest(generate_series(1, held)) FROM all_)"""
