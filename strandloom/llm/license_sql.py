"""The licence scan of op10 as DuckDB SQL, from the same templates and phrases: every placement that one of a template's words proposes is weighed, without the index."""

from __future__ import annotations

from strandloom.llm.license_scan import BASE, SHARE, TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(phrase: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in phrase.split()) + "]"


def licence_sql() -> str:
    base = ", ".join(f"({_words(p)}, '{label}')" for p, label in BASE)
    templates = ", ".join(f"({n}, '{label}', {_words(words)}, {_words(key)})" for n, (label, words, key) in enumerate(TEMPLATES))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
tokens AS (SELECT r, words, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM docs),
base(phrase, label) AS (VALUES {base}),
places AS (SELECT r, pos, label FROM tokens JOIN base ON word = phrase[1] WHERE words[pos + 1 : pos + len(phrase)] = phrase),
per_base AS (SELECT r, count(*)::BIGINT AS n_base, min(pos)::BIGINT AS first_word, max(pos)::BIGINT AS last_word FROM places GROUP BY r),
templates(n, label, words, key) AS (VALUES {templates}),
parts AS (SELECT n, label, words, key, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS j FROM templates),
df AS (SELECT word, count(DISTINCT r) AS held FROM tokens WHERE word IN (SELECT word FROM parts) GROUP BY word),
weighted AS (SELECT p.*, ln((1 + (SELECT count(*) FROM docs)) / (1 + coalesce(held, 0))) + 0.01 AS weight FROM parts p LEFT JOIN df USING (word)),
totals AS (SELECT n, sum(weight) AS total FROM weighted GROUP BY n),
asked AS (SELECT d.r, t.n FROM docs d, templates t WHERE list_has_all(d.words, t.key)),
got AS (SELECT a.r, a.n, t.pos - w.j AS start, sum(weight) AS got FROM asked a JOIN weighted w ON w.n = a.n JOIN tokens t ON t.r = a.r AND t.word = w.word GROUP BY ALL),
likely AS (SELECT g.*, got / total AS part, t.label, t.key, len(t.words) AS width, d.words FROM got g JOIN totals USING (n) JOIN templates t USING (n) JOIN docs d USING (r) WHERE got >= {SHARE} * total),
found AS (SELECT r, label, part FROM likely WHERE len(list_filter(generate_series(greatest(start, 0), start + width - len(key)), lambda i: words[i + 1 : i + len(key)] = key)) > 0),
best AS (SELECT r, max(part) AS part FROM found GROUP BY r),
named AS (SELECT r, label, TRUE AS is_base FROM places UNION SELECT r, label, FALSE FROM found),
lists AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM named GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0) END, 6) AS score
FROM docs LEFT JOIN per_base USING (r) LEFT JOIN lists USING (r) LEFT JOIN best USING (r)"""

