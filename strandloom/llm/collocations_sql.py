"""The DuckDB form of op12: every phrase written out and counted."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def collocations_sql(min_count: int = 100, longest: int = 5, top: int = 2000) -> str:
    return f"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    ws AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM ws GROUP BY lang),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
    runs AS (SELECT lang, unnest(list_transform(range(1, {longest} + 1), lambda m: CASE WHEN i + m - 1 <= len(w) THEN array_to_string(w[i : i + m - 1], ' ') END)) AS phrase FROM places),
    f AS MATERIALIZED (SELECT lang, phrase, count(*)::HUGEINT AS a, string_split(phrase, ' ') AS w FROM runs WHERE phrase IS NOT NULL GROUP BY lang, phrase HAVING count(*) >= {min_count}),
    cuts AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
    scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n, 1000 * c.a * n // (x.a * y.a) AS score FROM cuts c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ') JOIN totals ON totals.lang = c.lang),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_ AS (SELECT lang, array_to_string(w[i + 1 : i + m], ' ') AS phrase, max(a) AS a FROM f, range(2, {longest}) t(m), range(0, {longest}) u(i) WHERE m < len(w) AND i + m <= len(w) GROUP BY ALL),
    kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.a IS NULL OR 100 * i.a < 100 * b.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM kept)
    SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {top}
    """
