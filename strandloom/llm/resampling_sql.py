"""The DuckDB form of op11: every feature counted by name, crc32 by its bytes."""

from __future__ import annotations

POLYNOMIAL = 0xEDB88320
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def resampling_sql(buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> str:
    """Documents and benchmark side by side; a feature's bucket is computed once."""

    def words(name: str, key: str) -> str:
        return f"SELECT {key} AS k, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {name}"

    def features(name: str) -> str:
        return f"SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {name}"

    return f"""
    WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS row, * FROM documents),
    bits(b, step, c) AS (SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END FROM bits WHERE step < 8),
    crc AS (SELECT list(c ORDER BY b) AS entry FROM bits WHERE step = 8),
    dw AS ({words('numbered', 'row')}), bw AS ({words('benchmark', '1')}),
    df AS MATERIALIZED ({features('dw')}), bf AS MATERIALIZED ({features('bw')}),
    names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
    bytes AS (SELECT f, list_transform(range(len(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bs FROM names),
    bucketed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c >> 8, entry[xor(c & 255, b) + 1])), 4294967295) % {buckets} AS bucket FROM bytes, crc),
    s AS (SELECT bucket, count(*) AS s FROM df JOIN bucketed USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bf JOIN bucketed USING (f) GROUP BY bucket),
    totals AS (SELECT (SELECT count(*) FROM df) + {buckets} AS alls, (SELECT count(*) FROM bf) + {buckets} AS allt),
    gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * alls::DOUBLE / ((s + 1)::DOUBLE * allt::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), totals),
    weights AS (SELECT k, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN bucketed USING (f) JOIN gains USING (bucket) GROUP BY k),
    scored AS (SELECT doc_id, row, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
        FROM numbered JOIN dw ON row = dw.k LEFT JOIN weights ON row = weights.k),
    able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS place, count(*) OVER () AS n_able FROM scored WHERE n_words >= {min_words})
    SELECT scored.doc_id, scored.n_features, scored.weight, scored.score, CASE WHEN place <= {percent} * n_able // 100 THEN place END::BIGINT AS rank
    FROM scored LEFT JOIN able ON scored.row = able.row
    """
