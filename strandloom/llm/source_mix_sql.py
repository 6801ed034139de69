"""The source mix of op1 as DuckDB SQL: the same targets, quotients, draws and blocks."""

from __future__ import annotations

from strandloom.llm.source_mix import BLOCK, SEED, SHARD_WORDS


def _draw(parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, 15))::BIGINT"


def _apportioned(name: str, rows: str) -> str:
    """CTEs that give blocks to rows (g, i, v, seats): i orders ties inside the group g.

    Seats go to the highest quotients v / (2s - 1). No row is further from its
    quota than the rows of its group are many, so quotients are listed that far
    on both sides of it.
    """
    return f"""
{name}_q AS (SELECT *, count(*) OVER (PARTITION BY g) AS k, floor(v * seats / sum(v) OVER (PARTITION BY g)) AS quota FROM ({rows}) WHERE v > 0),
{name}_b AS (SELECT *, greatest(0, quota - k) AS sure FROM {name}_q),
{name}_c AS (SELECT g, i, seats - sum(sure) OVER (PARTITION BY g) AS left_over, v, sure, quota, k FROM {name}_b),
{name}_s AS (SELECT g, i, left_over, row_number() OVER (PARTITION BY g ORDER BY v / (2 * s - 1) DESC, i, s) AS place FROM (SELECT *, unnest(generate_series((sure + 1)::BIGINT, (quota + k + 1)::BIGINT)) AS s FROM {name}_c)),
{name} AS (SELECT b.g, b.i, (b.sure + count(s.place))::BIGINT AS blocks FROM {name}_b b LEFT JOIN {name}_s s ON s.g = b.g AND s.i = b.i AND s.place <= s.left_over GROUP BY b.g, b.i, b.sure)"""


def source_mix_sql() -> str:
    picked = "(floor((({k}) + phase) * chosen / greatest(n, 1)) - floor(phase * chosen / greatest(n, 1)))"

    def before(x: str) -> str:
        k = f"(({x}) // {BLOCK})"
        return f"({picked.format(k=k)} * {BLOCK} + (({x}) - {k} * {BLOCK}) * ({picked.format(k=k + ' + 1')} - {picked.format(k=k)}))"

    middle = f"((start + size // 2) // {BLOCK})"
    return rf"""
WITH sized AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, h) AS copy FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, {_draw("coalesce(text, '')")} AS h FROM documents)),
per AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap FROM sized GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM per),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, i, source_size, least(cap, coalesce(max(CASE WHEN level <= cap / weight * (1 + 1e-12) THEN level END) OVER (), 'inf'::DOUBLE) * weight) AS target FROM lv),
{_apportioned("won", f"SELECT 0 AS g, i, target / {BLOCK} AS v, round(sum(target / {BLOCK}) OVER ()) AS seats FROM t WHERE target > 0")},
quota AS (SELECT t.*, coalesce(blocks, 0) AS blocks, greatest(1, ceil(source_size / {SHARD_WORDS}))::BIGINT AS n_shards FROM t LEFT JOIN won ON won.i = t.i),
rows_ AS (SELECT d.doc_id, d.source, q.i AS g, size, h, copy, source_size, target, blocks, {_draw(f"doc_id, h, copy, {SEED}")} % n_shards AS shard FROM sized d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source),
lengths AS (SELECT g, shard, sum(size)::BIGINT AS length, max(blocks) AS seats FROM rows_ GROUP BY g, shard),
{_apportioned("part", "SELECT g, shard AS i, length::DOUBLE AS v, seats FROM lengths")},
shards AS (SELECT l.g, l.shard, l.length, least(coalesce(p.blocks, 0) * {BLOCK}, 3 * l.length) AS words FROM lengths l LEFT JOIN part p ON p.g = l.g AND p.i = l.shard),
placed AS (SELECT r.*, length, words, coalesce(sum(size) OVER (PARTITION BY r.g, r.shard ORDER BY {_draw(f"doc_id, copy, {SEED + 1}")}, doc_id NULLS FIRST, h, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  CASE WHEN length > 0 THEN words // length ELSE 0 END AS passes FROM rows_ r JOIN shards s ON s.g = r.g AND s.shard = r.shard),
cut AS (SELECT *, ceil(length / {BLOCK})::BIGINT AS n, least(ceil(length / {BLOCK}), round((words - passes * length) / {BLOCK}))::BIGINT AS chosen, {_draw(f"source, shard, {SEED + 2}")} % greatest(ceil(length / {BLOCK}), 1)::BIGINT AS phase FROM placed)
SELECT doc_id, size, source_size, target,
  least(passes * size + greatest(0, least(size, ({before("start + size")} - {before("start")})::BIGINT)), 3 * size)::BIGINT AS taken,
  CASE WHEN size > 0 THEN least(passes + ({picked.format(k=middle + " + 1")} - {picked.format(k=middle)})::BIGINT, 3) ELSE 0 END::INTEGER AS copies, source, shard
FROM cut"""
