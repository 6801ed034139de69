import random
from collections import defaultdict

import pytest

from strandloom.llm.source_mix import mix_sources, mixing_stage, sainte_lague, source_targets

DOCS = "doc_id long, text string, source string, size long, target string"


def apportion(values, seats):
    won = [0] * len(values)
    for _ in range(int(seats)):
        won[max(range(len(values)), key=lambda i: (values[i] / (2 * won[i] + 1), -i))] += 1
    return won


def water_level(sizes, weights):
    """Targets by repeated capping at three times the size."""
    target, open_, left = {}, dict(zip(sizes, weights)), float(sum(sizes.values()))
    while open_:
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if level * w > 3 * sizes[s]]
        if not over:
            return target | {s: level * w for s, w in open_.items()}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_apportionment_equals_one_by_one(spark):
    draw = random.Random(3)
    rows = [([float(draw.choice([1, 1, 2, 3, 7.5, 100, draw.random() * 50])) for _ in range(draw.randint(1, 9))], float(draw.randint(0, 60))) for _ in range(40)]
    rows += [([], 0.0), ([0.0, 0.0], 4.0)]
    flat = spark.createDataFrame([(g, i, v, n) for g, (vs, n) in enumerate(rows) for i, v in enumerate(vs)], "g int, i int, v double, seats double")
    for per_range in (1, 3, 4096):
        got = {(r["g"], r["i"]): r["blocks"] for r in sainte_lague(flat, per_range).collect()}
        for g, (vs, n) in enumerate(rows):
            assert [got.get((g, i), 0) for i in range(len(vs))] == (apportion(vs, n) if any(vs) else [0] * len(vs))


def test_apportionment_of_many_shards_is_linear(spark):
    """100,000 shards of one source, half of them of one length: every seat is given, each within one of its quota."""
    n = 100_000
    rows = spark.range(n).selectExpr("1 AS g", "id AS i", "CAST(CASE WHEN id % 2 = 0 THEN 262144 ELSE 200000 + id * 7919 % 100000 END AS double) AS v", "1234567D AS seats")
    got = sainte_lague(rows).join(rows, ["g", "i"])
    total = rows.selectExpr("sum(v) AS t").first()["t"]
    r = got.selectExpr("sum(blocks) AS b", f"max(abs(blocks - v * 1234567D / {total!r})) AS off", "count(*) AS n").first()
    assert r["b"] == 1234567 and r["n"] == n and r["off"] <= 1


def test_targets_equal_repeated_capping(spark):
    draw = random.Random(5)
    sizes = {f"s{i:02d}": draw.choice([0, 1, 5, 40, 1000, 30000]) for i in range(17)}
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = water_level(sizes, [1 + i % 3 for i in range(17)])
    for s in sizes:
        assert got[s] == pytest.approx(want.get(s, 0.0), rel=1e-9, abs=1e-9)


def corpus(spark, n=400):
    draw = random.Random(9)
    rows = [(i, " ".join("w" * draw.randint(1, 5) for _ in range(draw.randint(0, 90))), draw.choice(["a", "a", "a", "b", "c", None]), 7, "x") for i in range(n)]
    rows += [(None, None, "b", 1, "x"), (3, "again and again", "b", 1, "x"), (3, "again and again", "b", 1, "x"), (9000, "word " * 5000, "c", 1, "x")]
    return spark.createDataFrame(rows, DOCS)


def test_mix_meets_targets(spark):
    docs = corpus(spark)
    rows = mix_sources(docs, shard_words=700).collect()
    assert len(rows) == docs.count()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 400 + 0.02 * target[s], s
    assert any(r["size"] == 0 and r["taken"] == 0 for r in rows)
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_mix_is_the_same_again(spark):
    docs = corpus(spark)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    a = sorted(map(key, mix_sources(docs).collect()), key=str)
    assert a == sorted(map(key, mix_sources(docs.repartition(7)).collect()), key=str)


def test_a_source_that_stops_at_its_cap(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 0, ""), (2, "w " * 100, "w", 0, "")], DOCS)
    got = {r["source"]: r["target"] for r in mix_sources(docs).collect()}
    assert got == {"w": pytest.approx(96.0), "x": pytest.approx(6.0)}


def test_empty_and_stage(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    docs = corpus(spark)
    mixed = mixing_stage(spark, docs, "")
    assert mixed.columns == docs.columns
    words = {r["source"]: 0 for r in docs.collect()}
    for r in mixed.collect():
        words[r["source"]] += len((r["text"] or "").split())
    target = {r["source"]: r["target"] for r in mix_sources(docs).collect()}
    for s in words:
        assert abs(words[s] - target[s]) < 0.25 * target[s] + 5000


def test_equal_rows_and_null_ids_fill_no_shard(spark, monkeypatch):
    """Two thirds of the rows equal or without an id and words: no shard above four times its plan."""
    from pyspark.sql import functions as F

    from strandloom.llm import source_mix as M

    monkeypatch.setattr(M, "EQUAL_ROWS", 500)
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 3 == 2, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text of seven words that repeats").when(F.col("id") % 3 == 2, F.concat(F.lit("text number "), F.col("id"))).alias("text"), F.lit("s").alias("source"))
    got = M.mix_sources(rows, shard_words=1000)
    load = got.groupBy("source", "shard").agg(F.sum("size").alias("w")).collect()
    assert got.count() == 9000 and max(r["w"] for r in load) < 4000 and len(load) > 10
    assert got.where("doc_id = 5").select("shard").distinct().count() > 10
