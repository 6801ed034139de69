import math
import re
from hashlib import sha256
from zlib import crc32


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", low)


def buckets(text):
    w = words(text)
    return [crc32(f.encode()) % 10000 for f in [*w, *(" ".join(p) for p in zip(w, w[1:]))]]


def brute(docs, target):
    s, t = [0] * 10000, [0] * 10000
    for _, x in docs:
        for b in buckets(x):
            s[b] += 1
    for x in target:
        for b in buckets(x):
            t[b] += 1
    gain = [math.floor(1000 * math.log((q + 1.0) * (sum(s) + 10000.0) / ((p + 1.0) * (sum(t) + 10000.0)))) for p, q in zip(s, t)]
    rows = []
    for i, x in docs:
        f = buckets(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    n = 25 * len(able) // 100
    return sorted(rows, key=str), [(r[3], r[0]) for r in able[:n]]


def check(got, docs, target):
    rows, drawn = brute(docs, target)
    assert sorted([(r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got], key=str) == sorted([r[:4] for r in rows], key=str)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["score"], r["doc_id"]) for r in ranked] == drawn


def test_brute_force(spark):
    from strandloom.llm.resampling import resample

    docs = [(i, " ".join(f"W{(i * k * k) % 37} ÄÖ{k % 5} x_{i % 7}" for k in range(i % 30))) for i in range(400)]
    docs += [(1000 + i, "the same copy again and again " * 5) for i in range(300)]  # a hot text
    docs += [(None, "no id here but many words " * 6)] * 50 + [(3, None), (4, ""), (5, "?!"), (5, "?!"), (6, "one"), (7, "long " * 40_000)]
    target = ["the same copy W3 W4", "W5 ÄÖ1 x", None, ""]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, digest int").repartition(7)
    got = resample(table, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    check(got, docs, target)


def test_empty_tables(spark):
    from strandloom.llm.resampling import resample

    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).count() == 0
    docs = [(i, "some words of a text number " * 4 + str(i)) for i in range(9)]
    check(resample(spark.createDataFrame(docs, "doc_id long, text string"), none).collect(), docs, [])


def test_numbered_has_every_place_once(spark):
    from pyspark.sql import functions as F

    from strandloom.llm.common import numbered

    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit(None).cast("int").alias("z"))
    got = numbered(rows, [F.col("v").desc(), F.col("z")], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 5001))
    assert [r["v"] for r in got] == sorted((r["v"] for r in got), reverse=True)
