import random
import re
from collections import Counter

import pytest


def brute(docs, min_count, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(5, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = []
    held = {k: a for k, a in f.items() if a >= min_count and len(k[1]) > 1}
    for (lang, p), a in held.items():
        inside = any(q[i : i + len(p)] == p for (other, q), b in held.items() if other == lang and len(q) > len(p) and b >= a for i in range(len(q) - len(p) + 1))
        if inside:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(ranked)


def texts():
    draw = random.Random(3)
    vocabulary = ["the", "of", "Ünder", " odd", "a", "x\x1fy", "New", "york", "rare%d"]
    docs = []
    for i in range(300):
        w = [vocabulary[v] if v < 8 else f"rare{draw.randint(0, 500)}" for v in draw.choices(range(9), weights=[9, 7, 5, 3, 6, 2, 4, 4, 3], k=draw.randint(0, 60))]
        docs.append((draw.choice(["en", "de", None, "und"]), draw.choice([" ", "\t ", " "]).join(w).replace("york a", "york, a").replace("of the", "OF. The")))
    docs += [("en", "One passage that many documents share word for word! ") for _ in range(120)]
    docs += [("en", None), (None, ""), ("de", " .,;"), ("de", "tick tock " * 20_000), ("fr", "a a a a a a a a " * 30)]
    return docs


@pytest.mark.parametrize(("table_words", "top", "held"), [(1 << 18, 2000, 1 << 20), (5, 2000, 100), (0, 7, 5000)])
def test_brute_force(spark, monkeypatch, table_words, top, held):
    """The whole dictionary broadcast, a part of it, and none of it; blocks of every size."""
    from strandloom.llm import collocations as C

    monkeypatch.setattr(C, "IDS_HELD", held)
    docs = texts()
    table = spark.createDataFrame([(*d, i, "k") for i, d in enumerate(docs)], "lang string, text string, row int, key string").repartition(5)
    got = C.collocations(table, min_count=20, top=top, table_words=table_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, 20, top)


def test_runs_over_task_borders(spark):
    """A phrase whose keys are dealt over many tasks is counted whole."""
    from strandloom.llm import collocations as C

    docs = [("en", f"alpha beta w{i % 40}") for i in range(4000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C.collocations(spark.createDataFrame(docs, "lang string, text string"), min_count=50).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(tuple(r) for r in got) == brute(docs, 50, 2000)


def test_empty_table_and_large_products(spark):
    from strandloom.llm.collocations import collocations

    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        collocations(spark.createDataFrame([], "lang string, text string"), longest=1)
