import random

import numpy as np

from strandloom.llm.quality import fit_logistic, score_quality, train_quality


def corpus(spark, n=500):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = ["".join(draw.choice("aeioubdgklmnrst") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(10, 80))]
        text = " ".join(w + draw.choice(["###", "$$$", "%%%"]) for w in words) if bad else ". ".join(" ".join(words[j : j + 7]) for j in range(0, len(words), 7)) + "."
        rows.append((i, text, draw.choice(["s1", "s2", None]), draw.choice(["en", "de", None]), 5, "x"))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 0 if bad else 1))
    rows += [(7000, None, None, None, 0, "x"), (7001, "", "s1", "en", 0, "x"), (None, "plain words of a text", "s1", "en", 0, "x"), (7002, "fine words here. " * 8000, "s1", "en", 0, "x"), (1, rows[1][1], "s1", "en", 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(spark)
    rows = score_quality(docs, train_quality(docs, labels)).collect()
    assert len(rows) == docs.count()
    tested = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 500 and r["held_out"]]
    assert len(tested) > 60 and sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in tested) / len(tested) > 0.95
    assert all(0 <= r[c] <= 1 for r in rows for c in ("score", "text_score", "meta_score"))
    assert {r["predicted"] for r in rows if r["doc_id"] == 7002} == {1}


def test_held_out_rows_change_no_weight(spark):
    """Other texts, sources and labels in the held-out fold leave the model alone, as do rows without an id."""
    from pyspark.sql import functions as F

    from strandloom.llm.common import held_out

    docs, labels = corpus(spark, 200)
    apart = held_out() | F.col("doc_id").isNull()
    changed = docs.withColumn("text", F.when(apart, F.lit("$$$ quite other words $$$")).otherwise(F.col("text"))).withColumn("source", F.when(apart, F.lit("elsewhere")).otherwise(F.col("source")))
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = train_quality(docs, labels), train_quality(changed, flipped)
    for part in ("text", "meta", "curves", "mix"):
        assert np.array_equal(getattr(a, part), getattr(b, part))


def test_fit_reaches_the_optimum():
    """The slope vanishes at the weights, as a plain computation of it shows."""
    draw = np.random.default_rng(3)
    x = draw.standard_normal((300, 7))
    y = (x[:, 0] + draw.standard_normal(300) > 0.4).astype(float)
    w = fit_logistic(x, y)
    slope = np.zeros(8)
    for row, label in zip(x, y, strict=True):
        p = 1 / (1 + np.exp(-(row @ w[:7] + w[7])))
        slope += np.append(row, 1.0) * (p - label) * 0.5 / (y == label).sum()
    slope[:7] += 1e-3 * w[:7]
    assert np.abs(slope).max() < 1e-5


def test_nothing_to_learn(spark):
    docs, labels = corpus(spark, 40)
    model = train_quality(docs, labels.where("false"))
    assert len({r["score"] for r in score_quality(docs, model).collect()}) == 1
    assert score_quality(docs.where("false"), model).count() == 0
    only_good = train_quality(docs, labels.where("quality = 1"))
    assert {r["predicted"] for r in score_quality(docs, only_good).collect()} == {1}
