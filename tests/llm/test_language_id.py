import random

import numpy as np

from strandloom.llm.language_id import DIMS, UNDETERMINED, ftrl, identify, language_stage, train_language

SYLLABLES = {"aa": "ka ki ko ru mi na to".split(), "bb": "sch ung ein ver lich kei".split(), "cc": "eau oux tion elle ment que".split()}


def corpus(spark, n=450):
    draw = random.Random(2)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        text = " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(5, 60)))
        rows.append((i, text, lang if i % 7 else None, "s", "x"))
    rows += [(9001, None, "aa", "s", "x"), (9002, "", "bb", "s", "x"), (9003, "123 ... 456", "cc", "s", "x"), (9004, "kaki " * 40_000, None, "s", "x"), (None, "schung verlich einkei", "bb", "s", "x"), (0, rows[0][1], "aa", "s", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_pred string")


def test_held_out_accuracy_and_odd_rows(spark):
    docs = corpus(spark)
    rows = identify(docs, train_language(docs, rows_per_lang=60)).collect()
    assert len(rows) == docs.count()
    tested = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 450 and r["held_out"]]
    assert len(tested) > 50 and sum(r["lang_pred"] == list(SYLLABLES)[r["doc_id"] % 3] for r in tested) / len(tested) > 0.98
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["lang_pred"] == UNDETERMINED and by[k]["score"] == 0 for k in (9001, 9002, 9003))
    assert by[9004]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb" and all(0 <= r["score"] <= 1 for r in rows)


def test_stage_keeps_clean_rows_and_columns(spark):
    docs = corpus(spark)
    kept = language_stage(spark, docs, "")
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert not left & {9001, 9002, 9003} and len(left) > 440


def test_every_language_is_learned(spark):
    draw = random.Random(5)
    rows = []
    for lang in range(70):
        syllables = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(3)]
        rows += [(100 * lang + i, " ".join(draw.choice(syllables) for _ in range(20)), f"l{lang:02}", "s", "x") for i in range(8 if lang > 60 else 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_pred string")
    model = train_language(docs, rows_per_lang=20)
    assert set(model.langs) == {r[2] for r in rows}
    assert sum(model.predict(r[1])[0] == r[2] for r in rows) / len(rows) > 0.95


def test_held_out_texts_change_no_model(spark):
    from pyspark.sql import functions as F

    from strandloom.llm.common import held_out

    docs = corpus(spark, 200)
    apart = held_out() | F.col("lang").isNull()
    changed = docs.withColumn("text", F.when(apart, F.lit("zzz yyy xxx")).otherwise(F.col("text"))).withColumn("lang", F.when(held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = train_language(docs), train_language(changed)
    assert a.langs == b.langs and a.temperature == b.temperature
    assert np.array_equal(a.idf, b.idf) and np.array_equal(a.weights, b.weights)


def test_nothing_to_learn(spark):
    docs = corpus(spark, 20)
    model = train_language(docs.withColumn("lang", docs["lang"].substr(1, 0)).where("false"))
    assert {r["lang_pred"] for r in identify(docs, model).collect()} == {UNDETERMINED}
    assert identify(docs.where("false"), model).count() == 0


def test_elastic_net_makes_weights_sparse():
    draw = np.random.default_rng(0)
    rows = []
    for i in range(200):
        y = i % 2
        at = np.array([y, *draw.choice(np.arange(10, 200), 5, replace=False)])
        rows.append((at, np.ones(6) / 6**0.5, y))
    w = ftrl(rows, 2, epochs=3, alpha=0.5, beta=1.0, l1=1.0, l2=0.1, seed=1)
    assert w.shape == (DIMS, 2) and w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0]
    assert (w != 0).sum() < 60
