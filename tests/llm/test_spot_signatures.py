import hashlib

import pytest
from pyspark.sql import functions as F

from strandloom.llm import spot_signatures as M

TEXTS = {
    4: "The cat sat on the mat and the dog ran to a house in the town. " * 3, 1: "Nothing common here whatsoever", 9: "", 7: None, 2: "Le chat de la maison est sur une table, pour les enfants. " * 4,
    12: "x", 13: "The cat sat on the mat and the dog ran to a house in the town. " * 3, 20: "the of and", 25: "ünïcode 日本 🎉 the word of truth " * 50, 31: "the end: of a:b",
}


def spots(text):
    """The signatures in words: (anchors, content word, next content word)."""
    import regex

    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    items, run = [], []
    for w in words:
        if w in M.ANCHORS:
            run.append(w)
        else:
            items.append((tuple(run), w))
            run = []
    if run:
        items.append((tuple(run), ""))
    out = set()
    for i, (a, w) in enumerate(items):
        if a or not any(x[0] for x in items[max(0, i - M.GAP + 1) : i]):
            out.add((a, w, items[i + 1][1] if i + 1 < len(items) else None))
    return out


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("rows", [4096, 3])
def test_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(M.with_next, "__defaults__", (rows,))
    docs = spark.createDataFrame([(k, t, "s", "f") for k, t in TEXTS.items()], "doc_id long, text string, slice string, fingerprint string")
    got = {r["doc_id"]: r for r in M.fingerprints(docs).collect()}
    ids = sorted(TEXTS)
    assert sorted(got) == ids
    for i, k in enumerate(ids):
        own, nxt = TEXTS[k] or "", TEXTS[ids[(i + 1) % len(ids)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        r = got[k]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["n_signatures"] == len(spots(own)), own
        assert r["near_next"] == pytest.approx(jaccard(spots(own), spots(nxt)))
        assert r["near_edited"] == pytest.approx(jaccard(spots(own), spots(edited)))
    assert got[4]["fingerprint"] == got[13]["fingerprint"] != got[2]["fingerprint"]
    assert got[9]["fingerprint"] == got[7]["fingerprint"]


def test_repeats_nulls_and_one_row(spark):
    docs = spark.createDataFrame([(1, "the one of a kind"), (1, "the one of a kind"), (None, "a null id in the end"), (None, "another of the kind")], "doc_id long, text string")
    assert M.fingerprints(docs).count() == 4
    one = M.fingerprints(docs.limit(1)).first()
    assert one["near_next"] == 1.0
    assert M.fingerprints(docs.where("false")).count() == 0


def test_half_the_ids_null_or_repeated(spark, monkeypatch):
    """Slices stay even where one id fills them, and every row's next is that of the whole order; equal rows give equal rows."""
    monkeypatch.setattr(M.with_next, "__defaults__", (4,))
    rows = [(None, f"null id with text {i} of many") for i in range(90)] + [(7, f"repeated id with text {i} of many") for i in range(70)] + [(i, f"own id {i} of many") for i in range(60)] + [(None, "the same of all")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    draw_of = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, draw_of(r[1])))
    want = []
    for i, (k, own) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(own) // 2
        want += [(str(k), hashlib.sha256((own[: len(own) - half] + nxt[:half]).encode()).hexdigest())] * rows.count((k, own))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in M.fingerprints(docs).collect()) == sorted(want)
    sizes = [r["count"] for r in M.with_next(docs).groupBy("slice").count().collect()]
    assert max(sizes) <= 25 and len(sizes) > 30


def test_partitions_bound_the_likeness(spark):
    sizes = spark.range(1, 200).select(F.sequence(F.lit(1), "id").alias("s")).select(F.size("s").alias("n"), M.length_partition(F.col("s"), 0.8).alias("p")).collect()
    for a in sizes:
        for b in sizes:
            if a["n"] >= 0.8 * b["n"] and b["n"] >= 0.8 * a["n"]:
                assert abs(a["p"] - b["p"]) <= 1
