import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import order_minhash as M

DOCS = "doc_id long, text string, class_id string, node string"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 14))
def test_banded_alignment_is_exact(a, b, most):
    d = edit_distance(a, b)
    assert M.edits_within(a, b, most) == (d if d <= most else None)
    assert M.by_diagonals(a, b, most) == (d if d <= most else None)


def test_sketches_follow_order_and_occurrence():
    ids = M.word_ids("a b c d e f g h i j k l m n o p q r s t u v w x y z")
    assert M.sketches(M.labelled(M.kmers(ids))) == M.sketches(M.labelled(M.kmers(ids.copy())))
    h = M.kmers(M.word_ids("x " * 50))
    assert len(np.unique(h)) == 1 and len(np.unique(M.labelled(h))) == len(h)
    assert M.sketches(M.kmers(M.word_ids(""))) == []


def copy_of(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        i = draw.randrange(len(out))
        out[i : i + 1] = draw.choice([[], [out[i], f"new{draw.random()}"], [f"sub{draw.random()}"]])
    return out


def corpus(spark):
    draw = random.Random(3)
    rows, k = [], 0
    vocabulary = [f"v{i}" for i in range(3000)]
    base = []
    for _ in range(25):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([4, 8, 20, 60, 200, 700]))]
        base.append(words)
        for edits in (0, 0, 1, 2, 5, 12):
            rows.append((k, " ".join(copy_of(draw, words, min(edits, len(words) // 2))), "c", "n"))
            k += 1
    hub = [draw.choice(vocabulary) for _ in range(150)]
    for _ in range(80):
        rows.append((k, " ".join(copy_of(draw, hub, draw.choice([1, 2, 9]))), "c", "n"))
        k += 1
    rows += [(500, None, "c", "n"), (501, "", "c", "n"), (502, "  \n", "c", "n"), (None, rows[3][1], "c", "n"), (3, rows[3][1], "c", "n"), (600, "long tail " * 9000 + "x", "c", "n"), (601, "long tail " * 9000 + "y", "c", "n")]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, DOCS)


def similar(a, b, threshold):
    """By the definition, with nothing of the module: words, common ends trimmed, the full matrix of what is left."""
    most = int((1 - threshold) * max(len(a), len(b)) + 1e-9)
    if max(len(a), len(b)) - (Counter(a) & Counter(b)).total() > most:
        return False  # so many words of the longer have no partner
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return edit_distance(a, b) <= most


def brute(rows, threshold=0.8):
    texts = [r["text"] or "" for r in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    parent = list(range(len(rows)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and (texts[i] == texts[j] or (words[i] and words[j] and similar(words[i], words[j], threshold))):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            low[find(i)] = min(low.get(find(i), 1 << 60), r["doc_id"])
    return sorted((str(r["doc_id"]), low[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("words", [30, 40, 41, 60, 300])
def test_sketches_meet_on_both_sides_of_short(words):
    """Pairs with edits at random in a fifth of their words share as many sketches as a group asks for, just under, just over and far from SHORT."""
    draw = random.Random(words)
    met = 0
    for _ in range(200):
        text = [f"w{draw.random()}" for _ in range(words)]
        other = list(text)
        for at in draw.sample(range(words), words // 5):
            other[at] = f"new{draw.random()}"
        met += len(set(M.text_sketches(M.word_ids(" ".join(text)))) & set(M.text_sketches(M.word_ids(" ".join(other))))) >= M.MEETINGS
    assert met >= 198


def test_texts_without_ids_and_repeated_ids(spark):
    rows = [(None, "one text that no id holds at all", "c", "n")] * 3 + [(None, "one text that no id holds at last", "c", "n"), (7, "first text under seven with words", "c", "n"), (7, "first text under seven with letters", "c", "n"), (8, "", "c", "n"), (9, None, "c", "n")]
    got = M.near_duplicates(spark.createDataFrame(rows, DOCS), threshold=0.8).collect()
    assert len(got) == len(rows)
    assert {r["class_id"] for r in got if r["doc_id"] is None} == {None}
    assert len({r["text_id"] for r in got if r["doc_id"] is None and r["kept"]}) == 1
    assert sum(r["kept"] for r in got if r["doc_id"] == 7) == 1
    assert {(r["doc_id"], r["class_id"], r["n_copies"]) for r in got if r["doc_id"] in (8, 9)} == {(8, 8, 2), (9, 8, 2)}


def test_classes_equal_brute_force(spark, monkeypatch):
    docs = corpus(spark)
    rows = docs.collect()
    want = brute(rows)
    got = M.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["class_id"]) for r in got) == want
    assert {(r["doc_id"], r["text_id"]) for r in got if r["kept"]} <= {(r["doc_id"], r["text_id"]) for r in got if r["doc_id"] == r["class_id"]} and len({r["class_id"] for r in got}) == len({r["doc_id"] for r in got if r["kept"]})
    # groups larger than a block go block against block
    monkeypatch.setattr(M, "BLOCK_TEXTS", 16)
    assert sorted((str(r["doc_id"]), r["class_id"]) for r in M.near_duplicates(docs).collect()) == want


def test_edit_similarity_alone_decides(spark):
    """Copies with spread edits, similar in words though their shingles have Jaccard far under 0.8, are linked; texts under 0.8 are not."""
    draw = random.Random(11)
    rows = []
    for i in range(40):
        words = [f"w{draw.random()}" for _ in range(draw.choice([10, 30, 60, 142, 500]))]
        for copy, share in enumerate((0, 0.05, 0.15, 0.3)):
            edited = list(words)
            for at in draw.sample(range(len(words)), int(share * len(words))):
                edited[at] = f"new{draw.random()}"
            rows.append((10 * i + copy, " ".join(edited), "c", "n"))
    rows += [(1000, "a b c d e", "c", "n"), (1001, "a b x d e", "c", "n")]
    classes = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert classes[1001] == 1000
    for i in range(40):
        assert [classes[10 * i + c] for c in range(4)] == [10 * i] * 3 + [10 * i + 3]


def test_stage_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "c", "n"), (2, "a b c d e f g", "c", "n"), (2, "a b c d e f g", "c", "n"), (3, "other words entirely in here now", "c", "n"), (2, "the id of a copy with words of its own", "c", "n")], DOCS)
    kept = M.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert M.near_duplicates(docs.where("false")).count() == 0
