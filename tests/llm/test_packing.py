import random
from collections import defaultdict

from strandloom.llm.packing import Bins, pack, packing_stage

DOCS = "doc_id long, text string, source string, bin_id string"


def corpus(spark, n=300):
    draw = random.Random(8)
    rows = [(i, " ".join(["w%d" % draw.randint(0, 999)] * draw.choice([1, 3, 40, 90, 130, 250])), draw.choice(["hot", "hot", "b", None]), "x") for i in range(n)]
    rows += [(1000 + i, "same text in every row", "hot", "x") for i in range(60)] + [(7, rows[7][1], rows[7][2], "x")] * 2
    rows += [(None, "null id", None, "x"), (2000, None, "b", "x"), (2001, " \n ", "b", "x"), (2002, "long " * 1234, "b", "x")]
    return spark.createDataFrame(rows, DOCS)


def check(docs, rows, capacity, per_source):
    text = {(r["doc_id"]): r for r in docs.collect()}
    bins, covered = defaultdict(list), defaultdict(list)
    for r in rows:
        if r["n_words"]:
            bins[r["bin_id"]].append(r)
        else:
            assert r["bin_id"] is None
        covered[r["doc_id"], r["copy"]].append((r["start_word"], r["n_words"]))
    for held in bins.values():
        at = sorted((r["offset"], r["n_words"]) for r in held)
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
        assert sum(n for _, n in at) <= capacity
        texts = [text[r["doc_id"]]["text"] for r in held]
        assert len(set(texts)) == len(texts)
        sources = [text[r["doc_id"]]["source"] for r in held]
        assert all(sources.count(s) <= per_source for s in set(sources))
    for (doc, _), parts in covered.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(n for _, n in parts) == len((text[doc]["text"] or "").split())
    assert len(covered) == docs.count()


def test_everything_is_packed_once(spark):
    docs = corpus(spark)
    for shard_words in (1 << 20, 5000):
        rows = pack(docs, capacity=256, per_source=2, shard_words=shard_words).collect()
        check(docs, rows, 256, 2)


def test_the_tightest_compatible_bin_is_taken():
    draw = random.Random(1)
    for _ in range(30):
        b, state = Bins(50, 1), []
        for _ in range(80):
            size, source, cluster = draw.randint(1, 30), draw.randrange(12), draw.randrange(30)
            fits = [(s[0], i) for i, s in enumerate(state) if s[0] >= size and source not in s[1] and cluster not in s[2]]
            got, offset = b.place(size, source, cluster)
            if fits:
                assert state[got][0] == min(fits)[0] and (state[got][0], got) in fits
            else:
                assert got == len(state)
                state.append([50, set(), set()])
            assert offset == 50 - state[got][0]
            state[got][0] -= size
            state[got][1].add(source)
            state[got][2].add(cluster)


def test_reruns_agree_and_empty(spark):
    docs = corpus(spark, 80)
    a, b = (sorted(map(tuple, pack(d, capacity=256).collect()), key=str) for d in (docs, docs.repartition(5)))
    assert a == b
    assert pack(docs.where("false")).count() == 0


def test_named_clusters_and_stage(spark):
    """Pieces of one named class never share a bin; the stage packs as the operator does, texts without words included."""
    rows = [(i, f"text number {i} of some words", "s", "one" if i < 6 else None, "x") for i in range(12)] + [(None, None, None, None, "x"), (50, "", "s", "one", "x")] + [(60, "again", "t", None, "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, family string, bin_id string")
    found = pack(docs, cluster="family", capacity=100, per_source=20).collect()
    bins = [r["bin_id"] for r in found if r["doc_id"] is not None and r["doc_id"] < 6]
    assert len(set(bins)) == 6 and None not in bins
    assert [(r["n_words"], r["bin_id"]) for r in found if r["doc_id"] in (None, 50)] == [(0, None)] * 2
    again = [r for r in found if r["doc_id"] == 60]
    assert sorted(r["copy"] for r in again) == [1, 2, 3] and len({r["bin_id"] for r in again}) == 3
    assert sorted(map(tuple, packing_stage(spark, docs, "").collect()), key=str) == sorted(map(tuple, pack(docs).collect()), key=str)
    assert packing_stage(spark, docs.where("false"), "").count() == 0


def test_a_hot_source_or_cluster_is_not_scanned():
    """100,000 one-word items of one source, then 30,000 of one cluster: seconds, not hours."""
    import time

    began = time.time()
    b = Bins(2048, 4)
    for _ in range(100_000):
        b.place(1, 0, -1)
    assert len(b.residual) == 25_000
    for i in range(30_000):
        b.place(1, 1 + i, 7)
    assert len(b.residual) == 30_000 and time.time() - began < 30
