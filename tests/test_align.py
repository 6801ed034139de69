import random

import pytest

from strandloom.operators.align import Costs, align, relax
from strandloom.operators.graph import character_graph, doubled

LINK = "from_id long, from_fwd boolean, to_id long, to_fwd boolean, overlap int"


def frames(spark, segments, reads, links=()):
    return (
        spark.createDataFrame(list(segments.items()), "seg_id long, seq string"),
        spark.createDataFrame([(a, True, b, True, 0) for a, b in links], LINK),
        spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string"),
    )


def costs_of(rows):
    return {r["read_id"]: r["cost"] for r in rows if r["rank"] == 1}


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_simulated_reads_come_back(spark):
    draw = random.Random(4)
    ref = "".join(draw.choice("ACGT") for _ in range(3000))
    reads, truth = [], []
    for _ in range(25):
        at = draw.randrange(0, 2900)
        piece = list(ref[at : at + 80])
        errors = draw.sample(range(80), draw.choice([0, 0, 1, 2]))
        for i in errors:
            piece[i] = draw.choice([c for c in "ACGT" if c != piece[i]])
        s = "".join(piece)
        reverse = draw.random() < 0.5
        reads.append(rc(s) if reverse else s)
        truth.append((at + 1, "-" if reverse else "+", len(errors)))
    s, l, r = frames(spark, {1: ref}, reads)
    for seed_len in (20, None):
        found = sorted(align(s, l, r, seed_len=seed_len, drop_tail=False).collect(), key=lambda x: x["read_id"])
        assert [(x["start"], x["strand"], x["cost"]) for x in found] == truth
        assert all(x["status"] == "unique" and sum(c.islower() for c in x["spell"]) == x["cost"] for x in found)


def test_kernels_equal_the_relational_plan(spark):
    s, l, r = frames(spark, {1: "ACGTAC", 2: "G", 3: "T", 4: "CCATG", 9: "TTGACCA"}, ["GTACGCCAT", "CATGCCATGCC", "TGGTCA", "NACG", "TTGACA"], [(1, 2), (1, 3), (2, 4), (3, 4), (4, 4)])
    for c in (Costs(), Costs(1, 2, 3, 2)):
        found = align(s, l, r, costs=c, k=50, drop_tail=False).collect()
        per = {}
        for x in found:
            per.setdefault(x["read_id"], []).append(x["cost"])
        want = {x["read_id"]: (x["cost"], x["n_ends"]) for x in relax(doubled(character_graph(s, l, False)), r, c).collect()}
        assert {k: (v[0], len(v)) for k, v in per.items()} == want


def test_small_cases(spark):
    s, l, r = frames(spark, {1: "ACGTTGCATTCGA"}, ["GTTGGCATT", "GTTGATT", rc("GTTGCATT"), "", "ACG"])
    got = {x["read_id"]: (x["cost"], x["strand"], x["status"]) for x in align(s, l, r, costs=Costs(0, 4, 1, 1), drop_tail=False).collect()}
    assert got[0][0] == 1 and got[1][0] == 1 and got[2] == (0, "-", "unique") and got[3] == (None, None, "none") and got[4][0] == 0


def test_ambiguous_and_overcost(spark):
    s, l, r = frames(spark, {1: "TTTTACGTACCTTTT", 2: "GGGGACGTACCGGGG"}, ["ACGTACC", "CACACACACACA"])
    rows = align(s, l, r, k=2, max_cost=2, drop_tail=False).collect()
    first = [x for x in rows if x["read_id"] == 0]
    assert len(first) == 2 and {x["status"] for x in first} == {"ambiguous"} and {x["seg_id"] for x in first} == {1, 2}
    second = [x for x in rows if x["read_id"] == 1]
    assert len(second) == 1 and second[0]["status"] == "overcost" and second[0]["cost"] is None


def test_long_segments_are_cut_without_loss(spark, monkeypatch):
    import strandloom.operators.align as A

    monkeypatch.setattr(A, "PIECE", 50)
    draw = random.Random(1)
    ref = "".join(draw.choice("ACGT") for _ in range(400))
    reads = [ref[i : i + 40] for i in range(0, 360, 7)]
    s, l, r = frames(spark, {1: ref}, reads)
    for seed_len in (10, None):
        found = {x["read_id"]: (x["cost"], x["start"]) for x in align(s, l, r, seed_len=seed_len, drop_tail=False).collect()}
        assert found == {i: (0, 7 * i + 1) for i in range(len(reads))}


def test_bad_parameters():
    with pytest.raises(ValueError):
        Costs(2, 1, 5, 5)
    with pytest.raises(ValueError):
        Costs(0, -1, 5, 5)


def test_batched_kernel_equals_the_single_one():
    import numpy as np

    from strandloom.operators.kernels import SEPARATOR, batch_costs, chain_costs, chain_path, encode, encode_read, straight_path

    draw = random.Random(7)
    for costs in ((0, 1, 5, 5), (0, 1, 1, 1), (1, 2, 3, 2), (0, 3, 1, 0)):
        refs = ["".join(draw.choice("ACGT") for _ in range(draw.randint(0, 30))) for _ in range(40)]
        reads = ["".join(draw.choice("ACGTN") for _ in range(9)) for _ in refs]
        codes = np.full((40, 30), SEPARATOR, dtype=np.uint8)
        for r, s in enumerate(refs):
            codes[r, : len(s)] = encode(s)
        now = batch_costs(codes, np.stack([encode_read(x) for x in reads]), costs)
        for r, s in enumerate(refs):
            want = chain_costs(encode(s), encode_read(reads[r]), costs)
            assert now[r, : len(s) + 1].tolist() == want.tolist()
            assert (now[r, len(s) + 1 :] > want.min()).all()
            end = int(want.argmin())
            quick = straight_path(encode(s)[:end], reads[r], costs, end, int(want[end]))
            assert quick is None or quick == chain_path(encode(s)[:end], reads[r], costs, end)


def test_example_run(spark):
    """The baseline's shape: the cost is that of the errors planted, every read has one optimal end, and seeds, matches, bounds, trie and crumbs are as counted one by one."""
    from bench import example_tables

    from strandloom.operators.index import words
    from strandloom.operators.runs import run_crumbs, segment_runs, trie_crossings, walks_into
    from strandloom.operators.seeds import matches_on_both_strands, root_bounds, seeds

    segments, reads, errors = example_tables(spark)
    assert errors == 15
    for seed_len in (25, None):
        found = align(segments, None, reads, costs=Costs(), seed_len=seed_len, drop_tail=False).collect()
        assert sum(r["cost"] for r in found) == errors and [r["status"] for r in found] == ["unique"] * 100
    genome = segments.first()["seq"]
    asked = {r["read_id"]: r["seq"] for r in reads.collect()}
    cut = seeds(reads, 25)
    matches = matches_on_both_strands(cut, words(segments, 25, ["seg_id"]).withColumnRenamed("word", "kmer"))
    strands = {1: genome, -2: rc(genome)}
    want = {(i, s, run, pos) for i, r in asked.items() for s in range(4) for run, g in strands.items() for pos in range(len(g) - 24) if g.startswith(r[75 - 25 * s : 100 - 25 * s], pos)}
    assert (cut.count(), matches.count()) == (400, len(want)) and len(want) == 400 - errors
    # at the root the first seed does not count, as no whole seed lies behind the first letter but three
    missed = {(i, s) for i in asked for s in range(4)} - {(i, s) for i, s, _, _ in want}
    assert root_bounds(reads, matches, 25).selectExpr("sum(bound) AS h").first()["h"] == sum(s < 3 for _, s in missed)
    none = spark.createDataFrame([], LINK)
    runs, crossings = segment_runs(segments, none, drop_tail=False)
    down = trie_crossings(runs, crossings, 7)
    prefixes = {g[p : p + m] for g in strands.values() for p in range(len(g)) for m in range(1, 7) if p + m <= len(g)}
    jumps = sum(max(0, len(g) - 6) for g in strands.values())
    assert down.select("to_run").where(f"to_run >= {1 << 62}").distinct().count() == len(prefixes) and down.count() == len(prefixes) + jumps
    at = matches.selectExpr("read_id", "seed", "start", "IF(strand = '+', seg_id, ~seg_id) AS run", f"IF(strand = '+', pos, {len(genome)} - pos - 25) AS pos")
    crumbs = run_crumbs(runs, crossings, at, at["start"])
    own = {(i, s, run, p) for i, s, run, pos in want for p in range(max(0, pos - (75 - 25 * s)), pos + 1)}
    assert {tuple(r) for r in crumbs.collect()} == own
    up = {(i, s, strands[run][p - m : p]) for i, s, run, p in own for m in range(7) if p >= m}
    assert walks_into(runs, crossings, crumbs, 7).count() == len(up)


def test_a_long_read_is_traced_in_little_memory():
    """A read of 25,000 letters against a window as long: far below the 600 MB and more of all rows, and the same path as over a short read's full table."""
    import tracemalloc

    from strandloom.operators.kernels import chain_path, encode

    draw = random.Random(2)
    ref = "".join(draw.choice("ACGT") for _ in range(26_000))
    read = list(ref[500:25_500])
    for i in range(1000, 24_000, 4000):
        read[i] = draw.choice([c for c in "ACGT" if c != read[i]])
    del read[12_345]
    tracemalloc.start()
    start, steps = chain_path(encode(ref), "".join(read), (0, 1, 5, 5), 25_500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert start == 500 and peak < 200 << 20
    assert sum(e == "DEL" for _, e in steps) == 1 and sum(e == "SUBST" for _, e in steps) == 6 and len(steps) == 25_000


def test_short_seeds_settle_reads_with_more_errors(spark, monkeypatch):
    """Where long seeds certify nothing, a falling row of shorter ones does: no read is aligned in full."""
    import strandloom.operators.align as A

    draw = random.Random(6)
    ref = "".join(draw.choice("ACGT") for _ in range(4000))
    reads = []
    for i in range(12):
        s = list(ref[300 * i : 300 * i + 100])
        for j in draw.sample(range(100), 4 + i % 3):
            s[j] = draw.choice([c for c in "ACGT" if c != s[j]])
        reads.append("".join(s))
    reads = [r for r in reads if any(r[100 - 25 * (s + 1) : 100 - 25 * s] in ref for s in range(4))]
    assert len(reads) > 4
    s, l, r = frames(spark, {1: ref}, reads)
    want = costs_of(align(s, l, r, drop_tail=False).collect())

    def refused(*_):
        raise AssertionError("a read was aligned in full")

    monkeypatch.setattr(A, "full_ends", refused)
    assert costs_of(align(s, l, r, seed_len=25, drop_tail=False).collect()) == want


def test_reads_that_stand_in_the_reference_are_found_without_windows(spark, monkeypatch):
    """Reads without errors have all their ends where they stand, on both strands, in no seed's window and no full alignment; a few short others are not seeded either."""
    import strandloom.operators.align as A

    draw = random.Random(8)
    ref = "".join(draw.choice("ACGT") for _ in range(700))
    segments = {1: ref[:330], 2: ref[330:650] + ref[20:60], 3: "ACA", 4: rc(ref[100:140]), 5: "G"}
    exact = [ref[20:60], rc(ref[40:59]), ref[100:112], ref[101:108], ref[10:14], "ACA", "G", "ACGT", ref[300:330]]
    changed = ref[200:215] + {"A": "C", "C": "G", "G": "T", "T": "A"}[ref[215]] + ref[216:230]
    s, l, r = frames(spark, segments, [*exact, "", changed, "ACNGTA"])
    want = sorted(map(tuple, align(s, None, r, k=1000, drop_tail=False).collect()), key=str)
    monkeypatch.setattr(A, "PIECE", 50)

    def refused(*_):
        raise AssertionError("a read was seeded")

    monkeypatch.setattr(A, "seeded_ends", refused)
    assert sorted(map(tuple, align(s, None, r, k=1000, seed_len=10, drop_tail=False).collect()), key=str) == want
    whole = r.where(f"read_id < {len(exact)}")
    want = [x for x in want if x[0] < len(exact)]
    assert {x[3] for x in want} == {0}
    monkeypatch.setattr(A, "full_ends", refused)
    assert sorted(map(tuple, align(s, None, whole, k=1000, seed_len=10, drop_tail=False).collect()), key=str) == want
