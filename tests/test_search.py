import random

import pytest

from strandloom.operators.align import Costs, align
from strandloom.operators.search import search

LINK = "from_id long, from_fwd boolean, to_id long, to_fwd boolean, overlap int"


def frames(spark, segments, reads, links):
    return (
        spark.createDataFrame(list(segments.items()), "seg_id long, seq string"),
        spark.createDataFrame([(a, True, b, True, 0) for a, b in links], LINK),
        spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string"),
    )


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def branched(seed, n=6, read_len=20, gaps=False):
    """A graph of bubbles and a cycle, and reads off its walks with errors."""
    draw = random.Random(seed)
    letters = lambda k: "".join(draw.choice("ACGT") for _ in range(k))
    segments, links, at = {}, [], 1
    segments[1] = letters(40)
    for b in range(n // 3):
        left, right, join = at + 1, at + 2, at + 3
        segments |= {left: letters(draw.randint(1, 4)), right: letters(draw.randint(1, 9)), join: letters(draw.randint(30, 60))}
        links += [(at, left), (at, right), (left, join), (right, join)]
        at = join
    links += [(at, 2), (3, 3)]
    after: dict = {}
    for a, b in links:
        after.setdefault(a, []).append(b)
    reads = []
    for j in range(3):
        walk, seg = "", draw.choice(list(segments))
        while len(walk) < read_len + 20 and seg is not None:
            walk += segments[seg]
            seg = draw.choice(after[seg]) if seg in after else None
        s = list(walk[draw.randint(0, 8) :][:read_len])
        for _ in range(2 if j else 0):
            i = draw.randrange(len(s))
            s[i : i + 1] = draw.choice([[], [s[i], draw.choice("ACGT")]]) if gaps else [draw.choice("ACGT")]
        reads.append("".join(s) if draw.random() < 0.5 else rc("".join(s)))
    return segments, links, reads


@pytest.mark.parametrize(("seed", "costs", "bounds"), [(1, Costs(), ("none", "prefix", "seeds")), (2, Costs(1, 2, 2, 2), ("seeds",))])
def test_costs_equal_the_full_way_and_bounds_settle_less(spark, seed, costs, bounds):
    """All strategies find the costs of align on a branched graph; bounds settle strictly fewer states."""
    segments, links, reads = branched(seed, gaps=costs.match > 0)
    s, l, r = frames(spark, segments, [*reads, "", "NACG"], links)
    want = {x["read_id"]: x["cost"] for x in align(s, l, r, costs=costs, drop_tail=False).collect()}
    popped = {}
    for bound in bounds:
        got = search(s, l, r, costs=costs, bound=bound, depth=2, seed_len=5, prefix_length=4, drop_tail=False).collect()
        assert {x["read_id"]: x["cost"] for x in got} == want, bound
        assert {x["status"] for x in got if x["read_id"] < len(reads)} == {"found"} and got[[x["read_id"] for x in got].index(len(reads))]["status"] == "none"
        assert all(0 < x["popped"] <= x["pushed"] for x in got if x["status"] == "found")
        popped[bound] = sum(x["popped"] for x in got)
    assert len(bounds) == 1 or (popped["seeds"] < popped["none"] and popped["prefix"] < popped["none"])


def test_caps_hold(spark):
    segments, links, reads = branched(5)
    s, l, r = frames(spark, segments, reads, links)
    want = {x["read_id"]: x["cost"] for x in align(s, l, r).collect()}
    low = search(s, l, r, bound="seeds", depth=2, seed_len=6, max_cost=1).collect()
    assert {x["read_id"]: x["cost"] for x in low} == {k: v if v <= 1 else None for k, v in want.items()}
    stepwise = search(s, l, r, bound="seeds", depth=2, seed_len=6, max_cost=1, greedy=False).collect()
    assert {x["read_id"]: x["cost"] for x in stepwise} == {x["read_id"]: x["cost"] for x in low}
    assert sum(x["popped"] for x in low) < sum(x["popped"] for x in stepwise)
    assert all(x["status"] == ("found" if want[x["read_id"]] <= 1 else "overcost") for x in low)


def test_reads_without_errors_are_not_searched_and_the_others_only_near_their_seeds(spark, monkeypatch):
    """With exact_first no state is counted for reads that stand in a run, and reads of many seeds join no jumps but those to their crumbs; costs are those planted."""
    import strandloom.operators.search as X

    draw = random.Random(3)
    segments, links, _ = branched(3, n=9)
    segments[50] = "".join(draw.choice("ACGT") for _ in range(300))
    links = [*links, (50, 1), (4, 50)]
    exact = [segments[50][20:52], rc(segments[50][100:140])]
    s = list(segments[50][200:236])
    s[3] = {"A": "C", "C": "G", "G": "T", "T": "A"}[s[3]]
    s, l, r = frames(spark, segments, [*exact, "".join(s), ""], links)
    jumps, given = [], X.trie_crossings

    def counted(runs, crossings, depth, only):
        jumps.append((given(runs, crossings, depth, only).count(), given(runs, crossings, depth).count()))
        return given(runs, crossings, depth, only)

    monkeypatch.setattr(X, "trie_crossings", counted)
    found = {x["read_id"]: x for x in search(s, l, r, bound="seeds", depth=2, seed_len=6, max_cost=1, drop_tail=False, exact_first=True).collect()}
    assert [(found[i]["status"], found[i]["cost"]) for i in range(4)] == [("found", 0), ("found", 0), ("found", 1), ("none", None)]
    assert found[0]["pushed"] == found[1]["popped"] == 0 < found[2]["popped"]
    assert 2 * jumps[0][0] < jumps[0][1]


def test_bad_parameters(spark):
    s, l, r = frames(spark, {1: "ACGT"}, ["AC"], [])
    with pytest.raises(ValueError):
        search(s, l, r, bound="best")
    with pytest.raises(ValueError):
        search(s, l, r, bound="seeds", costs=Costs(1, 1, 1, 1))
