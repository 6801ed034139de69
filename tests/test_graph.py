from pyspark.sql import functions as F

from strandloom.operators import graph as G
from strandloom.operators import index as I
from strandloom.operators import seeds as D
from strandloom.operators.components import components
from strandloom.operators.prefixes import prefix_costs

LINK = "from_id long, from_fwd boolean, to_id long, to_fwd boolean, overlap int"


def graph(spark, segments, links=()):
    s = spark.createDataFrame(list(segments.items()), "seg_id long, seq string")
    return s, spark.createDataFrame([(a, True, b, True, 0) for a, b in links], LINK)


def test_tail_is_dropped_or_kept(spark):
    s, l = graph(spark, {1: "ACGT"})
    assert G.character_graph(s, l).count() == 3
    assert G.character_graph(s, l, drop_tail=False).count() == 4
    s, l = graph(spark, {1: "ACGT", 2: "A"}, [(1, 2)])
    assert G.character_graph(s, l).count() == 4


def test_ambiguity_gives_parallel_edges(spark):
    s, l = graph(spark, {1: "ACRT"})
    labels = sorted(r["label"] for r in G.character_graph(s, l, False).collect())
    assert labels == ["A", "A", "C", "G", "T"]


def test_doubling(spark):
    s, l = graph(spark, {1: "AC"})
    got = {(r["src"] < 0, r["label"]) for r in G.doubled(G.character_graph(s, l)).collect()}
    assert got == {(False, "A"), (True, "T")}


def test_degrees_sources_size(spark):
    s, l = graph(spark, {1: "A", 2: "C", 3: "G", 4: "T"}, [(1, 2), (1, 3), (2, 4), (3, 4)])
    e = G.character_graph(s, l)
    at = {r["node"] >> 32: (r["out_degree"], r["in_degree"]) for r in G.degrees(e).collect()}
    assert at == {1: (2, 0), 2: (1, 1), 3: (1, 1), 4: (0, 2)}
    assert [r["node"] >> 32 for r in G.source_nodes(e).collect()] == [1]
    assert tuple(G.graph_size(e).first()) == (4, 4)
    assert G.edge_between(e, 1 << 32, 2 << 32).count() == 1


def test_subgraphs(spark):
    s, l = graph(spark, {1: "A", 2: "C", 3: "G"}, [(1, 2), (2, 3)])
    ids = spark.createDataFrame([(1,), (2,)], "seg_id long")
    seg, links = G.induced_subgraph(s, l, ids)
    assert seg.count() == 2 and [(r["from_id"], r["to_id"]) for r in links.collect()] == [(1, 2)]
    pairs = spark.createDataFrame([(2, 1)], "from_id long, to_id long")
    assert G.induced_subgraph(s, l, ids, pairs)[1].count() == 1
    more = graph(spark, {3: "T", 4: "A"}, [(3, 4)])
    seg, links = G.add_subgraph(s, l, *more)
    assert {r["seg_id"]: r["seq"] for r in seg.collect()} == {1: "A", 2: "C", 3: "G", 4: "A"} and links.count() == 3


def test_linearise(spark):
    s, l = graph(spark, {i: "A" for i in range(1, 12)}, [(i, i + 1) for i in range(1, 10)])
    got = sorted((r["start_id"], r["step"], r["seg_id"]) for r in G.linearise(s, l).collect())
    assert got == [(1, i, i + 1) for i in range(10)] + [(11, 0, 11)]


def test_trie_on_a_graph_equals_the_linear_form(spark):
    seq = "ACGTACCAGT"
    s, l = graph(spark, {1: seq})
    e = G.doubled(G.character_graph(s, l, drop_tail=False))
    levels, jumps = I.trie(e, 4)
    linear = I.trie_of_sequences(s, 4)
    key = lambda df: {(r["prefix"], r["n_walks"]) for r in df.collect()}
    assert key(levels) == key(linear)
    assert jumps.count() == 2 * (len(seq) - 3)
    shallow = {r["prefix"] for r in I.shallow_trie(linear).collect()}
    counts = dict(key(linear))
    assert shallow == {p for p in counts if len(p) == 1 or counts[p[:-1]] > 1}


def test_walks_only_along_wanted_prefixes(spark):
    s, l = graph(spark, {1: "ACGTAC"})
    e = G.character_graph(s, l, False)
    only = spark.createDataFrame([("A",), ("AC",)], "prefix string")
    assert I.walks(e, 2, only).count() == 2


def test_classes(spark):
    s, l = graph(spark, {1: "ACGACG"})
    e = G.character_graph(s, l, False)
    classes = {r["node"] & 0xFFFFFFFF: r["representative"] & 0xFFFFFFFF for r in I.node_classes(e, 2).collect()}
    assert classes == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 5, 6: 6}


def test_seeds_and_bounds(spark):
    reads = spark.createDataFrame([(0, "ACGTTTGGA"), (1, "AC")], "read_id long, seq string")
    cut = D.seeds(reads, 4)
    assert sorted((r["seed"], r["start"], r["kmer"]) for r in cut.collect()) == [(0, 5, "TGGA"), (1, 1, "CGTT")]
    s, _ = graph(spark, {5: "ACGTTAAA"})
    m = D.seed_matches(cut, I.kmers(s, 4))
    assert [(r["seed"], r["pos"], r["strand"]) for r in m.collect()] == [(1, 1, "+")]
    bound = {r["read_id"]: (r["n_seeds"], r["found"], r["bound"]) for r in D.root_bounds(reads, m, 4).collect()}
    assert bound == {0: (2, 1, 1), 1: (0, 0, 0)}


def test_crumbs_agree_on_a_line(spark):
    from pyspark.sql import functions as F

    s, l = graph(spark, {1: "ACGTTGCATGCC"})
    e = G.character_graph(s, l, False)
    matches = spark.createDataFrame([(0, 0, 4, 1, 8, "+")], "read_id long, seed int, start int, seg_id long, pos int, strand string")
    linear = sorted(r["node"] for r in D.linear_crumbs(matches, F.lit(2)).collect())
    at = matches.select("read_id", "seed", "start", (F.lit(1 << 32) + F.col("pos")).alias("node"))
    assert linear == sorted(r["node"] & 0xFFFFFFFF for r in D.graph_crumbs(e, at, 2).collect()) == [4, 5, 6, 7, 8]


def test_prefix_costs_are_bounds(spark):
    s, l = graph(spark, {1: "ACGTT"})
    e = G.character_graph(s, l, False)
    want = [((1 << 32), "ACG"), ((1 << 32), "AGG"), ((1 << 32), "CGT"), ((1 << 32), "TTTTT"), ((1 << 32) + 3, "TTA")]
    got = {(r["node"] - (1 << 32), r["prefix"]): r["cost"] for r in prefix_costs(e, spark.createDataFrame(want, "node long, prefix string"), cap=3, ins=2, dele=2).collect()}
    assert got == {(0, "ACG"): 0, (0, "AGG"): 1, (0, "CGT"): 2, (0, "TTTTT"): 3, (3, "TTA"): 2}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (4, 4), (3, 7), (7, 6)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 6: 1, 8: 8, 9: 8}


def test_crumbs_up_the_index_and_looked_up(spark):
    from strandloom.operators.seeds import crumbs_at, sorted_crumbs, trie_crumbs

    crumbs = spark.createDataFrame([(1, 0, 10), (1, 2, 10), (1, 0, 10), (2, 1, 11)], "read_id long, seed int, node long")
    up = trie_crumbs(crumbs, spark.createDataFrame([("AC", 10), ("AG", 10), ("AC", 11)], "prefix string, node long"))
    assert sorted(map(tuple, up.collect())) == [(1, s, p) for s in (0, 2) for p in ("", "A", "AC", "AG")] + [(2, 1, p) for p in ("", "A", "AC")]
    states = spark.createDataFrame([(1, 10, 2), (1, 10, 3), (1, 11, 3), (2, 11, 1)], "read_id long, node long, below int")
    assert sorted(map(tuple, crumbs_at(crumbs, states).collect())) == [(1, 10, 2, 1), (1, 10, 3, 2), (1, 11, 3, 0), (2, 11, 1, 0)]
    assert [tuple(r) for r in sorted_crumbs(crumbs).select("read_id", "node", "seed").collect()] == [(1, 10, 0), (1, 10, 2), (2, 11, 1)]


def test_exponential_mean_with_one_order_value(spark):
    """200,000 rows of one order value: the mean follows the ties, and no weight overflows."""
    from pyspark.sql import functions as F

    from strandloom.operators.windows import exponential_mean

    rows = spark.range(200_000).selectExpr("1 AS o", "id", "CAST(id % 7 AS double) AS v")
    got = {r["id"]: r["ewm"] for r in exponential_mean(rows, "o", ["id"], F.col("v")).where("id % 19_999 = 0".replace("_", "")).select("id", "ewm").collect()}
    q, a, b = 1 - 2 / 401, 0.0, 0.0
    for i in range(200_000):
        a, b = a * q + i % 7, b * q + 1
        if i % 19_999 == 0:
            assert abs(got[i] - a / b) < 1e-9


def test_tables_of_an_evaluation(spark):
    """Means with a null x beside 'all', tables pasted by position where order values repeat, axes of unknown columns, edges stacked."""
    from strandloom.operators import analysis as N

    runs = spark.createDataFrame([("a", 1, 2.0), ("a", None, 4.0), ("b", 1, None), (None, 2, 1.0)], "algo string, x int, y double")
    assert {tuple(r) for r in N.group_means(runs, "algo", "x", "y").collect()} == {("a", "1", 2.0, 1), ("a", None, 4.0, 1), ("b", "1", None, 0), (None, "2", 1.0, 1), ("a", "all", 3.0, 2), ("b", "all", None, 0), (None, "all", 1.0, 1)}
    left = spark.createDataFrame([(3, "z"), (1, "y"), (1, "x")], "k int, v string")
    right = spark.createDataFrame([(9, "p"), (-1, "q")], "o int, w string")
    assert sorted((r["v"], r["w"]) for r in N.paste(left, right, ["k", "v"], ["o"]).collect()) == [("x", "q"), ("y", "p")]
    assert N.paste(left, right.limit(0), ["k"], ["o"]).count() == 0
    shown = {r["measure"]: (r["label"], r["unit"]) for r in N.column_means(left.select(F.col("k").alias("N"), F.col("k").alias("other")), ["N", "other"]).collect()}
    assert shown == {"N": ("Reads", ""), "other": ("other", "other")}
    edges = spark.createDataFrame([(4, 10, 4), (4, 20, 6)], "d int, total_edges int, trie_edges int")
    assert [tuple(r) for r in N.stacked_edges(edges, "d").collect()] == [(4, 10.0, 5.0, 15.0)]
