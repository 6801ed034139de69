"""Queries on linear sequences do their work where the letters lie, and large groups are shuffled once."""

from strandloom.operators import graph as G
from strandloom.operators import index as I
from strandloom.plans import queries as core


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_classes_of_sequences_equal_those_of_the_graph(spark, data):
    seg = spark.createDataFrame([(3, "ACGTACGTAC"), (1, "TACGTACG"), (2, "A"), (4, ""), (5, "ACGTA"), (6, "ACGTAC"), (7, None)], "seg_id long, seq string")
    classes = I.node_classes(G.sequence_edges(seg), 5).where("boundary IS NOT NULL").groupBy("representative").count()
    want = {(r["representative"], r["count"]) for r in classes.collect()}
    assert {(r["representative"], r["n_nodes"]) for r in I.classes_of_sequences(seg, 5).collect()} == want
    assert "Join" not in plan_of(core.QUERIES["class_representatives"](spark, data))[0]


def test_edit_counts_equal_the_moves_one_by_one(spark, data):
    from pyspark.sql import functions as F

    from strandloom.functions import sequence as S

    edges = G.sequence_edges(spark.createDataFrame([(3, "ACGTACCGTAC"), (1, "TA"), (2, "A"), (4, ""), (5, "AAAA")], "seg_id long, seq string"))
    both = G.doubled(edges)
    moves = G.edit_edges(G.nodes(both).select("node", F.explode(F.array(*map(F.lit, "ACGT"))).alias("letter")), both)
    strand = F.when(S.on_reverse(F.col("to")), "-").otherwise("+").alias("strand")
    want = moves.groupBy(S.node_segment(F.col("to")).alias("seg_id"), strand, "move", "label").agg(F.count("*"), F.sum(S.node_offset(F.col("to"))))
    got = G.edit_counts(edges).select("seg_id", "strand", "move", "label", "n", "to_offsets")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in plan_of(core.QUERIES["edit_expand_all"](spark, data))[0]


def test_prefix_h_meets_the_first_letters_of_its_classes_only(spark, data, monkeypatch):
    seen, given = [], core.prefix_costs
    monkeypatch.setattr(core, "prefix_costs", lambda edges, wanted: seen.append(edges.count()) or given(edges, wanted))
    out = core.QUERIES["prefix_h"](spark, data)
    classes = core.sequences(spark, data).where("length(seq) > 5").selectExpr("left(seq, 5) AS ahead").distinct().count()
    assert out.select("node").distinct().count() == classes and seen == [5 * classes]


def test_neighbours_on_lines_are_those_of_the_joins(spark, data):
    e = G.sequence_edges(spark.createDataFrame([(3, "ACGTAC"), (1, "TA"), (2, "A"), (4, ""), (5, "ACG")], "seg_id long, seq string"))
    met = G.expand_forward(G.nodes(e), e).select("node", "label", "dst").join(G.expand_backward(G.nodes(e), e).select("node", "src"), "node")
    assert sorted(map(tuple, G.neighbours_on_lines(e).collect())) == sorted(map(tuple, met.collect()))
    assert "Exchange" not in plan_of(core.QUERIES["adjacency"](spark, data))[1]


def test_jumps_of_sequences_equal_those_of_the_graph(spark, data):
    seg = spark.createDataFrame([(3, "ACGTACGTAC"), (1, "TACGT"), (2, "A"), (4, ""), (5, "ACGT")], "seg_id long, seq string")
    want = I.trie(G.sequence_edges(seg), 4)[1]
    assert sorted(map(tuple, I.jumps_of_sequences(seg, 4).collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in plan_of(core.QUERIES["trie_jumps"](spark, data))[0]


def test_size_of_sequences_is_the_graphs(spark, data):
    seg = spark.createDataFrame([(3, "ACGTACGTAC"), (1, "TACGT"), (2, "A"), (4, ""), (5, None)], "seg_id long, seq string")
    assert G.size_of_sequences(seg).collect() == G.graph_size(G.sequence_edges(seg)).collect()
    assert G.size_of_sequences(seg.where("false")).collect() == [(0, 0)]
    assert "hashpartitioning" not in plan_of(core.QUERIES["graph_size"](spark, data))[1]


def test_edge_list_shuffles_no_edges(spark, data):
    assert "hashpartitioning" not in plan_of(core.QUERIES["edge_list"](spark, data))[1]


def test_counted_crumbs_equal_crumbs_counted_one_by_one(spark, data):
    from pyspark.sql import functions as F

    from strandloom.operators import seeds as D

    rows = [(1, s, start, "+-"[p % 2], g, p) for g in (1, 2) for s, start in ((0, 20), (1, 10), (2, 0)) for p in (0, 1, 3, 4, 17, 18, 30, 31, 60)] * 2
    m = spark.createDataFrame(rows, "read_id long, seed int, start int, strand string, seg_id long, pos int")
    want = D.linear_crumbs(m, F.lit(1)).distinct().groupBy("read_id", "strand", "seg_id", "node").agg(F.count("*"), F.sum("seed"))
    assert sorted(map(tuple, D.counted_crumbs(m, F.lit(1)).collect())) == sorted(map(tuple, want.collect()))
    # the rows of nodes come last: none is aggregated or shuffled
    assert plan_of(core.QUERIES["crumb_lookup"](spark, data))[0].split("Window")[0].count("Aggregate") == 0


def test_matches_inside_runs_are_not_shuffled(spark):
    from strandloom.operators import runs as R
    from strandloom.operators import seeds as D
    from strandloom.operators.lineage import settled

    seg = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "GTACGTAA"), (3, "C"), (4, "ACGT")], "seg_id long, seq string")
    links = spark.createDataFrame([(a, True, b, True, 0) for a, b in ((1, 2), (1, 3), (3, 2), (3, 4), (2, 4))], "from_id long, from_fwd boolean, to_id long, to_fwd boolean, overlap int")
    runs, crossings = R.segment_runs(seg, links)
    reads = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGTACCA"), (3, "ACGTACGTACGT")], "read_id long, seq string")
    found = R.seed_walks(settled(runs), settled(crossings), settled(D.seeds(reads, 4)), 4)
    rows = [tuple(r) for r in found.collect()]
    assert rows and len(rows) == len(set(rows))
    inside, over = plan_of(found)[0].split("Aggregate", 1)
    # one side of the union, the matches inside runs, comes before the aggregate and stands above none
    assert "Union" in inside and plan_of(found)[0].count("Aggregate") == 1 and "Join Inner" in inside


def test_spans_of_crumbs_cover_each_node_once(spark):
    from strandloom.operators import runs as R
    from strandloom.operators.lineage import settled

    seg = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "GTACGTAA"), (3, "C"), (4, "ACGT")], "seg_id long, seq string")
    links = spark.createDataFrame([(a, True, b, True, 0) for a, b in ((1, 2), (1, 3), (3, 2), (2, 4), (4, 1))], "from_id long, from_fwd boolean, to_id long, to_fwd boolean, overlap int")
    runs, crossings = map(settled, R.segment_runs(seg, links))
    at = [(1, s, 8 * s, r, p) for s in (0, 1) for r, p in ((1, 3), (1, 4), (1, 8), (4, 1), (-2, 6), (-3, 2))]
    matches = spark.createDataFrame(at, "read_id long, seed int, start int, run long, pos int")
    length = {r["run"]: len(r["label"]) for r in runs.collect()}
    back = {}
    for c in crossings.collect():
        back.setdefault(c["to_run"], set()).add(c["run"])
    want = set()
    for rid, seed, start, run, pos in at:
        front = {(run, pos)}
        for _ in range(start + 1):
            want |= {(rid, seed, *node) for node in front}
            front = {(r, p - 1) for r, p in front if p} | {(b, length[b]) for r, p in front if not p for b in back.get(r, ())}
    spans = settled(R.crumb_spans(runs, crossings, matches, matches["start"]))
    rows = [(s["read_id"], s["seed"], s["run"], p) for s in spans.collect() for p in range(s["lo"], s["hi"] + 1)]
    assert len(rows) == len(set(rows)) and set(rows) == want
    crumbs = spark.createDataFrame(rows, "read_id long, seed int, run long, pos int")
    assert sorted(map(tuple, R.walks_into_spans(runs, crossings, spans, 6).collect())) == sorted(map(tuple, R.walks_into(runs, crossings, crumbs, 6).collect()))
