import pytest

from strandloom.operators.analysis import alignment_summary, compare_runs, with_rates
from strandloom.plans.aligner import Parameters, parse, report, run
from strandloom.sources import graph_files as GF
from strandloom.sources import reads as R
from strandloom.sources import tables as T


def test_gfa_round_trip(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("H\tVN:Z:1.0\nS\t1\tacgt\nS\t2\tGG\nL\t1\t+\t2\t+\t0M\n")
    s, l = GF.read_gfa(spark, str(tmp_path / "g.gfa"))
    GF.validate_gfa(s, l)
    assert {tuple(r) for r in s.collect()} == {(1, "ACGT"), (2, "GG")}
    assert [tuple(r) for r in l.collect()] == [(1, True, 2, True, 0)]
    GF.write_gfa(s, l, str(tmp_path / "out"))
    s2, l2 = GF.read_gfa(spark, str(tmp_path / "out"))
    assert s2.exceptAll(s).isEmpty() and l2.exceptAll(l).isEmpty() and s2.count() == 2


@pytest.mark.parametrize("lines", ["S\t1\tACNT\n", "S\t1\tAC\nL\t1\t+\t1\t-\t0M\n", "S\t1\tAC\nL\t1\t+\t1\t+\t3M\n"])
def test_gfa_refuses(spark, tmp_path, lines):
    (tmp_path / "g.gfa").write_text(lines)
    with pytest.raises(ValueError):
        GF.read_reference(spark, str(tmp_path / "g.gfa"))


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">one first\nACGT\nac\n>two\nGG\n")
    assert {tuple(r) for r in GF.read_fasta(spark, str(tmp_path / "r.fa")).collect()} == {("one first", "ACGTAC"), ("two", "GG")}
    s, l, drop = GF.read_reference(spark, str(tmp_path / "r.fa"))
    assert s.count() == 2 and l.isEmpty() and not drop
    with pytest.raises(ValueError):
        GF.read_reference(spark, "x.txt")
    tailed, links = GF.linear_with_tail(s.select("seg_id", "seq"))
    assert tailed.count() == 4 and links.count() == 2


def test_fasta_numbers_follow_the_names(spark):
    names = [f"n{i:03d}" for i in range(200)] + ["n007", "n007"]
    rows = GF.fasta_segments(spark.createDataFrame([(n, "AC" if i < 201 else "AA") for i, n in enumerate(names)], "name string, seq string").repartition(7))[0].collect()
    assert [(r["name"], r["seq"]) for r in sorted(rows, key=lambda r: r["seg_id"])] == sorted((n, "AC" if i < 201 else "AA") for i, n in enumerate(names))
    assert sorted(r["seg_id"] for r in rows) == list(range(1, 203))
    assert GF.fasta_segments(spark.createDataFrame([], "name string, seq string"))[0].isEmpty()


def test_throughput_by_technology(spark):
    from strandloom.operators.analysis import with_technology_throughput, within_limits

    runs = spark.createDataFrame([("illumina", 10, 100, 7, 2.0, 3000.0), ("hifi", 10, 100, 7, 2.0, 3000.0), ("hifi-natural", 10, 100, 7, 2.0, 3000.0)], "sequencing_technology string, N int, m int, head int, s double, max_rss double")
    got = {r["sequencing_technology"]: (r["bps"], r["kbps"], r["GB"]) for r in with_technology_throughput(runs).collect()}
    assert got == {"illumina": (500.0, 0.5, 3.0), "hifi": (35.0, pytest.approx(0.035), 3.0), "hifi-natural": (25e6, 25e3, 3.0)}
    with pytest.raises(Exception, match="unknown technology"):
        with_technology_throughput(runs.replace("hifi", "other")).collect()
    edge = spark.createDataFrame([(3600.0, 20000.0), (3600.1, 1.0), (1.0, 20000.1)], "s double, mb double")
    assert within_limits(edge, "s", "mb").count() == 1


def test_fastq_over_many_splits(spark, tmp_path):
    n = 500
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\n{'ACGT' * (1 + i % 3)}\n+\n{'IIII' * (1 + i % 3)}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        rows = R.read_queries(spark, str(tmp_path / "r.fq")).orderBy("read_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["read_id"], r["name"], len(r["seq"]), len(r["phred"])) for r in rows] == [(i, f"r{i}", 4 * (1 + i % 3), 4 * (1 + i % 3)) for i in range(n)]


@pytest.mark.parametrize("size", [61, 150, 997, 1 << 20])
def test_reads_of_several_files_and_cuts(spark, tmp_path, size):
    """Qualities that start like names and comments, reads longer than a split, several files: every record once, numbered file after file."""
    qualities = ["@@+>", "+I@I", ">III", "IIII"]
    want = []
    for f in range(3):
        text = ""
        for i in range(90 + f):
            n = 60 if i % 17 == 0 else 1 + i % 3
            text += f"@f{f}r{i}\n{'ACGT' * n}\n+c{i}\n{qualities[i % 4] * n}\n"
            want.append((f"f{f}r{i}", "ACGT" * n, f"c{i}", qualities[i % 4] * n))
        (tmp_path / f"part {f}.fq").write_text(text + "\n" * f)
    (tmp_path / "one.fa").write_text("".join(f">r{i}\n{'ACGT' * (1 + i % 30)}\n" for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = R.read_fastq(spark, f"{tmp_path}/*.fq").orderBy("read_id").collect()
        fasta = R.read_queries(spark, f"{tmp_path}/one.fa").orderBy("read_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r)[1:] for r in rows] == want
    assert [r["read_id"] for r in rows] == [(f << R.FILE_BITS) + i for f in range(3) for i in range(90 + f)]
    assert [(r["read_id"], r["name"], r["seq"]) for r in fasta] == [(i, f"r{i}", "ACGT" * (1 + i % 30)) for i in range(200)]


def test_only_ends_of_splits_are_shuffled(spark, tmp_path):
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(500)))
    (tmp_path / "none.fq").write_text("")
    (tmp_path / "cut.fq").write_text("@a\nACGT\n+\nIIII\n@b\n" + "@c\nACGT\n+\nIIII\n" * 50)
    plan = R.read_fastq(spark, f"{tmp_path}/r.fq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the other branch reads the checkpointed ends
    whole = plan[plan.index("Union") : plan.index("MapInArrow")]
    assert "BroadcastHashJoin" in whole and "Exchange" not in whole
    assert R.read_fastq(spark, f"{tmp_path}/none.fq").count() == 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        with pytest.raises(Exception, match="more or less than 4 lines"):
            R.read_fastq(spark, f"{tmp_path}/cut.fq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fasta_queries_and_bad_letters(spark, tmp_path):
    (tmp_path / "q.fa").write_text(">a\nacn\n>b\nGT\n")
    assert [(r["name"], r["seq"]) for r in R.read_queries(spark, str(tmp_path / "q.fa")).orderBy("read_id").collect()] == [("a", "ACN"), ("b", "GT")]
    (tmp_path / "bad.fa").write_text(">a\nAXC\n")
    with pytest.raises(Exception, match="not a nucleotide"):
        R.read_queries(spark, str(tmp_path / "bad.fa")).collect()
    with pytest.raises(ValueError):
        R.read_queries(spark, "reads.bam")


def test_command_line(spark, tmp_path):
    ref = "ACGTTGCATTCGAGGTCATTACGGACTTAGCA"
    (tmp_path / "g.gfa").write_text(f"S\t1\t{ref}A\n")
    (tmp_path / "q.fq").write_text("".join(f"@r{i}\n{ref[i : i + 20]}\n+\n{'I' * 20}\n" for i in range(8)))
    p = parse(["align-optimal", "-g", str(tmp_path / "g.gfa"), "-q", str(tmp_path / "q.fq"), "-o", str(tmp_path / "out"), "-a", "astar-seeds", "--fixed_trie_depth", "1", "--seeds_len", "6"])
    rows, statistics = run(spark, p)
    T.write_table(rows, f"{p.output}/alignments.tsv")
    T.write_statistics(statistics, f"{p.output}/stats.log")
    back = T.read_alignments(spark, f"{p.output}/alignments.tsv")
    assert {(r["readname"], r["cost"], r["start"], r["strand"], r["unique_best"]) for r in back.collect()} == {(f"r{i}", 0, i + 1, "+", 1) for i in range(8)}
    assert "total_cost: 0" in report(statistics)
    assert with_rates(back).where("error_rate = 0").count() == 8
    verdicts = {r["verdict"] for r in compare_runs(back, back).collect()}
    assert verdicts == {"equal"}
    dijkstra, _ = run(spark, Parameters(p.graph, p.queries, "", algorithm="dijkstra"))
    assert compare_runs(back, dijkstra).where("verdict <> 'equal'").isEmpty()
    counted, totals = run(spark, Parameters(p.graph, p.queries, "", algorithm="astar-seeds", fixed_trie_depth=True, tree_depth=3, seeds_len=6, count_work=True))
    assert all(0 < r["popped"] <= r["pushed"] and r["explored_states"] == round(20 * r["popped"]) for r in counted.collect())
    # the graph drops its last letter; prefixes of one and two letters, the root, and a jump for every walk of three
    strands = [ref, ref[::-1].translate(str.maketrans("ACGT", "TGCA"))]
    prefixes = {g[i : i + m] for g in strands for m in (1, 2) for i in range(len(g) - m + 1)}
    assert {k: totals.first()[k] for k in ("trie_nodes", "trie_edges")} == {"trie_nodes": 1 + len(prefixes), "trie_edges": len(prefixes) + sum(len(g) - 2 for g in strands)}
    assert totals.first()["total_sec"] >= totals.first()["align_sec"] > 0


@pytest.mark.parametrize("bad", [{"algorithm": "bfs"}, {"k_best": 0}, {"threads": 0}, {"prefix_cost": -1}, {"tree_depth": 0}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        Parameters("g.gfa", "q.fq", "", **bad)


def test_seed_strategy_is_checked():
    from strandloom.plans.aligner import STRATEGIES

    with pytest.raises(ValueError):
        STRATEGIES["astar-seeds"].seed_length(Parameters("g", "q", "", "astar-seeds", seeds_len=3, fixed_trie_depth=True))
    with pytest.raises(ValueError):
        STRATEGIES["astar-seeds"].seed_length(Parameters("g", "q", "", "astar-seeds", seeds_len=9))


def test_summary(spark):
    rows = spark.createDataFrame([(0, 1, "unique", 2, "AcgT"), (1, 1, "ambiguous", 0, "ACGT"), (1, 2, "ambiguous", 0, "ACGT")], "read_id long, rank int, status string, cost int, spell string")
    s = alignment_summary(rows).first()
    assert (s["n_reads"], s["total_cost"], s["edits"], s["unique_percent"], s["ambiguous_percent"]) == (2, 2, 2, 50.0, 50.0)


def test_streamed_reads(spark, tmp_path):
    from strandloom.streaming.reads import align_stream

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(0, "GTTGC"), (1, "GGGTT")], "read_id long, seq string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("read_id long, seq string").json(str(tmp_path / "in"))
    segments = spark.createDataFrame([(1, "ACGTTGCA")], "seg_id long, seq string")
    q = align_stream(stream, segments, None, str(tmp_path / "out"), str(tmp_path / "cp"), drop_tail=False)
    q.processAllAvailable()
    q.stop()
    got = {r["read_id"]: r["cost"] for r in spark.read.parquet(str(tmp_path / "out")).where("rank = 1").collect()}
    assert got == {0: 0, 1: 2}
