"""The aligner as a program: parameters, strategies, the run, its report and files."""

from __future__ import annotations

import argparse
import logging
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import auto_depth
from strandloom.operators.align import Costs, align
from strandloom.operators.analysis import alignment_summary, read_statistics
from strandloom.operators.graph import character_graph, graph_size
from strandloom.operators.lineage import settled
from strandloom.operators.runs import TRIE, segment_runs, trie_crossings
from strandloom.sources.graph_files import read_reference
from strandloom.sources.reads import read_queries
from strandloom.sources.tables import write_statistics, write_table

log = logging.getLogger("strandloom")


class Strategy:
    """How candidates are found; every strategy gives the optimal cost. Subclasses may refuse parameters."""

    name = "dijkstra"
    #: What bounds the best-first search that counts the work.
    bound = "none"

    def seed_length(self, p: Parameters) -> int | None:
        return None


class Prefix(Strategy):
    """A bound on the next letters prunes only the work of a best-first search; the full kernel needs none."""

    name = "astar-prefix"
    bound = "prefix"


class Seeds(Strategy):
    name = "astar-seeds"
    bound = "seeds"

    def seed_length(self, p: Parameters) -> int | None:
        if p.seeds_len < 5:
            raise ValueError("seeds need a length of 5 or more")
        if not p.fixed_trie_depth:
            raise ValueError("seeds need a fixed index depth")
        if 0 < p.seeds_len < p.tree_depth:
            raise ValueError("seeds must not be shorter than the index is deep")
        return p.seeds_len


STRATEGIES = {s.name: s for s in (Strategy(), Prefix(), Seeds())}


@dataclass(frozen=True)
class Parameters:
    graph: str
    queries: str
    output: str
    algorithm: str = "astar-prefix"
    tree_depth: int = -1
    fixed_trie_depth: bool = False
    greedy_match: bool = True
    prefix_length: int = 5
    prefix_cost: int = 5
    equivalence_classes: bool = True
    seeds_len: int = -1
    skip_near_crumbs: bool = True
    costs: Costs = field(default_factory=Costs)
    k_best: int = 1
    threads: int = 1
    verbose: int = 0
    count_work: bool = False

    def __post_init__(self):
        if not self.graph or not self.queries:
            raise ValueError("a graph and queries are required")
        if self.algorithm not in STRATEGIES:
            raise ValueError(f"unknown algorithm {self.algorithm}")
        if self.k_best < 1 or self.threads < 1 or self.verbose < 0:
            raise ValueError("k and threads must be at least 1, verbosity at least 0")
        if self.prefix_length < 0 or self.prefix_cost < 0:
            raise ValueError("prefix length and cost must not be negative")
        if self.tree_depth == 0 or self.tree_depth < -1:
            raise ValueError("the index depth must be positive")


def parse(argv: list[str]) -> Parameters:
    """Parameters of a command line: align-optimal -g GRAPH -q READS -o OUT .."""
    a = argparse.ArgumentParser(prog="strandloom")
    a.add_argument("command", choices=["align-optimal"])
    a.add_argument("-g", dest="graph", required=True)
    a.add_argument("-q", dest="queries", required=True)
    a.add_argument("-o", dest="output", default="")
    a.add_argument("-a", dest="algorithm", default="astar-prefix")
    a.add_argument("-D", dest="tree_depth", type=int, default=-1)
    a.add_argument("--fixed_trie_depth", type=int, default=0)
    a.add_argument("-f", dest="greedy_match", type=int, default=1)
    a.add_argument("-d", dest="prefix_length", type=int, default=5)
    a.add_argument("-c", dest="prefix_cost", type=int, default=5)
    a.add_argument("-e", dest="equivalence_classes", type=int, default=1)
    a.add_argument("--seeds_len", type=int, default=-1)
    a.add_argument("--seeds_skip_near_crumbs", dest="skip_near_crumbs", type=int, default=1)
    a.add_argument("-M", dest="match", type=float, default=0)
    a.add_argument("-S", dest="subst", type=float, default=1)
    a.add_argument("-G", dest="gap", type=float, default=5)
    a.add_argument("-k", dest="k_best", type=int, default=1)
    a.add_argument("-t", dest="threads", type=int, default=1)
    a.add_argument("-v", dest="verbose", type=int, default=0)
    a.add_argument("--count_work", type=int, default=0)
    v = vars(a.parse_args(argv))
    v.pop("command")
    costs = Costs(int(v.pop("match")), int(v.pop("subst")), int(v["gap"]), int(v.pop("gap")))
    for name in ("fixed_trie_depth", "greedy_match", "equivalence_classes", "skip_near_crumbs", "count_work"):
        v[name] = bool(v[name])
    return Parameters(costs=costs, **v)


def searched(segments: DataFrame, links: DataFrame, reads: DataFrame, p: Parameters, depth: int, drop_tail: bool) -> DataFrame:
    """(read_id, pushed, popped): states of a best-first search under the strategy's bound. Its costs must be those of the alignments."""
    from strandloom.operators.search import search

    found = search(
        segments, links, reads, costs=p.costs, bound=STRATEGIES[p.algorithm].bound, depth=max(2, depth), seed_len=max(1, p.seeds_len), prefix_length=p.prefix_length,
        prefix_cap=p.prefix_cost, greedy=p.greedy_match, drop_tail=drop_tail,
    )
    return settled(found.select("read_id", F.col("cost").alias("searched_cost"), "pushed", "popped"))


def run(spark: SparkSession, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """(alignments, statistics): the alignment rows, and one row of totals.

    With count_work the reads are searched once more, best first, under the
    bound of the strategy; -D, -d, -c and -f set that search. Without it the
    counters of work are 0.
    """
    began = time.time()
    if p.verbose:
        logging.basicConfig(level=logging.INFO)
    segments, links, drop_tail = read_reference(spark, p.graph)
    reads = settled(read_queries(spark, p.queries))
    edges = character_graph(segments, links, drop_tail)
    size = graph_size(edges).first()
    depth = p.tree_depth if p.tree_depth > 0 else auto_depth(2 * size["n_nodes"])
    log.info("graph of %d nodes and %d edges, index depth %d", size["n_nodes"], size["n_edges"], depth)
    seed_len = STRATEGIES[p.algorithm].seed_length(p)
    loaded = time.time()
    found = settled(align(segments, links, reads, costs=p.costs, k=p.k_best, seed_len=seed_len, drop_tail=drop_tail))
    aligned = time.time()
    work = {}
    if p.count_work:
        counts = searched(segments, links, reads.select("read_id", "seq"), p, depth, drop_tail)
        runs, crossings = segment_runs(segments, links, drop_tail)
        down = trie_crossings(settled(runs), settled(crossings), max(2, depth))
        trie = down.agg(F.count_distinct(F.when(F.col("to_run") >= TRIE, F.col("to_run"))).alias("nodes"), F.count("*").alias("edges")).first()
        work = {"trie_nodes": trie["nodes"] + 1, "trie_edges": trie["edges"]}  # the root counts
    else:
        counts = reads.select("read_id", F.lit(None).cast("int").alias("searched_cost"), F.lit(0).cast("long").alias("pushed"), F.lit(0).cast("long").alias("popped"))
    named = found.join(counts, "read_id").join(reads.select("read_id", "name", F.col("seq").alias("read")), "read_id")
    zero = lambda name, kind="double": F.lit(0).cast(kind).alias(name)  # noqa: E731  work counters of a best-first search
    rows = named.select(
        F.lit(p.graph).alias("ref"), F.lit(2 * size["n_nodes"]).alias("refsize"), F.lit(p.algorithm).alias("algo"), F.lit("align").alias("operation"), F.col("name").alias("readname"), zero("memory"),
        F.length("read").alias("len"), "read", "spell", "cost", "start", "strand", (F.col("pushed") / F.length("read")).alias("pushed"), (F.col("popped") / F.length("read")).alias("popped"), zero("repeat_rate"), zero("t(map)"), zero("t(astar)"),
        (F.col("status") == "unique").cast("int").alias("unique_best"), F.col("popped").cast("int").alias("explored_states"), zero("crumbs", "int"),
    )
    totals = alignment_summary(found).crossJoin(read_statistics(reads, 2 * size["n_edges"]).drop("n_reads"))
    settings = {"algorithm": p.algorithm, "AStarLengthCap": p.prefix_length, "AStarCostCap": p.prefix_cost, "AStarNodeEqivClasses": int(p.equivalence_classes), "greedy_math": int(p.greedy_match), "graph_file": p.graph, "query_file": p.queries, "threads": p.threads, "tree_depth": depth, "orig_graph_nodes": size["n_nodes"], "orig_graph_edges": size["n_edges"], "total_nodes": 2 * size["n_nodes"], "total_edges": 2 * size["n_edges"], **{f"cost_{k.replace('dele', 'del')}": v for k, v in asdict(p.costs).items()}}
    settings |= work | {"load_sec": loaded - began, "align_sec": aligned - loaded, "total_sec": time.time() - began}
    return rows, totals.select("*", *[F.lit(v).alias(k) for k, v in settings.items()])


def report(statistics: DataFrame) -> str:
    """The totals as text, a line each."""
    row = statistics.first().asDict()
    return "\n".join(f"{k:>24}: {v}" for k, v in sorted(row.items()))


def main(argv: list[str]) -> int:
    p = parse(argv)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    rows, statistics = run(spark, p)
    if p.output:
        write_table(rows, f"{p.output}/alignments.tsv")
        write_statistics(statistics, f"{p.output}/stats.log")
    print(report(statistics))
    return 0
