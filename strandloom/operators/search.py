"""Best-first alignment of reads to a graph as a relation of states.

States (read_id, run, pos, left, g) stand at a position of a run with so many
letters of a read left. All reads advance together, bucket by bucket of f = g + bound: the
states of the least f are settled and their successors joined in; a state is
kept by its least g and settled again if a later way is cheaper, so any bound
that never exceeds the true cost gives the optimum. A read retires with its
first settled state behind its last letter. Between branches states slide along
equal letters at once.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import mirror, node_id
from strandloom.operators.align import Costs, exact_ends, pieces
from strandloom.operators.lineage import settled
from strandloom.operators.prefixes import prefix_bound
from strandloom.operators.runs import TRIE, run_crumbs, run_node, runs_ahead, seed_walks, segment_runs, trie_crossings, walks_into
from strandloom.operators.seeds import max_indels, seeds

KEY = ["read_id", "run", "pos", "left"]
STATE = "read_id long, run long, pos int, left int, g int, h int"


def common_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def slider(costs: Costs, greedy: bool, ahead: int, cap: int):
    """A function that moves states along equal letters of their run and read, and bounds what follows by the next `ahead` letters."""
    memo: dict = {}
    room = ahead + (cap - 1) // costs.dele if costs.dele else ahead

    def slide(pos: int, left: int, g: int, label: str, seq: str) -> tuple[int, int, int, int]:
        if greedy and pos < len(label) and left:
            m = common_prefix(label[pos : pos + left], seq[-left:])
            pos, left, g = pos + m, left - m, g + m * costs.match
        rest = left * costs.match
        if ahead and left and costs.dele and pos + room <= len(label):
            near = seq[-left:][:ahead]
            key = (label[pos : pos + room], near)
            if key not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[key] = prefix_bound(*key, costs.all(), cap)
            rest = max(rest, memo[key] + (left - len(near)) * costs.match)
        return pos, left, g, rest

    return slide


def search(segments: DataFrame, links: DataFrame, reads: DataFrame, *, costs: Costs = Costs(), bound: str = "none", depth: int = 6, seed_len: int = 25, prefix_length: int = 5, prefix_cap: int = 5, greedy: bool = True, drop_tail: bool = True, max_cost: int = 1 << 20, exact_first: bool = False) -> DataFrame:
    """(read_id, status, cost, end_node, pushed, popped) of reads (read_id, seq): the least cost over all walks of both strands.

    bound names the strategy: `none` (Dijkstra), `prefix` (the next
    prefix_length letters against the run ahead, at most prefix_cap), `seeds`
    (disjoint seeds of seed_len letters, each of which costs an error unless a
    match of it lies ahead). Costs are the same under all. The search starts at
    the root of a trie of `depth` letters. pushed counts states that joined the
    relation, popped those settled, repeats included. end_node is the smallest
    of the ends met, the trie's numbers above all others. Reads whose cost
    exceeds max_cost are `overcost` and searched no further; an empty read is
    `none`. Segments hold ACGT alone. With exact_first reads that stand in a
    run letter by letter are not searched and count no states.
    """
    if bound not in ("none", "prefix", "seeds"):
        raise ValueError(f"unknown bound {bound}")
    if bound == "seeds" and costs.delta <= 0:
        raise ValueError("seeds bound nothing where an error costs no more than a match")
    asked = settled(reads.select("read_id", F.upper("seq").alias("seq")).where("seq <> ''"))
    runs, crossings = segment_runs(segments.select("seg_id", F.upper("seq").alias("seq")), links, drop_tail)
    runs, crossings = settled(runs), settled(crossings)
    crumbs = only = exact = None
    if exact_first and costs.delta > 0 and costs.gap > 0:
        asked, exact = _without_exact(runs, asked, costs)
    if bound == "seeds":
        n_seeds = F.floor(F.length("seq") / F.lit(float(seed_len))).cast("int")
        matches = settled(seed_walks(runs, crossings, seeds(asked, seed_len), seed_len))
        far = matches.join(asked.select("read_id", max_indels(F.length("seq"), n_seeds, *costs.all()).alias("indels")), "read_id")
        # what costs no more than all seeds and letters leaves out no more than `indels` edges on its way to a seed
        crumbs = settled(run_crumbs(runs, crossings, far, F.col("start") + F.least("indels", F.lit(1 << 20))))
        # a read that has left the trie with more whole seeds before it than it may pay for goes on at its crumbs alone
        before = depth + max_cost // max(1, costs.ins - costs.match)
        if asked.where(F.floor((F.length("seq") - before) / F.lit(float(seed_len))) * costs.delta <= max_cost).isEmpty():
            only = crumbs.select("run", "pos").distinct()
        crumbs = settled(crumbs.unionByName(walks_into(runs, crossings, crumbs, depth)).withColumnRenamed("seed", "s"))
    down = trie_crossings(runs, crossings, depth, only)
    if only is not None and costs.dele:
        # the rounds meet only the runs to which a walk from a crumb can come, tail letters included
        longest = asked.agg(F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("n")).first()["n"]
        near = settled(runs_ahead(runs, crossings, only, longest + max_cost // costs.dele + 1))
        runs, crossings = settled(runs.join(near, "run", "left_semi")), crossings.join(near, "run", "left_semi")
    crossings = settled(crossings.unionByName(down))

    def bounded(states: DataFrame) -> DataFrame:
        """States with f: under seeds each whole seed left without a crumb at the node adds an error; one under way does not count."""
        if crumbs is None:
            return states.select(*KEY, "g", (F.col("g") + F.col("h")).alias("f"))
        ahead = F.floor(F.col("left") / F.lit(float(seed_len))).cast("int")
        met = states.withColumn("ahead", ahead).join(crumbs, ["read_id", "run", "pos"], "left")
        per = met.groupBy(*KEY, "g", "h", "ahead").agg(F.count_distinct(F.when(F.col("s") < F.col("ahead"), F.col("s"))).alias("held"))
        return per.select(*KEY, "g", (F.col("g") + F.col("h") + (F.col("ahead") - F.col("held")) * costs.delta).cast("int").alias("f"))

    states, found = _buckets(runs, crossings, asked, bounded, costs, prefix_length if bound == "prefix" else 0, prefix_cap, greedy, max_cost)
    work = states.groupBy("read_id").agg(F.sum("pushed").alias("pushed"), F.sum("popped").alias("popped"))
    ends = found.join(runs.select("run", F.length("label").alias("n")), "run", "left")
    node = run_node(F.col("run"), F.col("pos"), F.coalesce("n", F.lit(0)))
    ends = ends.select("read_id", "g", node.alias("node"))
    ends = ends if exact is None else ends.unionByName(exact)
    least = ends.groupBy("read_id").agg(F.min(F.struct("g", "node")).alias("e"))
    out = reads.select("read_id", F.expr("seq <> ''").alias("asked")).join(least, "read_id", "left").join(work, "read_id", "left")
    status = F.when(~F.coalesce("asked", F.lit(False)), "none").when(F.col("e").isNull(), "overcost").otherwise("found")
    return out.select("read_id", status.alias("status"), F.col("e.g").alias("cost"), F.col("e.node").alias("end_node"), F.coalesce("pushed", F.lit(0)).alias("pushed"), F.coalesce("popped", F.lit(0)).alias("popped"))


def _without_exact(runs: DataFrame, asked: DataFrame, costs: Costs) -> tuple[DataFrame, DataFrame]:
    """(reads left, ends (read_id, g, node)): reads that stand in a run letter by letter, which no walk makes cheaper where every error costs."""
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("longest")).first()
    cut = settled(pieces(runs.where("run >= 0 AND label <> ''").select(F.col("run").alias("seg_id"), F.col("label").alias("seq")), size["longest"]))
    met = exact_ends(cut, asked, costs, size["n"])
    node = node_id(F.col("seg_id"), F.col("end_at"))
    node = F.when(F.col("strand") == "+", node).otherwise(mirror(node))
    exact = settled(met.select("read_id", F.col("cost").alias("g"), node.alias("node")))
    return settled(asked.join(exact.select("read_id").distinct(), "read_id", "left_anti")), exact


def _buckets(runs: DataFrame, crossings: DataFrame, asked: DataFrame, bounded, costs: Costs, ahead: int, cap: int, greedy: bool, max_cost: int) -> tuple[DataFrame, DataFrame]:
    """(states, ends): all states with their counts, and those at which reads retired."""

    def arrive(batches):
        """States that came to a run over a crossing, moved on as far as letters agree."""
        slide = slider(costs, greedy, ahead, cap)
        for pdf in batches:
            out = [(rid, run, *slide(pos, left, g, label, seq)) for rid, run, pos, left, g, label, seq in zip(*(pdf[c] for c in (*KEY, "g", "label", "seq")), strict=True)]
            yield pd.DataFrame(out, columns=[*KEY, "g", "h"])

    def leave(batches):
        """Successors of states within their run, moved on likewise; at its tail the letter that goes in there."""
        slide = slider(costs, greedy, ahead, cap)
        for pdf in batches:
            out = []
            for rid, run, pos, left, g, label, seq in zip(*(pdf[c] for c in (*KEY, "g", "label", "seq")), strict=True):
                steps = [(pos, left - 1, g + costs.ins)]
                if pos < len(label):
                    step = costs.match if label[pos] == seq[-left] else costs.subst
                    steps += [(pos + 1, left - 1, g + step), (pos + 1, left, g + costs.dele)]
                out += [(rid, run, *slide(*s, label, seq)) for s in steps]
            yield pd.DataFrame(out, columns=[*KEY, "g", "h"])

    labels = runs.select("run", "label")

    def placed(states: DataFrame) -> DataFrame:
        """With the run's letters, none at trie nodes, and the read's."""
        return states.join(asked, "read_id").join(labels, "run", "left").withColumn("label", F.coalesce("label", F.lit("")))

    def opened(states: DataFrame) -> DataFrame:
        return states.withColumn("pushed", F.lit(1).cast("long")).withColumn("popped", F.lit(0).cast("long")).withColumn("open", F.lit(True))

    n = F.length("seq")
    root = asked.select("read_id", F.lit(TRIE).alias("run"), F.lit(0).alias("pos"), n.alias("left"), F.lit(0).alias("g"), (n * costs.match).alias("h"))
    states = settled(opened(bounded(root)))
    ends = states.select("read_id", "run", "pos", "g").where("false")
    while True:
        low = states.where("open").agg(F.min(F.struct("f", "left")).alias("s")).first()["s"]
        if low is None or low["f"] > max_cost:
            return states, ends
        hit = F.col("open") & (F.col("f") == low["f"])
        if low["left"] == 0:
            # reads that are through retire: their states keep their counts and open no more
            through = settled(states.where(hit & (F.col("left") == 0)).select("read_id", "run", "pos", "g"))
            ends = ends.unionByName(through)
            done = through.select("read_id").distinct().withColumn("done", F.lit(True))
            ended = hit & (F.col("left") == 0)
            states = states.withColumn("popped", F.col("popped") + ended.cast("long")).join(done, "read_id", "left")
            states = settled(states.withColumn("open", F.col("open") & F.col("done").isNull()).drop("done"))
            continue
        going = placed(states.where(hit).select(*KEY, "g"))
        inside = going.mapInPandas(leave, STATE)
        tails = going.where(F.col("pos") == F.length("label")).join(crossings, "run")
        price = F.when(F.col("letter") == F.expr("left(right(seq, left), 1)"), costs.match).otherwise(costs.subst)
        moves = F.array(F.struct((F.col("left") - 1).alias("left"), (F.col("g") + price).alias("g")), F.struct(F.col("left").alias("left"), (F.col("g") + costs.dele).alias("g")))
        moved = tails.select("read_id", F.col("to_run").alias("run"), F.col("to_pos").alias("pos"), F.explode(moves).alias("m"))
        moved = moved.groupBy("read_id", "run", "pos", F.col("m.left").alias("left")).agg(F.min("m.g").alias("g"))
        over = placed(moved).select(*KEY, "g", "label", "seq").mapInPandas(arrive, STATE)
        new = inside.unionByName(over).groupBy(*KEY).agg(F.min("g").alias("g"), F.min_by("h", "g").alias("h"))
        new = opened(bounded(new).where(F.col("f") <= max_cost))
        # the least g of a state wins; what is settled opens again only for a cheaper way
        old = states.withColumn("popped", F.col("popped") + hit.cast("long")).withColumn("open", F.col("open") & ~hit)
        best = F.struct("g", F.col("open").cast("int").alias("late"))
        every = old.unionByName(new).groupBy(*KEY).agg(F.min("g").alias("g"), F.min_by("f", best).alias("f"), F.sum("pushed").alias("pushed"), F.sum("popped").alias("popped"), F.min_by("open", best).alias("open"))
        states = settled(every)
