"""The seed heuristic as relations: seeds, matches, crumbs, and the bound they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import error_step, reverse_complement


def seeds(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, seed, start, kmer): disjoint chunks of a read (read_id, seq) from its end, seed 0 the last; what is left at the front is in none."""
    if k < 1:
        raise ValueError("seeds need a length")
    n = F.length("seq")
    cut = reads.where(n >= k).select("read_id", "seq", F.explode(F.sequence(F.lit(0), F.expr(f"length(seq) div {k}").cast("int") - 1)).alias("seed"))
    start = F.length("seq") - (F.col("seed") + 1) * k
    return cut.select("read_id", "seed", start.alias("start"), F.substring("seq", start + 1, F.lit(k)).alias("kmer"))


def seed_matches(cut: DataFrame, index: DataFrame) -> DataFrame:
    """Seeds joined with k-mers on the word. Repeated words make hot keys; adaptive execution splits them, and every match is kept."""
    return cut.join(index, "kmer").select("read_id", "seed", "start", "kmer", "seg_id", "pos", "strand")


def matches_on_both_strands(cut: DataFrame, forward: DataFrame) -> DataFrame:
    """As seed_matches with an index of both strands, from one of the forward strand (seg_id, pos, kmer): the seeds, which are few, are reverse-complemented instead."""
    either = F.array(F.struct(F.lit("+").alias("strand"), F.col("kmer").alias("word")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("kmer")).alias("word")))
    asked = cut.select("read_id", "seed", "start", "kmer", F.explode(either).alias("s")).select("read_id", "seed", "start", "kmer", "s.strand", "s.word")
    return asked.join(forward.select("seg_id", "pos", F.col("kmer").alias("word")), "word").select("read_id", "seed", "start", "kmer", "seg_id", "pos", "strand")


def max_indels(length: Column, n_seeds: Column, match: int, subst: int, ins: int, dele: int) -> Column:
    """How far matches can drift: (len * match + seeds * delta) div del; unbounded where deletions cost nothing."""
    if dele == 0:
        return F.lit((1 << 31) - 1)
    spent = length * match + n_seeds * error_step(match, subst, ins, dele)
    return F.floor(spent / F.lit(float(dele))).cast("int")


def linear_crumbs(matches: DataFrame, indels: Column) -> DataFrame:
    """(read_id, seed, strand, seg_id, node): nodes before a match from which it can be reached, on a linear sequence.

    On the strand of the match, the node before the seed's first letter gets a
    crumb, and those d letters earlier while start - 1 - d > -indels; indels is
    an expression over matches. pos is the match's first letter on its strand.
    """
    reach = F.least(F.col("pos"), F.greatest(F.lit(0), F.col("start") - 2 + indels))
    return matches.select("read_id", "seed", "strand", "seg_id", F.explode(F.sequence(F.col("pos") - reach, F.col("pos"))).alias("node"))


def disjoint_spans(spans: DataFrame, within: list[str]) -> DataFrame:
    """Spans (within.., lo, hi) cut so that those of a group cover each place once: what an earlier one, by its beginning, covers is taken off."""
    earlier = Window.partitionBy(*within).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("lo", F.greatest("lo", F.max("hi").over(earlier) + 1)).where("lo <= hi")


def counted_crumbs(matches: DataFrame, indels: Column) -> DataFrame:
    """(read_id, strand, seg_id, node, n_crumbs, seeds): how many different seeds have a crumb of linear_crumbs at a node, and the sum of their numbers.

    The matches of a read in a segment, a row each, are shuffled to one place;
    where their spans begin and end the counts change, so nodes are written out
    last and are neither shuffled nor sorted.
    """
    group = ["read_id", "strand", "seg_id"]
    reach = F.least(F.col("pos"), F.greatest(F.lit(0), F.col("start") - 2 + indels))
    spans = matches.select(*group, "seed", (F.col("pos") - reach).alias("lo"), F.col("pos").alias("hi")).repartition(*group)
    change = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("n"), F.col("seed").alias("s")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("n"), (-F.col("seed")).alias("s")))
    per = disjoint_spans(spans, [*group, "seed"]).select(*group, F.explode(change).alias("c")).groupBy(*group, F.col("c.at").alias("at")).agg(F.sum("c.n").alias("n"), F.sum("c.s").alias("s"))
    along = Window.partitionBy(*group).orderBy("at")
    held = per.select(*group, "at", (F.lead("at").over(along) - 1).alias("upto"), F.sum("n").over(along).alias("n_crumbs"), F.sum("s").over(along).alias("seeds"))
    return held.where("n_crumbs > 0").select(*group, F.explode(F.sequence("at", "upto")).alias("node"), "n_crumbs", "seeds")


def graph_crumbs(edges: DataFrame, matches: DataFrame, indels: int) -> DataFrame:
    """(read_id, seed, node) for matches (read_id, seed, start, node) on any graph: nodes d edges before the match, d = 0 or start - 1 - d > -indels.

    A breadth-first walk over reversed edges, a join a round; each (match,
    node) is met once, by its shortest way, so cycles end.
    """
    from strandloom.operators.lineage import settled

    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("before"))
    front = settled(matches.select("read_id", "seed", F.col("node").alias("goal"), "node", (F.col("start") - 1).alias("at")).distinct())
    met = front
    while not front.isEmpty():
        ahead = front.join(back, "node").select("read_id", "seed", "goal", F.col("before").alias("node"), (F.col("at") - 1).alias("at")).where(F.col("at") > -indels)
        ahead = ahead.groupBy("read_id", "seed", "goal", "node").agg(F.max("at").alias("at"))
        front = settled(ahead.join(met, ["read_id", "seed", "goal", "node"], "left_anti").select(*met.columns))
        met = settled(met.unionByName(front))
    return met.select("read_id", "seed", "node")


def seeds_to_end(length: Column, i: Column, k: int, n_seeds: Column) -> Column:
    """Whole seeds in the read behind position i; the quotient of -1 is 0, as integers divide toward zero."""
    left = length - i - 1
    whole = F.when(left < 0, 0).otherwise(F.floor(left / F.lit(float(k)))).cast("int")
    return F.least(whole, n_seeds)


def seed_bound(length: Column, i: Column, k: int, n_seeds: Column, crumbs: Column, match: int, delta: int) -> Column:
    """Lower bound of the cost from (i, v): crumbs is the number of different seeds below seeds_to_end with a crumb at v."""
    return (length - i) * match + (seeds_to_end(length, i, k, n_seeds) - crumbs) * delta


def root_bounds(reads: DataFrame, matches: DataFrame, k: int, match: int = 0, subst: int = 1, ins: int = 5, dele: int = 5) -> DataFrame:
    """(read_id, n_seeds, n_matches, found, bound) at the start of each read: every seed with a match is found there."""
    delta = error_step(match, subst, ins, dele)
    n = F.expr(f"length(seq) div {k}").cast("int")
    per = matches.groupBy("read_id").agg(F.count("*").alias("n_matches"), F.collect_set("seed").alias("s"))
    joined = reads.select("read_id", F.length("seq").alias("len"), n.alias("n_seeds")).join(per, "read_id", "left")
    ahead = seeds_to_end(F.col("len"), F.lit(0), k, F.col("n_seeds"))
    found = F.size(F.filter(F.coalesce("s", F.array().cast("array<int>")), lambda x: x < ahead))
    bound = seed_bound(F.col("len"), F.lit(0), k, F.col("n_seeds"), found, match, delta)
    return joined.select("read_id", "n_seeds", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), found.alias("found"), bound.cast("int").alias("bound"))


def trie_crumbs(crumbs: DataFrame, walks_to: DataFrame) -> DataFrame:
    """(read_id, seed, prefix): crumbs (read_id, seed, node) carried up the index, from each node to every prefix of the walks (prefix, node) that lead to it."""
    up = walks_to.select("node", F.explode(F.sequence(F.lit(0), F.length("prefix"))).alias("n"), "prefix").select("node", F.expr("left(prefix, n)").alias("prefix")).distinct()
    return crumbs.join(up, "node").select("read_id", "seed", "prefix").distinct()


def crumbs_at(crumbs: DataFrame, states: DataFrame) -> DataFrame:
    """(.., n_crumbs) for states (read_id, node, below, ..): the number of different seeds under `below` with a crumb at the state's node."""
    kept = states.columns
    near = states.join(crumbs.distinct(), ["read_id", "node"], "left").groupBy(*kept)
    return near.agg(F.count_if(F.col("seed") < F.col("below")).alias("n_crumbs"))


def sorted_crumbs(crumbs: DataFrame) -> DataFrame:
    """Crumbs once each, by read, node and seed."""
    return crumbs.distinct().orderBy("read_id", "node", "seed")
