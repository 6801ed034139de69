"""Indexes of a graph: walks, k-mers, tries of walk prefixes, classes of linear nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import node_id, reverse_complement


#: Letters of a stretch in which words are cut, so that no cut walks a long string.
STRETCH = 64


def stretches(seq: str, overlap: int) -> Column:
    """Array of (at, run): the sequence in runs of STRETCH letters that go on for `overlap` more."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(STRETCH))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.substring(F.col(seq), i + 1, F.lit(STRETCH + overlap)).alias("run")))


def words(sequences: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """(keep.., pos, word): every k-letter run of sequences (seq, ..)."""
    runs = sequences.where(F.length("seq") >= k).select(*keep, F.explode(stretches("seq", k - 1)).alias("s")).where(F.length("s.run") >= k)
    at = F.explode(F.sequence(F.lit(0), F.least(F.length("s.run") - k, F.lit(STRETCH - 1)))).alias("i")
    return runs.select(*keep, "s.at", "s.run", at).select(*keep, (F.col("at") + F.col("i")).alias("pos"), F.substring("run", F.col("i") + 1, F.lit(k)).alias("word"))


def kmers(sequences: DataFrame, k: int) -> DataFrame:
    """(seg_id, pos, strand, kmer): every k-letter run of linear sequences (seg_id, seq), on both strands; pos is that of its first letter on the forward strand."""
    forward = words(sequences, k, ["seg_id"]).withColumnRenamed("word", "fwd")
    both = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("fwd").alias("kmer")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("fwd")).alias("kmer")))).alias("s")
    return forward.select("seg_id", "pos", both).select("seg_id", "pos", "s.strand", "s.kmer")


def walks(edges: DataFrame, depth: int, only: DataFrame | None = None) -> DataFrame:
    """(start, node, walk): all walks of exactly `depth` edges, spelled; with `only` (prefix) just those whose every prefix is one of its.

    `only` keeps branching graphs from exploding: pass the prefixes of the
    wanted words, of every length up to depth.
    """
    step = edges.select("src", "dst", "label")
    out = step.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.col("label").alias("walk"))
    for d in range(1, depth + 1):
        if only is not None:
            out = out.join(only.select(F.col("prefix").alias("walk")).where(F.length("walk") == d).distinct(), "walk", "left_semi")
        if d == depth:
            break
        out = out.join(step, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.concat("walk", "label").alias("walk"))
    return out.select("start", "node", "walk")


def trie(edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, jumps) of the trie over all walks: nodes are the distinct walk prefixes of 1 to depth - 1 letters (prefix, depth, n_walks), jumps lead from a prefix of depth - 1 letters back into the graph, one per walk (prefix, label, node)."""
    levels, jumps = None, None
    for d in range(1, depth):
        w = walks(edges, d).groupBy(F.col("walk").alias("prefix")).agg(F.count("*").alias("n_walks")).withColumn("depth", F.lit(d))
        levels = w if levels is None else levels.unionByName(w)
    full = walks(edges, depth)
    jumps = full.select(F.substring("walk", F.lit(1), F.lit(depth - 1)).alias("prefix"), F.expr("right(walk, 1)").alias("label"), "node")
    return levels, jumps


def trie_of_sequences(sequences: DataFrame, depth: int) -> DataFrame:
    """(prefix, depth, n_walks) as trie, for linear sequences without joins: each position gives its prefixes, cut where the sequence ends."""
    n = F.length("seq")
    strands = sequences.select(F.explode(F.array("seq", reverse_complement(F.col("seq")))).alias("seq")).where(n > 0)
    runs = strands.select(F.explode(stretches("seq", depth - 2)).alias("s")).select("s.run", F.explode(F.sequence(F.lit(1), F.least(F.length("s.run"), F.lit(STRETCH)))).alias("i"))
    starts = runs.select(F.substring("run", F.col("i"), F.lit(depth - 1)).alias("run"))
    runs = starts.groupBy("run").agg(F.count("*").alias("m"))
    prefixes = runs.select("m", F.explode(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.substring("run", F.lit(1), i))).alias("prefix"))
    return prefixes.groupBy("prefix").agg(F.sum("m").alias("n_walks")).withColumn("depth", F.length("prefix"))


def jumps_of_sequences(sequences: DataFrame, depth: int) -> DataFrame:
    """(prefix, label, node): the jumps of trie, for linear sequences (seg_id, seq) without joins."""
    inner = sequences.select("seg_id", F.expr("left(seq, length(seq) - 1)").alias("seq"))
    full = words(inner, depth, ["seg_id"])
    return full.select(F.substring("word", 1, depth - 1).alias("prefix"), F.substring("word", depth, 1).alias("label"), node_id(F.col("seg_id"), F.col("pos") + depth).alias("node"))


def shallow_trie(levels: DataFrame) -> DataFrame:
    """The trie that stops at the first prefix with a single walk: its nodes are those whose parent still has several."""
    parents = levels.where("n_walks > 1").select(F.col("prefix").alias("parent"))
    deep = levels.withColumn("parent", F.expr("left(prefix, length(prefix) - 1)"))
    return deep.where("depth = 1").drop("parent").unionByName(deep.join(parents, "parent", "left_semi").drop("parent"))


def linear_prefixes(edges: DataFrame, length: int) -> DataFrame:
    """(node, prefix, boundary): nodes whose next `length` edges are the only ones, their letters and the node behind them."""
    only = edges.where("etype = 'ORIG'").groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("dst"), F.first("label").alias("label")).where("n = 1").drop("n")
    out = only.select(F.col("src").alias("node"), F.col("label").alias("prefix"), F.col("dst").alias("boundary"))
    for _ in range(length - 1):
        out = out.join(only, F.col("boundary") == F.col("src")).select("node", F.concat("prefix", "label").alias("prefix"), F.col("dst").alias("boundary"))
    return out


def classes_of_sequences(sequences: DataFrame, length: int) -> DataFrame:
    """(prefix, representative, n_nodes) of node_classes with a boundary, for linear sequences (seg_id, seq) without joins: each node's next letters are a word."""
    inner = sequences.select("seg_id", F.expr("left(seq, length(seq) - 1)").alias("seq"))
    per = words(inner, length, ["seg_id"]).groupBy(F.col("word").alias("prefix"))
    return per.agg(F.min(node_id(F.col("seg_id"), F.col("pos"))).alias("representative"), F.count("*").alias("n_nodes"))


def node_classes(edges: DataFrame, length: int) -> DataFrame:
    """(node, representative, boundary): linear nodes with the same next letters share the smallest of them, every other node stands for itself."""
    from strandloom.operators.graph import nodes

    linear = linear_prefixes(edges, length)
    lead = linear.groupBy("prefix").agg(F.min_by(F.struct("node", "boundary"), "node").alias("r"))
    shared = linear.join(lead, "prefix").select("node", F.col("r.node").alias("representative"), F.col("r.boundary").alias("boundary"))
    alone = nodes(edges).join(linear.select("node"), "node", "left_anti")
    return shared.unionByName(alone.select("node", F.col("node").alias("representative"), F.lit(None).cast("long").alias("boundary")))
