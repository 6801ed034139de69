"""A graph as runs without branches and the edges between them, its trie, and seeds matched along its walks.

A run is a string of edges: position p is the node before letter p, the last
position its tail. Forward segments are runs of their own number, their reverse
complements of the bitwise complement, trie nodes runs of no letters from TRIE
on. Only tails branch: crossings (run, letter, to_run, to_pos) leave them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import complement, mirror, node_id, prefix_number, reverse_complement
from strandloom.operators.index import words
from strandloom.operators.lineage import settled
from strandloom.operators.seeds import disjoint_spans

#: The run of the trie's root; other prefixes follow by their number.
TRIE = 1 << 62


def segment_runs(segments: DataFrame, links: DataFrame, drop_tail: bool = True) -> tuple[DataFrame, DataFrame]:
    """(runs (run, label), crossings) of both strands of a segment graph of plain bases; drop_tail as in character_graph."""
    seg = segments.where("seq <> ''").select("seg_id", "seq")
    known = links.where("from_fwd").select("from_id", "to_id").join(seg.select(F.col("seg_id").alias("to_id")), "to_id", "left_semi")
    whole, label = seg.dropDuplicates(["seg_id"]), F.expr("left(seq, length(seq) - 1)")
    if not drop_tail:
        linked = links.where("from_fwd").select(F.col("from_id").alias("seg_id")).distinct().withColumn("linked", F.lit(True))
        whole, label = whole.join(linked, "seg_id", "left"), F.when(F.col("linked"), label).otherwise(F.col("seq"))
    forward = whole.select(F.col("seg_id").alias("run"), label.alias("label"))
    runs = forward.unionByName(forward.select(mirror(F.col("run")).alias("run"), reverse_complement(F.col("label")).alias("label")))
    met = known.join(seg.select(F.col("seg_id").alias("from_id"), F.expr("right(seq, 1)").alias("letter")), "from_id")
    zero = F.lit(0).cast("int").alias("to_pos")
    over = met.select(F.col("from_id").alias("run"), "letter", F.col("to_id").alias("to_run"), zero)
    back = met.select(mirror(F.col("to_id")).alias("run"), complement(F.col("letter")).alias("letter"), mirror(F.col("from_id")).alias("to_run"), zero)
    return runs, over.unionByName(back)


def run_node(run: Column, pos: Column, length: Column) -> Column:
    """The node id of a position in a run of so many letters; trie nodes keep their run's number."""
    return F.when(run >= TRIE, run).when(run >= 0, node_id(run, pos)).otherwise(mirror(node_id(mirror(run), length - pos)))


def run_words(runs: DataFrame, k: int) -> DataFrame:
    """(run, pos, word): every k-letter stretch inside a run."""
    return words(runs.select(F.col("run").alias("seg_id"), F.col("label").alias("seq")), k, ["seg_id"]).withColumnRenamed("seg_id", "run")


def bounded_walks(runs: DataFrame, crossings: DataFrame, depth: int, only: DataFrame | None = None) -> DataFrame:
    """(walk, run, pos) of the walks of `depth` edges from every node, where they end, and of shorter ones that end for want of edges. Distinct; with `only` (run, pos) those that end there."""
    n = F.length("label")
    inside = run_words(runs, depth).select(F.col("word").alias("walk"), "run", (F.col("pos") + depth).cast("int").alias("pos"))
    tails = runs.select("run", "label", n.alias("n")).select("run", "n", F.explode(F.sequence(F.lit(0), F.least(n, F.lit(depth - 1)))).alias("m"), "label")
    going = settled(tails.select(F.expr("right(label, m)").alias("walk"), "run", F.col("n").alias("pos")).distinct())
    out = inside
    while not going.isEmpty():
        met = going.join(crossings, "run", "left")
        out = out.unionByName(settled(met.where("to_run IS NULL AND walk <> ''").select("walk", "run", "pos")))
        met = met.where("to_run IS NOT NULL").select(F.concat("walk", "letter").alias("walk"), F.col("to_run").alias("run"), F.col("to_pos").alias("pos"))
        room = depth - F.length("walk")
        met = met.join(runs, "run").select("run", F.concat("walk", F.expr(f"substring(label, pos + 1, {depth} - length(walk))")).alias("walk"), F.least(n, F.col("pos") + room).cast("int").alias("pos"))
        met = settled(met.distinct())
        out = out.unionByName(met.where(F.length("walk") == depth))
        going = met.where(F.length("walk") < depth)
    return (out if only is None else out.join(only, ["run", "pos"], "left_semi").select("walk", "run", "pos")).distinct()


def runs_ahead(runs: DataFrame, crossings: DataFrame, begun: DataFrame, room: int) -> DataFrame:
    """(run): the runs `begun` (run) and those to which walks of `room` edges from any of their nodes come."""
    going = settled(begun.select("run").distinct().withColumn("left", F.lit(room)))
    out, lengths = going.select("run"), runs.select("run", F.length("label").alias("n"))
    while not going.isEmpty():
        over = going.join(crossings.select("run", "to_run"), "run").groupBy(F.col("to_run").alias("run")).agg((F.max("left") - 1).alias("left")).where("left > 0")
        over = settled(over.join(lengths, "run"))
        out = out.unionByName(over.select("run"))
        # an entered run is passed from its first node
        going = over.select("run", (F.col("left") - F.col("n")).alias("left")).where("left > 0")
    return out.distinct()


def trie_crossings(runs: DataFrame, crossings: DataFrame, depth: int, only: DataFrame | None = None) -> DataFrame:
    """Crossings of the trie over all walks, or those that end at the nodes `only` (run, pos): down to prefixes of depth - 1 letters, and from these into the graph."""
    if depth < 2:
        raise ValueError("a trie has a depth of 2 at least")
    walks = settled(bounded_walks(runs, crossings, depth, only))
    prefixes = walks.select("walk").distinct().select(F.explode(F.sequence(F.lit(1), F.least(F.length("walk"), F.lit(depth - 1)))).alias("m"), "walk")
    prefixes = prefixes.select(F.expr("left(walk, m)").alias("prefix")).distinct()
    at = lambda c: F.lit(TRIE) + prefix_number(c)
    down = prefixes.select(at(F.expr("left(prefix, length(prefix) - 1)")).alias("run"), F.expr("right(prefix, 1)").alias("letter"), at(F.col("prefix")).alias("to_run"), F.lit(0).alias("to_pos"))
    jumps = walks.where(F.length("walk") == depth).select(at(F.expr(f"left(walk, {depth - 1})")).alias("run"), F.expr("right(walk, 1)").alias("letter"), F.col("run").alias("to_run"), F.col("pos").alias("to_pos"))
    return down.unionByName(jumps)


def seed_walks(runs: DataFrame, crossings: DataFrame, cut: DataFrame, k: int) -> DataFrame:
    """(read_id, seed, start, run, pos) of seeds (read_id, seed, start, kmer) of k letters, for every walk that spells one, at the walk's first node.

    Inside runs seeds join words, and so they do across a crossing, where the
    letters of both its runs are enough. Where the next run is too short, only
    walks that a seed begins with go on over its crossings. A match inside
    a run is met once, and no walk over a crossing begins where it does, so only
    matches over crossings are made distinct.
    """
    found = run_words(runs, k).withColumnRenamed("word", "kmer")
    inside, over_crossings = cut.join(found, "kmer").select("read_id", "seed", "start", "run", F.col("pos").cast("int").alias("pos")), None
    if crossings.isEmpty():
        return inside
    # a row a crossing until its letters on both sides are cut into words; seeds join whole words only
    near = runs.join(crossings, "run").select("run", F.length("label").alias("n"), F.expr(f"right(label, {k - 1})").alias("before"), "letter", F.col("to_run").alias("at"), "to_pos")
    near = near.join(runs.select(F.col("run").alias("at"), "label"), "at").select("run", "n", "before", "letter", "at", F.expr(f"substring(label, to_pos + 1, {k - 1})").alias("here"))
    cuts = near.select("*", F.explode(F.sequence(F.lit(0), F.length("before"))).alias("m"))
    going = cuts.select("run", (F.col("n") - F.col("m")).cast("int").alias("pos"), F.concat(F.expr("right(before, m)"), "letter", F.expr(f"left(here, {k - 1} - m)")).alias("word"), "at")
    begun = settled(cut.select(F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("m"), "kmer").select(F.expr("left(kmer, m)").alias("word")).distinct()) if k > 1 else None
    over_crossings, whole = None, F.length("word") == k
    asked = cut.select("read_id", "seed", "start", F.col("kmer").alias("word"))
    while True:
        ended = going.where(whole).join(asked, "word").select("read_id", "seed", "start", "run", "pos")
        over_crossings = ended if over_crossings is None else over_crossings.unionByName(ended)
        # the rest end at a run's tail and go on where a seed begins like them
        short = settled(going.where(~whole).join(begun, "word", "left_semi")) if begun is not None else None
        if short is None or short.isEmpty():
            return inside.unionByName(over_crossings.distinct())
        over = short.join(crossings.select(F.col("run").alias("at"), "letter", "to_run", "to_pos"), "at")
        over = over.select("run", "pos", F.concat("word", "letter").alias("word"), F.col("to_run").alias("at"), F.col("to_pos").alias("p")).distinct()
        going = settled(over.join(runs.select(F.col("run").alias("at"), "label"), "at").select("run", "pos", F.concat("word", F.expr(f"substring(label, p + 1, {k} - length(word))")).alias("word"), "at"))


def run_crumbs(runs: DataFrame, crossings: DataFrame, matches: DataFrame, room: Column) -> DataFrame:
    """(read_id, seed, run, pos) for matches (read_id, seed, start, run, pos): the nodes from which a match lies at most `room` edges ahead, room an expression over matches."""
    return crumb_spans(runs, crossings, matches, room).select("read_id", "seed", "run", F.explode(F.sequence("lo", "hi")).alias("pos"))


def crumb_spans(runs: DataFrame, crossings: DataFrame, matches: DataFrame, room: Column) -> DataFrame:
    """(read_id, seed, run, lo, hi): the nodes of run_crumbs as stretches of runs that do not overlap.

    Backwards over crossings too; a stretch of a run is one row on the way.
    """
    going = settled(matches.select("read_id", "seed", "run", "pos", F.greatest(F.lit(0), room).cast("int").alias("left")))
    into, linear = crossings.select(F.col("run").alias("before"), F.col("to_run").alias("run")), crossings.isEmpty()
    out = going.select("read_id", "seed", "run", "pos", "left").where("false")
    while not going.isEmpty():
        out = out.unionByName(going)
        if linear:
            break
        on = going.where(F.col("left") > F.col("pos")).withColumn("left", F.col("left") - F.col("pos") - 1).join(into, "run")
        on = on.join(runs.select(F.col("run").alias("before"), F.length("label").alias("n")), "before")
        going = settled(on.groupBy("read_id", "seed", F.col("before").alias("run"), F.col("n").alias("pos")).agg(F.max("left").alias("left")))
    spans = out.select("read_id", "seed", "run", (F.col("pos") - F.least("pos", "left")).alias("lo"), F.col("pos").alias("hi"))
    # dealt by run, by which the spans meet the letters too
    return disjoint_spans(spans.repartition("run"), ["read_id", "seed", "run"])


def walks_into(runs: DataFrame, crossings: DataFrame, crumbs: DataFrame, depth: int) -> DataFrame:
    """(read_id, seed, run, pos) at the trie's nodes: those of the walks of fewer than `depth` letters that lead to a crumb (read_id, seed, run, pos), the root's none included.

    The letters before a node of a run are a part of its string; where the run
    begins, the walk goes on over the crossings into it.
    """
    return walks_into_spans(runs, crossings, crumbs.select("read_id", "seed", "run", F.col("pos").alias("lo"), F.col("pos").alias("hi")).distinct(), depth)


def walks_into_spans(runs: DataFrame, crossings: DataFrame, spans: DataFrame, depth: int) -> DataFrame:
    """walks_into of the crumbs of crumb_spans: a span meets its run's letters once, and the few different words before its nodes are kept."""
    going = settled(spans.select("read_id", "seed", "run", "lo", "hi", F.lit("").alias("behind")))
    into, linear = crossings.select(F.col("run").alias("before"), "letter", F.col("to_run").alias("run")), crossings.isEmpty()
    out = None
    while not going.isEmpty():
        at = going.join(runs, "run").withColumn("room", F.lit(depth - 1) - F.length("behind"))
        cut = at.withColumn("first", F.expr("greatest(lo - room, 0)")).select("read_id", "seed", "lo", "hi", "room", "behind", "first", F.expr("substring(label, first + 1, hi - first)").alias("letters"))
        node = cut.select("read_id", "seed", "room", "behind", "first", "letters", F.explode(F.sequence("lo", "hi")).alias("pos"))
        near = node.select("read_id", "seed", "behind", F.expr("substring(letters, greatest(pos - room, 0) - first + 1, least(pos, room))").alias("run_letters")).distinct()
        near = near.select("read_id", "seed", "behind", "run_letters", F.explode(F.sequence(F.lit(0), F.length("run_letters"))).alias("m"))
        found = near.select("read_id", "seed", F.concat(F.expr("right(run_letters, m)"), "behind").alias("prefix")).distinct()
        out = found if out is None else out.unionByName(found)
        if linear:
            break
        over = at.where(F.col("lo") < F.col("room")).select("read_id", "seed", "run", "label", "behind", F.explode(F.expr("sequence(lo, least(hi, room - 1))")).alias("pos"))
        over = over.select("read_id", "seed", "run", F.concat(F.expr("left(label, pos)"), "behind").alias("behind")).join(into, "run")
        over = over.join(runs.select(F.col("run").alias("before"), F.length("label").alias("n")), "before")
        going = settled(over.select("read_id", "seed", F.col("before").alias("run"), F.col("n").alias("lo"), F.col("n").alias("hi"), F.concat("letter", "behind").alias("behind")).distinct())
    if out is None:
        return spans.select("read_id", "seed", "run", F.col("lo").alias("pos")).where("false")
    return out.distinct().select("read_id", "seed", (F.lit(TRIE) + prefix_number(F.col("prefix"))).alias("run"), F.lit(0).alias("pos"))
