"""Optimal semi-global alignment of reads to a segment graph.

Plan: reads that stand in the reference letter by letter are found by tables of
words and are done. Of the others, seeds join k-mers of the reference, matches propose windows,
windows are verified by dynamic programming, and a read whose best cost leaves
some seed untouched by errors is certified: nothing as cheap lies elsewhere.
Reads without a certificate, few reads, and components with branches, are aligned in full.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import SEGMENT_BITS, error_step, spell_path
from strandloom.operators.components import components
from strandloom.operators.graph import character_graph, doubled
from strandloom.operators.index import words
from strandloom.operators.kernels import SEPARATOR, Finder, Graph, Strip, batch_costs, chain_path, encode, encode_read, lay_out, reversed_complement, straight_path
from strandloom.operators.lineage import settled
from strandloom.operators.seeds import seed_matches, seeds

#: Letters of a piece of a long segment, and of a batch of pieces that one task aligns in full.
PIECE, BATCH = 1 << 16, 1 << 20
#: Reads that one task aligns in full against one batch.
READ_BLOCK = 64
#: Reads that one task looks for letter by letter in one batch, and of how many such blocks the reference is copied at most.
FIND_BLOCK, FIND_BLOCKS = 1 << 14, 16
#: Reads below SHORT letters, which seeds settle up to few errors, are aligned in full at once where they have no more than FEW letters in all.
SHORT, FEW = 64, 1 << 13
#: Letters of the shortest seeds by which a read is looked for; shorter ones stand everywhere.
SHORTEST = 8

ENDS = "read_id long, cost int, strand string, seg_id long, end_at long"
RESULT = "read_id long, rank int, status string, cost int, strand string, seg_id long, offset long, start long, end_node long, path array<struct<label:string,etype:string>>"


@dataclass(frozen=True)
class Costs:
    match: int = 0
    subst: int = 1
    ins: int = 5
    dele: int = 5

    def __post_init__(self):
        if min(self.match, self.subst, self.ins, self.dele) < 0:
            raise ValueError("costs must not be negative")
        if self.match > min(self.subst, self.ins, self.dele):
            raise ValueError("a match must not cost more than an error")

    def all(self) -> tuple[int, int, int, int]:
        return self.match, self.subst, self.ins, self.dele

    @property
    def delta(self) -> int:
        return error_step(self.match, self.subst, self.ins, self.dele)

    @property
    def gap(self) -> int:
        return min(self.ins - self.match, self.dele)


def pieces(segments: DataFrame, overlap: int) -> DataFrame:
    """(seg_id, piece, at, seq): segments cut into pieces of PIECE letters that run on for `overlap` letters; every node, the last included, has its piece."""
    n = F.length("seq")
    cut = segments.select("seg_id", F.col("seq").alias("whole"), F.explode(F.sequence(F.lit(0), F.floor(n / PIECE).cast("int"))).alias("piece"))
    at = F.col("piece") * PIECE
    return cut.select("seg_id", "piece", at.cast("long").alias("at"), F.substring("whole", at + 1, F.lit(PIECE + overlap)).alias("seq"))


def _ends(now: np.ndarray) -> tuple[int, np.ndarray]:
    low = int(now.min())
    return low, np.flatnonzero(now == low)


def seeded_ends(cut: DataFrame, reads: DataFrame, seed_len: int, costs: Costs, longest: int) -> DataFrame:
    """(read_id, cost, strand, seg_id, end_at) of the best ends in each window that a seed match proposes.

    end_at is the forward coordinate of the end node. The window is as wide as
    a certified read can drift.
    """
    drift = max(0, ((longest // seed_len) * costs.delta - 1) // costs.gap)
    forward = words(cut, seed_len, ["seg_id", "piece"]).where(F.col("pos") < PIECE).select("seg_id", "piece", F.col("pos").alias("off"), F.col("word").alias("kmer"))
    wanted = seeds(reads, seed_len)
    # the reverse strand is matched by reverse-complementing the seeds, which are few, not the reference
    both = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("kmer").alias("word")), F.struct(F.lit("-").alias("strand"), F.reverse(F.translate("kmer", "ACGT", "TGCA")).alias("word")))).alias("s")
    length = F.col("start") + (F.col("seed") + 1) * seed_len
    wanted = wanted.select("read_id", length.alias("len"), "start", both).select("read_id", "len", "start", "s.strand", F.col("s.word").alias("kmer"))
    met = wanted.join(forward, "kmer")
    # where the read would begin on the forward strand, were there no indels
    first = F.when(F.col("strand") == "+", F.col("off") - F.col("start")).otherwise(F.col("off") - (F.col("len") - F.col("start") - seed_len))
    first = F.col("piece").cast("long") * PIECE + first
    begin = F.greatest(F.lit(0), F.col("first") - drift)
    windows = met.select("read_id", "len", "strand", "seg_id", first.alias("first")).distinct()
    # a window is cut from the piece that holds its first letter; pieces run on for long enough, and only windows travel on
    wide = F.col("len") + 2 * drift + F.least(F.lit(0), F.col("first") - drift)
    placed = windows.withColumn("piece", F.floor(begin / PIECE).cast("int")).join(cut, ["seg_id", "piece"])
    sliced = placed.select("read_id", "strand", "seg_id", begin.alias("at"), F.substring("seq", (begin - F.col("at")).cast("int") + 1, wide.cast("int")).alias("window"))
    sliced = sliced.join(reads.select("read_id", F.col("seq").alias("read")), "read_id")

    price = costs.all()

    def verify(batches):
        for pdf in batches:
            n, at = pdf["read"].str.len().to_numpy(), pdf["at"].to_numpy()
            ids, segs, signs = pdf["read_id"].to_numpy(), pdf["seg_id"].to_numpy(), (pdf["strand"] == "+").to_numpy()
            seqs = [w if p else reversed_complement(w) for w, p in zip(pdf["window"], signs, strict=True)]
            for length in np.unique(n):
                same = np.flatnonzero(n == length)
                for lo in range(0, len(same), 512):
                    part = same[lo : lo + 512]
                    width = np.array([len(seqs[i]) for i in part])
                    codes = np.full((len(part), width.max()), SEPARATOR, dtype=np.uint8)
                    for r, i in enumerate(part):
                        codes[r, : width[r]] = encode(seqs[i])
                    now = batch_costs(codes, np.stack([encode_read(pdf["read"].iat[i]) for i in part]), price)
                    low = now.min(axis=1)
                    r, end = np.nonzero(now == low[:, None])
                    i = part[r]
                    yield pd.DataFrame({"read_id": ids[i], "cost": low[r].astype(np.int32), "strand": np.where(signs[i], "+", "-"), "seg_id": segs[i], "end_at": np.where(signs[i], at[i] + end, at[i] + width[r] - end)})

    return sliced.mapInPandas(verify, ENDS)


def _batched(cut: DataFrame, reads: DataFrame, n_reads: int, block: int):
    """Pieces packed into batches, reads into blocks of so many, every pair a group of (pieces, reads)."""
    size = cut.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("n")).first()["n"]
    batches, blocks = max(1, -(-size // BATCH)), max(1, -(-n_reads // block))
    refs = cut.select(F.pmod(F.xxhash64("seg_id", "piece"), F.lit(batches)).alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "seg_id", "at", "seq")
    asks = reads.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch"), F.pmod(F.xxhash64("read_id"), F.lit(blocks)).cast("int").alias("block"), "read_id", "seq")
    return refs.groupBy("batch", "block").cogroup(asks.groupBy("batch", "block"))


def _ends_frame(parts: list) -> pd.DataFrame:
    """Rows of ENDS from parts (read_id, cost, forward, segments, ends), the last two arrays of one length."""
    many = np.array([len(p[3]) for p in parts], dtype=np.int64)
    each = lambda c, kind: np.repeat(np.array([p[c] for p in parts], dtype=kind), many)
    along = lambda c: np.concatenate([np.zeros(0, dtype=np.int64), *[p[c] for p in parts]])
    return pd.DataFrame({"read_id": each(0, np.int64), "cost": each(1, np.int32), "strand": np.where(each(2, bool), "+", "-"), "seg_id": along(3), "end_at": along(4)})


def exact_ends(cut: DataFrame, reads: DataFrame, costs: Costs, n_reads: int) -> DataFrame:
    """As seeded_ends, all places where reads stand in the pieces letter by letter: the best ends of these reads, where every error costs."""

    def meet(key: tuple, ref: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out, segs, ats = [], ref["seg_id"].to_numpy(), ref["at"].to_numpy()
        ids, seqs = ask["read_id"].to_numpy(), ask["seq"].tolist()
        if len(ref) and len(ask):
            codes, first = lay_out(ref["seq"].tolist())
            finder = Finder([*seqs, *map(reversed_complement, seqs)])
            for r, start in finder.places(codes):
                plus, r = r < len(seqs), r % len(seqs)
                i = np.searchsorted(first, start, side="right") - 1
                off = start - first[i]
                # what begins behind PIECE letters is the next piece's
                i, off = i[off < PIECE], off[off < PIECE]
                out.append((ids[r], len(seqs[r]) * costs.match, plus, segs[i], ats[i] + off + (len(seqs[r]) if plus else 0)))
        return _ends_frame(out)

    return _batched(cut, reads, n_reads, FIND_BLOCK).applyInPandas(meet, ENDS)


def full_ends(cut: DataFrame, reads: DataFrame, costs: Costs) -> DataFrame:
    """As seeded_ends, every read against every piece: the exact way for what seeds do not settle.

    Pieces are packed into batches, reads into blocks; a task aligns a block to
    a batch and keeps its best ends only.
    """
    price = costs.all()

    def meet(key: tuple, ref: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        found = {rid: (np.iinfo(np.int64).max, []) for rid in ask["read_id"]}
        coded = {rid: encode_read(read) for rid, read in zip(ask["read_id"], ask["seq"], strict=True)}
        segs, ats, seqs = ref["seg_id"].to_numpy(), ref["at"].to_numpy(), ref["seq"].tolist()
        # pieces side by side in strips of about PIECE letters, whose costs stay in the cache
        cuts = np.flatnonzero(np.diff(np.cumsum([len(s) + 1 for s in seqs]) // PIECE, prepend=-1)).tolist() if seqs else []
        for lo, hi in zip(cuts, [*cuts[1:], len(seqs)], strict=True):
            for strand in "+-":
                codes, first = lay_out(seqs[lo:hi] if strand == "+" else [reversed_complement(s) for s in seqs[lo:hi]])
                strip = Strip(codes, price)
                for rid, read in coded.items():
                    now, cap = strip.costs_of(read)
                    best, low = int(now.min()), found[rid][0]
                    if best > low:
                        continue
                    if best < low:
                        found[rid] = best, []
                    node = np.flatnonzero(now == best)
                    i = np.searchsorted(first, node, side="right") - 1
                    found[rid][1].append((strand, lo + i, node - first[i]))
        out = []
        for rid, (best, parts) in found.items():
            for strand, i, node in parts:
                end = ats[i] + (node if strand == "+" else np.array([len(seqs[j]) for j in i]) - node)
                out.append((rid, best, strand == "+", segs[i], end))
        return _ends_frame(out)

    return _batched(cut, reads, reads.count(), READ_BLOCK).applyInPandas(meet, ENDS)


def best_ends(ends: DataFrame) -> DataFrame:
    """All co-optimal ends of each read, distinct."""
    low = ends.groupBy("read_id").agg(F.min("cost").alias("cost"))
    return ends.join(low, ["read_id", "cost"]).select("read_id", "cost", "strand", "seg_id", "end_at").distinct()


def reference_pieces(segments: DataFrame, costs: Costs, longest: int) -> DataFrame:
    """Pieces of unlinked segments that run on for any alignment of a read of so many letters."""
    if costs.dele <= 0 or costs.gap <= 0:
        room = 3 * longest + longest * max(costs.subst, costs.match) + 1
    else:
        room = longest + max(longest * max(costs.subst, costs.ins) // costs.dele, 2 * (longest * max(costs.delta, 0) // costs.gap)) + 2
    return settled(pieces(segments, room))


def linear_ends(cut: DataFrame, reads: DataFrame, costs: Costs, seed_len: int | None, longest: int) -> DataFrame:
    """Best ends of reads on the pieces of unlinked segments.

    A read that stands in them letter by letter has its best ends where it does.
    Of the others a few short ones are aligned in full, as the reference would
    be cut into words for them alone. The rest are seeded: a read is certified if its cost leaves one of its seeds untouched: then no
    end as cheap lies outside the windows of its seeds. Where it does not, its
    cost e still bounds the errors, and of e + 1 shorter seeds one is untouched
    by any alignment as cheap; so it is seeded again by the longest length of a
    falling row that gives as many. What then has no window, or would need
    seeds below SHORTEST letters, is aligned in full.
    """
    if not seed_len or costs.delta <= 0 or costs.gap <= 0:
        return full_ends(cut, reads, costs)
    n, done, n_reads = F.length("seq"), [], reads.count()
    if n_reads <= FIND_BLOCK * FIND_BLOCKS:
        done.append(settled(exact_ends(cut, reads, costs, n_reads)))
        reads = settled(reads.join(done[0].select("read_id").distinct(), "read_id", "left_anti"))
        left = reads.agg(F.sum(F.when(n < SHORT, n)).alias("short"), F.count_if(n >= SHORT).alias("long")).first()
        if left["short"] and left["short"] <= FEW:
            done.append(full_ends(cut, reads.where(n < SHORT), costs))
            reads = reads.where(n >= SHORT)
        if not left["long"] and (left["short"] or 0) <= FEW:
            return done[0] if len(done) == 1 else done[0].unionByName(done[1])
    bound = reads.select("read_id", "seq", F.lit(None).cast("int").alias("errors"))
    length = seed_len
    while True:
        asked = bound if length == seed_len else bound.where(n >= (F.col("errors") + 1) * length)
        found = settled(seeded_ends(cut, asked, length, costs, longest))
        low = found.groupBy("read_id").agg(F.min("cost").alias("c"))
        met = bound.join(low, "read_id", "left").withColumn("e", F.floor((F.col("c") - n * costs.match) / costs.delta).cast("int"))
        met = settled(met.select("read_id", "seq", F.least("errors", "e").alias("errors"), F.coalesce(F.floor(n / F.lit(float(length))) > F.col("e"), F.lit(False)).alias("sure")))
        done.append(found.join(met.where("sure"), "read_id", "left_semi"))
        bound = met.where("NOT sure").drop("sure")
        # lengths fall by a quarter at least, so rounds are few, and to one that some read can use
        longest_left = bound.agg(F.max(F.floor(n / (F.col("errors") + 1))).alias("q")).first()["q"]
        length, before = min(max(length * 3 // 4, SHORTEST), int(longest_left or 0)), length
        if length < SHORTEST or length == before:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out if bound.isEmpty() else out.unionByName(full_ends(cut, bound.select("read_id", "seq"), costs))


def _chain_paths(best: DataFrame, cut: DataFrame, reads: DataFrame, costs: Costs) -> DataFrame:
    """(read_id, cost, strand, seg_id, offset, end_node, path) of ends on unlinked segments cut into pieces, offset the leftmost letter's."""
    price = costs.all()
    plus = F.col("strand") == "+"
    near = best.join(reads.select("read_id", F.col("seq").alias("read")), "read_id")
    room = (F.length("read") + F.floor(F.col("cost") / F.lit(float(max(1, costs.dele))))).cast("int")
    lo = F.when(plus, F.greatest(F.lit(0), F.col("end_at") - room)).otherwise(F.col("end_at")).cast("long")
    wide = F.when(plus, F.col("end_at") - F.col("lo")).otherwise(room).cast("int")
    near = near.withColumn("lo", lo).withColumn("piece", F.floor(F.col("lo") / PIECE).cast("int")).join(cut.withColumnRenamed("seq", "whole"), ["seg_id", "piece"])
    near = near.select("read_id", "read", "cost", "strand", "seg_id", "end_at", "lo", F.substring("whole", (F.col("lo") - F.col("at")).cast("int") + 1, wide).alias("window"))

    def trace(batches):
        for pdf in batches:
            out = []
            for rid, read, cost, strand, seg, end, lo, window in zip(*(pdf[c] for c in ("read_id", "read", "cost", "strand", "seg_id", "end_at", "lo", "window")), strict=True):
                seq = window if strand == "+" else reversed_complement(window)
                codes = encode(seq)
                start, steps = straight_path(codes, read, price, len(seq), cost) or chain_path(codes, read, price, len(seq))
                left = lo + start if strand == "+" else end
                node = (int(seg) << SEGMENT_BITS) + int(end)
                out.append((rid, cost, strand, seg, left, node if strand == "+" else ~node, [{"label": a, "etype": b} for a, b in steps]))
            yield pd.DataFrame(out, columns=["read_id", "cost", "strand", "seg_id", "offset", "end_node", "path"])

    return near.mapInPandas(trace, "read_id long, cost int, strand string, seg_id long, offset long, end_node long, path array<struct<label:string,etype:string>>")


def _graph_paths(edges: DataFrame, groups: DataFrame, reads: DataFrame, costs: Costs, k: int) -> DataFrame:
    """As _chain_paths, of up to k best ends of each read in every component (node, component) with branches; a task holds one component's edges."""
    price = costs.all()
    n_reads = reads.count()
    blocks = max(1, -(-n_reads // READ_BLOCK))
    own = edges.join(groups.select(F.col("node").alias("src"), F.col("component").alias("c")), "src").select("c", "src", "dst", "label")
    parts = own.select("c", "src", "dst", "label", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asks = groups.select(F.col("component").alias("c")).distinct().crossJoin(reads.select("read_id", "seq", F.pmod(F.xxhash64("read_id"), F.lit(blocks)).cast("int").alias("block")))

    def meet(key: tuple, e: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(e):
            g = Graph(e["src"].to_numpy(), e["dst"].to_numpy(), e["label"].tolist())
            for rid, read in zip(ask["read_id"], ask["seq"], strict=True):
                rows = g.rows(encode_read(read), price)
                low, ends = _ends(rows.last)
                order = sorted(ends.tolist(), key=lambda v: int(g.ids[v]))
                for r, v in enumerate(order):
                    node = int(g.ids[v])
                    start, steps = g.path(rows, read, price, v) if r < k else (v, [])
                    left = int(g.ids[start]) if node >= 0 else ~node
                    out.append((rid, low, "+" if node >= 0 else "-", left >> SEGMENT_BITS, left & ((1 << SEGMENT_BITS) - 1), node, [{"label": a, "etype": b} for a, b in steps]))
        return pd.DataFrame(out, columns=["read_id", "cost", "strand", "seg_id", "offset", "end_node", "path"])

    return parts.groupBy("c", "block").cogroup(asks.groupBy("c", "block")).applyInPandas(meet, "read_id long, cost int, strand string, seg_id long, offset long, end_node long, path array<struct<label:string,etype:string>>")


def align(segments: DataFrame, links: DataFrame | None, reads: DataFrame, *, costs: Costs = Costs(), k: int = 1, seed_len: int | None = None, drop_tail: bool = True, max_cost: int = 10_000_000) -> DataFrame:
    """Up to k co-optimal alignments of each read (read_id, seq) to the segments (seg_id, seq) and links, both strands.

    Rows (read_id, rank, status, cost, strand, seg_id, offset, start, end_node,
    spell, path). status: unique, ambiguous (several optimal end nodes),
    overcost (above max_cost: one row, the rest null) or none (an empty read).
    offset is the leftmost letter on the forward strand within its segment,
    start the same from 1. rank orders ends by (strand, segment, end).
    Without seed_len every read is aligned in full. Letters other than ACGT in
    a read match nothing.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = reads.select("read_id", F.upper("seq").alias("seq"))
    asked = settled(rows.where("seq <> ''"))
    longest = asked.agg(F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("n")).first()["n"]
    segments = segments.select("seg_id", F.upper("seq").alias("seq")).where("seq <> ''")
    linked = None
    alone = segments
    if links is not None and not links.isEmpty():
        forward = links.where("from_fwd")
        touched = forward.select(F.explode(F.array("from_id", "to_id")).alias("seg_id")).distinct()
        alone = segments.join(touched, "seg_id", "left_anti")
        linked = segments.join(touched, "seg_id", "left_semi")
    if drop_tail:
        alone = alone.select("seg_id", F.expr("left(seq, length(seq) - 1)").alias("seq"))
    alone = alone.where("seq <> ''")
    found = None
    if longest and not alone.isEmpty():
        cut = reference_pieces(alone, costs, longest)
        ends = settled(best_ends(linear_ends(cut, asked, costs, seed_len, longest)))
        found = _counted(ends.withColumn("key", F.struct("strand", "seg_id", "end_at")), k)
        paths = _chain_paths(found.where("picked").select("read_id", "cost", "strand", "seg_id", "end_at", "ends"), cut, asked, costs)
        found = paths.join(found.select("read_id", "ends").distinct(), "read_id").withColumn("kind", F.lit("chain"))
    if longest and linked is not None:
        edges = settled(doubled(character_graph(linked, links, drop_tail)))
        groups = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        more = settled(_graph_paths(edges, groups, asked, costs, k))
        per = more.groupBy("read_id", "cost").agg(F.count("*").alias("ends"))  # of several components the cheapest remain below
        more = more.join(per, ["read_id", "cost"]).where(F.size("path") > 0).withColumn("kind", F.lit("graph")).select("read_id", "cost", "strand", "seg_id", "offset", "end_node", "path", "ends", "kind")
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = reads.sparkSession.createDataFrame([], "read_id long, cost int, strand string, seg_id long, offset long, end_node long, path array<struct<label:string,etype:string>>, ends long, kind string")
    # the two kinds of components meet: the least cost wins and its ends add up
    found = settled(found)
    low = found.groupBy("read_id").agg(F.min("cost").alias("cost"))
    by_kind = found.join(low, ["read_id", "cost"])
    kinds = by_kind.select("read_id", "kind", "ends").distinct().groupBy("read_id").agg(F.sum("ends").alias("all_ends"))
    order = Window.partitionBy("read_id").orderBy("strand", "seg_id", F.abs(F.col("end_node") + F.when(F.col("end_node") < 0, 1).otherwise(0)))
    ranked = by_kind.join(kinds, "read_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    full = rows.select("read_id", F.col("seq").alias("read")).join(ranked, "read_id", "left")
    over = F.col("cost") > max_cost
    status = F.when(F.col("cost").isNull(), "none").when(over, "overcost").when(F.col("all_ends") > 1, "ambiguous").otherwise("unique")
    full = full.withColumn("status", status).where("status <> 'overcost' OR rank = 1")
    kept = [F.when(F.col("status").isin("unique", "ambiguous"), F.col(c)).alias(c) for c in ("cost", "strand", "seg_id", "offset", "end_node", "path")]
    out = full.select("read_id", "read", F.coalesce("rank", F.lit(1)).alias("rank"), "status", *kept)
    return out.select("read_id", "rank", "status", "cost", "strand", "seg_id", "offset", (F.col("offset") + 1).alias("start"), "end_node", spell_path(F.col("path")).alias("spell"), "path")


def _counted(ends: DataFrame, k: int) -> DataFrame:
    """Ends with their number per read, the first k by key picked."""
    per = ends.groupBy("read_id").agg(F.count("*").alias("ends"))
    order = Window.partitionBy("read_id").orderBy("key")
    return ends.join(per, "read_id").withColumn("picked", F.row_number().over(order) <= k).drop("key")


def relax(edges: DataFrame, reads: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(read_id, cost, n_ends) by relational relaxation alone, for small inputs: an independent check of the kernels.

    States (read_id, node, cost) after i letters; a round joins the edges,
    keeps the least cost of each node, and closes deletions until none improves.
    """
    from strandloom.operators.graph import nodes

    asked = settled(reads.select("read_id", F.upper("seq").alias("seq")).where("seq <> ''"))
    state = settled(asked.select("read_id").crossJoin(nodes(edges)).withColumn("cost", F.lit(0)))
    step = settled(edges.select(F.col("src").alias("node"), "dst", "label"))
    longest = asked.agg(F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("n")).first()["n"]
    done = None
    best = lambda rows: rows.groupBy("read_id", "node").agg(F.min("cost").alias("cost"))
    for i in range(1, longest + 1):
        letter = asked.where(F.length("seq") >= i).select("read_id", F.substring("seq", i, 1).alias("letter"))
        going = state.join(letter, "read_id")
        price = F.when(F.col("label") == F.col("letter"), costs.match).otherwise(costs.subst)
        along = going.join(step, "node").select("read_id", F.col("dst").alias("node"), (F.col("cost") + price).alias("cost"))
        state = settled(best(along.unionByName(going.select("read_id", "node", (F.col("cost") + costs.ins).alias("cost")))))
        while True:
            skip = state.join(step, "node").select("read_id", F.col("dst").alias("node"), (F.col("cost") + costs.dele).alias("cost"))
            closed = settled(best(state.unionByName(skip)))
            changed = not closed.exceptAll(state).isEmpty()
            state = closed
            if not changed:
                break
        ended = state.join(asked.where(F.length("seq") == i).select("read_id"), "read_id", "left_semi")
        done = ended if done is None else done.unionByName(ended)
    if done is None:
        return asked.sparkSession.createDataFrame([], "read_id long, cost int, n_ends long")
    low = done.groupBy("read_id").agg(F.min("cost").alias("cost"))
    return done.join(low, ["read_id", "cost"]).groupBy("read_id", "cost").agg(F.count("*").alias("n_ends"))
