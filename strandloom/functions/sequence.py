"""Column functions on nucleotides, reads, edges and node ids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base sets of the ambiguity codes.
AMBIGUITY = {"R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: Edge types and how they are printed.
EDGE_TYPES = {"ORIG": "ORIG", "INS": "ins", "DEL": "del", "SUBST": "subst", "JUMP": "jump"}
#: The label of an edge that consumes no letter of the read.
EPSILON = "e"
#: Nodes of a segment lie in [segment << 32, (segment + 1) << 32); a reverse-complement node is the bitwise complement.
SEGMENT_BITS = 32


def complement(base: Column, strict: bool = True) -> Column:
    """Complement of bases or sequences; anything but ACGT raises, or stays where strict is off."""
    swapped = F.translate(base, "ACGT", "TGCA")
    if not strict:
        return swapped
    return F.when(base.isNull() | base.rlike("^[ACGT]*$"), swapped).otherwise(F.raise_error(F.concat(F.lit("cannot complement: "), base)))


def reverse_complement(seq: Column, strict: bool = False) -> Column:
    return F.reverse(complement(seq, strict))


def base_number(base: Column) -> Column:
    """A, C, G, T as 0 to 3; others null."""
    return F.when(base == "A", 0).when(base == "C", 1).when(base == "G", 2).when(base == "T", 3)


def is_nucleotide(base: Column) -> Column:
    return base.rlike("^[ACGTN]$")


def is_letter(label: Column) -> Column:
    """A nucleotide or the empty label."""
    return is_nucleotide(label) | (label == EPSILON)


def is_ambiguous(base: Column) -> Column:
    return base.isin(*AMBIGUITY)


def expand_base(base: Column) -> Column:
    """Array of the plain bases that a letter stands for."""
    codes = F.create_map(*[x for k, v in AMBIGUITY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.when(base.isin("A", "C", "G", "T"), F.array(base)).otherwise(F.element_at(codes, base))


def is_valid_read(seq: Column) -> Column:
    return F.upper(seq).rlike("^[ACGTN]*$")


def only_bases(text: Column) -> Column:
    """The upper-cased ACGT letters of any text, the rest dropped."""
    return F.regexp_replace(F.upper(text), "[^ACGT]", "")


def has_ending(name: Column, suffix: str) -> Column:
    return F.endswith(F.lower(name), F.lit(suffix.lower()))


def edge_type_name(etype: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in EDGE_TYPES.items() for x in (F.lit(k), F.lit(v))]), etype)


def edge_cost(etype: Column, match: int = 0, subst: int = 1, ins: int = 5, dele: int = 5) -> Column:
    return F.when(etype.isin("ORIG", "JUMP"), match).when(etype == "SUBST", subst).when(etype == "INS", ins).when(etype == "DEL", dele)


def min_mismatch_cost(subst: int, ins: int, dele: int) -> int:
    return min(subst, ins, dele)


def error_step(match: int, subst: int, ins: int, dele: int) -> int:
    """Least extra cost of one error over a match."""
    return min(subst - match, dele, ins - match)


def error_probability(quality: Column) -> Column:
    """Of a quality letter: 10 ** (-(code - 33) / 10)."""
    return F.pow(F.lit(10.0), -(F.ascii(quality) - 33) / F.lit(10.0))


def read_length(seq: Column) -> Column:
    return F.length(seq)


def read_size(seq: Column) -> Column:
    """The length less one, on which all figures per base pair rest."""
    return F.length(seq) - 1


def lower_count(spell: Column) -> Column:
    """Lower-case letters of a spelling: substitutions and insertions."""
    return F.regexp_count(spell, F.lit("[a-z]"))


def length_bin(n: Column, width: int = 150) -> Column:
    return (F.floor(n / width) * width).cast("long")


def auto_depth(n_nodes: int) -> int:
    """Index depth for a graph of so many nodes, both strands counted: floor(log4 n), 1 at least."""
    depth = 0
    while 4 ** (depth + 1) <= n_nodes:
        depth += 1
    return max(1, depth)


def gigabytes(n: Column) -> Column:
    return n / F.lit(float(1 << 30))


def log_base(base: float, x: Column) -> Column:
    return F.log(x) / F.lit(math.log(base))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "true").otherwise("false")


def node_id(segment: Column, offset: Column) -> Column:
    return F.shiftleft(segment.cast("long"), SEGMENT_BITS) + offset


def mirror(node: Column) -> Column:
    """The same place on the other strand."""
    return F.bitwise_not(node)


def on_reverse(node: Column) -> Column:
    return node < 0


def forward_node(node: Column) -> Column:
    return F.when(node < 0, F.bitwise_not(node)).otherwise(node)


def node_segment(node: Column) -> Column:
    return F.shiftright(forward_node(node), SEGMENT_BITS).cast("long")


def node_offset(node: Column) -> Column:
    return forward_node(node).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def spell_path(path: Column) -> Column:
    """Letters of a path of (label, etype) steps: matches upper, edits lower case, deletions nothing."""
    kept = F.filter(path, lambda s: s["label"] != EPSILON)
    return F.array_join(F.transform(kept, lambda s: F.when(s["etype"].isin("ORIG", "JUMP"), F.upper(s["label"])).otherwise(F.lower(s["label"]))), "")


def difference_track(path: Column, read: Column) -> Column:
    """'-' where a path step equals the read letter, '.' at deletions, else the read letter."""
    step = F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))
    walk = F.aggregate(
        path,
        step,
        lambda a, s: F.struct(
            F.when(s["label"] == EPSILON, a["i"]).otherwise(a["i"] + 1).alias("i"),
            F.concat(a["s"], F.when(s["label"] == EPSILON, ".").when(s["etype"].isin("ORIG", "JUMP"), "-").otherwise(F.substring(read, a["i"] + 1, F.lit(1)))).alias("s"),
        ),
    )
    return walk["s"]


def alignment_tracks(path: Column, read: Column, phred: Column, ground: Column, walk: Column) -> Column:
    """The seven tracks of an alignment, a letter a step: qualities, differences, read, path, graph, ground truth, edge types.

    walk holds the graph's letters that the steps pass, all but insertions. A
    step that reads no letter shows '.' for read, quality and ground truth, one
    that passes no letter of the graph shows '.' there; a read without qualities
    shows '?', and a ground truth that is too short or null shows ' '. Types are
    the first letters of their names, '.' for an original edge. A null path gives null.
    """
    gap = lambda s: s["label"] == EPSILON
    still = lambda s: s["etype"] == "INS"
    letter = lambda text, i, other: F.coalesce(F.nullif(F.substring(text, i + 1, F.lit(1)), F.lit("")), F.lit(other))
    taken = F.aggregate(
        path,
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), *[F.lit("").alias(t) for t in ("qual", "orig_read", "orig_path", "ground")]),
        lambda a, s: F.struct(
            F.when(gap(s), a["i"]).otherwise(a["i"] + 1).alias("i"),
            F.when(still(s), a["j"]).otherwise(a["j"] + 1).alias("j"),
            F.concat(a["qual"], F.when(gap(s), ".").otherwise(letter(phred, a["i"], "?"))).alias("qual"),
            F.concat(a["orig_read"], F.when(gap(s), ".").otherwise(letter(read, a["i"], "?"))).alias("orig_read"),
            F.concat(a["orig_path"], F.when(still(s), ".").otherwise(letter(walk, a["j"], "?"))).alias("orig_path"),
            F.concat(a["ground"], F.when(gap(s), ".").otherwise(letter(ground, a["i"], " "))).alias("ground"),
        ),
    )
    name = lambda s: F.substring(edge_type_name(s["etype"]), 1, 1)
    types = F.array_join(F.transform(path, lambda s: F.when(name(s) == "O", ".").otherwise(name(s))), "")
    labels = F.array_join(F.transform(path, lambda s: F.when(gap(s), ".").otherwise(s["label"])), "")
    tracks = F.struct(taken["qual"].alias("qual"), difference_track(path, read).alias("error"), taken["orig_read"].alias("orig_read"), labels.alias("align_path"), taken["orig_path"].alias("orig_path"), taken["ground"].alias("ground"), types.alias("types"))
    return F.when(path.isNotNull(), tracks)


def cost_by_type(path: Column, match: int = 0, subst: int = 1, ins: int = 5, dele: int = 5) -> Column:
    """[(name, n, cost)] of every type of edge, in the fixed order of types, those a path has none of included."""

    def one(etype: str, name: str) -> Column:
        n = F.size(F.filter(path, lambda s: s["etype"] == etype))
        return F.struct(F.lit(name).alias("name"), n.alias("n"), (n * edge_cost(F.lit(etype), match, subst, ins, dele)).alias("cost"))

    return F.when(path.isNotNull(), F.array(*[one(k, v) for k, v in EDGE_TYPES.items()]))


def printed_alignment(tracks: Column, costs: Column) -> Column:
    """An alignment as text: how many edges of each type sum to which cost, the number of differences, and the seven tracks below one another."""
    lines = F.transform(costs, lambda c: F.concat(F.lit("    "), c["n"].cast("string"), F.lit(" "), c["name"], F.lit(" edges sum to a cost of "), c["cost"].cast("string")))
    differences = F.concat(F.lit("  "), F.length(F.regexp_replace(tracks["error"], "[-.]", "")).cast("string"))
    named = (("read qual", "qual"), ("read erro", "error"), ("orig read", "orig_read"), ("alig path", "align_path"), ("orig path", "orig_path"), ("grnd seq?", "ground"), ("edge type", "types"))
    shown = [F.concat(F.lit(f"{label}: "), tracks[field]) for label, field in named]
    return F.concat_ws("\n", F.lit(" -- Summary -- "), lines, differences, F.lit(""), F.lit(" -- Alignment -- "), *shown)


def prefix_number(prefix: Column) -> Column:
    """Rank of a base string among all: shorter ones first, then base 4."""
    digits = F.split(prefix, "")
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 4 + base_number(c)))
    shorter = ((F.pow(F.lit(4.0), F.length(prefix)) - 1) / 3).cast("long")
    return value + shorter


def uniform_draw(seed: int, *key: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A number drawn evenly from [low, high), fixed by the seed and the key, so that a rerun or a lost task draws the same."""
    return F.lit(low) + (high - low) * F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
