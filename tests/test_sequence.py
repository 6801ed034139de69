import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as S


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_complement(spark):
    assert one(spark, S.complement(F.col("s")), s="ACGT") == "TGCA"
    assert one(spark, S.reverse_complement(F.col("s")), s="AACG") == "CGTT"
    with pytest.raises(Exception, match="cannot complement"):
        one(spark, S.complement(F.col("s")), s="N")


def test_bases(spark):
    assert [one(spark, S.base_number(F.col("s")), s=c) for c in "ACGTN"] == [0, 1, 2, 3, None]
    assert one(spark, S.expand_base(F.col("s")), s="B") == ["C", "G", "T"]
    assert one(spark, S.expand_base(F.col("s")), s="A") == ["A"]
    assert one(spark, S.is_valid_read(F.col("s")), s="acgn") and not one(spark, S.is_valid_read(F.col("s")), s="ACX")
    assert one(spark, S.is_letter(F.col("s")), s="e") and not one(spark, S.is_letter(F.col("s")), s="x")
    assert one(spark, S.only_bases(F.col("s")), s="a-Cgz t") == "ACGT"


def test_numbers(spark):
    assert S.auto_depth(4) == 1 and S.auto_depth(16) == 2 and S.auto_depth(19650) == 7
    assert S.error_step(0, 1, 5, 5) == 1 and S.min_mismatch_cost(3, 2, 4) == 2
    assert one(spark, S.error_probability(F.col("s")), s="+") == pytest.approx(0.1)
    assert one(spark, S.read_size(F.col("s")), s="ACG") == 2
    assert one(spark, S.lower_count(F.col("s")), s="AcgT") == 2
    assert one(spark, S.prefix_number(F.col("s")), s="") == 0
    assert [one(spark, S.prefix_number(F.col("s")), s=x) for x in ("A", "T", "AA", "TT")] == [1, 4, 5, 20]


def test_nodes(spark):
    node = S.node_id(F.lit(7), F.lit(3))
    assert one(spark, S.node_segment(S.mirror(node))) == 7 and one(spark, S.node_offset(S.mirror(node))) == 3
    assert one(spark, S.on_reverse(S.mirror(node))) and not one(spark, S.on_reverse(node))


def test_paths(spark):
    path = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("etype")) for a, b in [("A", "ORIG"), ("C", "SUBST"), ("e", "DEL"), ("G", "INS"), ("T", "JUMP")]])
    assert one(spark, S.spell_path(path)) == "AcgT"
    assert one(spark, S.difference_track(path, F.lit("ACGT"))) == "-C.G-"
    assert [one(spark, S.edge_cost(F.lit(t))) for t in ("ORIG", "JUMP", "SUBST", "INS", "DEL")] == [0, 0, 1, 5, 5]
    assert one(spark, S.edge_type_name(F.lit("DEL"))) == "del"


def test_tracks_and_costs_of_a_path(spark):
    """Every kind of edge, short qualities, a null ground truth; the tracks stay as long as the path."""
    path = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("etype")) for a, b in [("A", "ORIG"), ("C", "SUBST"), ("e", "DEL"), ("G", "INS"), ("T", "JUMP")]])
    tracks = S.alignment_tracks(path, F.lit("ACGT"), F.lit("I+"), F.lit(None).cast("string"), F.lit("AGCT"))
    assert tuple(one(spark, tracks)) == ("I+.??", "-C.G-", "AC.GT", "AC.GT", "AGC.T", "  .  ", ".sdij")
    costs = S.cost_by_type(path, 0, 1, 5, 7)
    assert [tuple(c) for c in one(spark, costs)] == [("ORIG", 1, 0), ("ins", 1, 5), ("del", 1, 7), ("subst", 1, 1), ("jump", 1, 0)]
    printed = one(spark, S.printed_alignment(tracks, costs)).split("\n")
    assert printed[:7] == [" -- Summary -- ", "    1 ORIG edges sum to a cost of 0", "    1 ins edges sum to a cost of 5", "    1 del edges sum to a cost of 7", "    1 subst edges sum to a cost of 1", "    1 jump edges sum to a cost of 0", "  2"]
    assert printed[8] == " -- Alignment -- " and printed[12:14] == ["alig path: AC.GT", "orig path: AGC.T"] and len(printed) == 16
    none = F.lit(None).cast("array<struct<label:string,etype:string>>")
    assert one(spark, S.alignment_tracks(none, F.lit("A"), F.lit("I"), F.lit("A"), F.lit("A"))) is None and one(spark, S.cost_by_type(none)) is None
