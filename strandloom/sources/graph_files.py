"""Reference files: GFA and FASTA in, GFA, FASTA and edge lists out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators.graph import graph_size
from strandloom.operators.lineage import settled


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, links) of the S and L lines: (seg_id, seq) and (from_id, from_fwd, to_id, to_fwd, overlap)."""
    fields = spark.read.text(path).select(F.split("value", "\t").alias("f")).select("f", F.col("f")[0].alias("kind"))
    segments = fields.where("kind = 'S'").select(F.col("f")[1].cast("long").alias("seg_id"), F.upper(F.col("f")[2]).alias("seq"))
    overlap = F.regexp_extract(F.coalesce(F.get(F.col("f"), F.lit(5)), F.lit("0M")), r"^(\d+)", 1)
    links = fields.where("kind = 'L'").select(
        F.col("f")[1].cast("long").alias("from_id"),
        (F.col("f")[2] == "+").alias("from_fwd"),
        F.col("f")[3].cast("long").alias("to_id"),
        (F.col("f")[4] == "+").alias("to_fwd"),
        F.coalesce(overlap.try_cast("int"), F.lit(0)).alias("overlap"),
    )
    return segments, links


def validate_gfa(segments: DataFrame, links: DataFrame) -> None:
    """Raise ValueError for what the aligner cannot carry: overlaps, reverse links, empty or non-ACGT segments."""
    bad = links.agg(F.count_if(F.col("overlap") > 0).alias("overlaps"), F.count_if(~F.col("from_fwd") | ~F.col("to_fwd")).alias("reverse")).first()
    odd = segments.agg(F.count_if(~F.col("seq").rlike("^[ACGT]+$")).alias("letters")).first()
    if bad["overlaps"]:
        raise ValueError(f"{bad['overlaps']} links overlap their segments")
    if bad["reverse"]:
        raise ValueError(f"{bad['reverse']} links join reverse strands")
    if odd["letters"]:
        raise ValueError(f"{odd['letters']} segments are empty or hold letters other than ACGT")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of a FASTA file, records of any number of lines; a blank line ends a record's sequence."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    header = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1)
    body = F.regexp_replace(body, r"\r", "")
    body = F.split(body, r"\n\n")[0]
    return records.select(header.alias("name"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq")).where("seq <> ''")


def fasta_segments(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FASTA records as unlinked segments, numbered by name; no tail is lost, as there is a sink behind each.

    Records are dealt by ranges of the name and numbered inside each, and the
    counts of the ranges before shift the numbers: no task orders the table.
    """
    placed = records.select("name", "seq").repartitionByRange("name", "seq").sortWithinPartitions("name", "seq")
    placed = settled(placed.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "name", "seq"))
    held = placed.groupBy("part").agg(F.count("*").alias("n"))
    shift = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    numbered = placed.join(F.broadcast(held.select("part", shift.alias("shift"))), "part").select((F.col("at") + F.col("shift") + 1).alias("seg_id"), "name", "seq")
    none = records.sparkSession.createDataFrame([], "from_id long, from_fwd boolean, to_id long, to_fwd boolean, overlap int")
    return numbered, none


def linear_with_tail(seq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A linear graph that loses no letter: (seg_id, seq) get a fictive last segment `A` and a link to it.

    Fictive ids are the bitwise complements, so they meet no real one.
    """
    tails = seq.select((-F.col("seg_id") - 1).alias("seg_id"), F.lit("A").alias("seq"))
    links = seq.select(F.col("seg_id").alias("from_id"), F.lit(True).alias("from_fwd"), (-F.col("seg_id") - 1).alias("to_id"), F.lit(True).alias("to_fwd"), F.lit(0).alias("overlap"))
    return seq.select("seg_id", "seq").unionByName(tails), links


def head_of(seq: DataFrame, letters: int) -> DataFrame:
    """The first so many letters of each sequence, unknown ones removed."""
    return seq.withColumn("seq", F.regexp_replace(F.substring("seq", 1, letters), "N", ""))


def read_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, bool]:
    """(segments, links, drop_tail) by the file's ending; ValueError for another ending."""
    name = path.lower()
    if name.endswith((".fa", ".fasta")):
        return *fasta_segments(read_fasta(spark, path)), False
    if name.endswith(".gfa"):
        segments, links = read_gfa(spark, path)
        validate_gfa(segments, links)
        return segments, links, True
    raise ValueError(f"unknown format of {path}")


def gfa_lines(segments: DataFrame, links: DataFrame) -> DataFrame:
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    s = segments.select(F.concat_ws("\t", F.lit("S"), F.col("seg_id").cast("string"), "seq").alias("value"))
    return s.unionByName(links.select(F.concat_ws("\t", F.lit("L"), F.col("from_id").cast("string"), sign("from_fwd"), F.col("to_id").cast("string"), sign("to_fwd"), F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value")))


def write_gfa(segments: DataFrame, links: DataFrame, path: str) -> None:
    gfa_lines(segments, links).write.text(path)


def write_fasta(records: DataFrame, path: str) -> None:
    records.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


def edge_list_lines(edges: DataFrame, size: DataFrame | None = None) -> DataFrame:
    """A line 'nodes edges' with their numbers, then a line 'src dst label type' an edge. Pass the size (n_nodes, n_edges) where it is known without counting different nodes."""
    size = graph_size(edges) if size is None else size
    head = size.select(F.concat_ws(" ", F.col("n_nodes").cast("string"), F.col("n_edges").cast("string")).alias("value"))
    return head.unionByName(edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), "label", "etype").alias("value")))
